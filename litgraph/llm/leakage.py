"""Evaluation texts leaking into training text: SimHash of item-sized windows and multi-index Hamming blocks.

1. Windows are sized by the item. A leak of ``SHARE`` of a passage in two stretches has one of half that length; the
   passage's window is the largest of ``SIZES`` that such a stretch holds wherever it begins, if the documents' windows
   start at every ``stride``-th word. So each size has its own index, and a document is fingerprinted once per size.
2. A fingerprint is the 64-bit SimHash of a window's words; words that few items use weigh more. It is cut into four
   blocks of 16 bits. Two fingerprints within ``RADIUS`` 7 differ by one bit at most in some block, so looking up
   every block and all its one-bit neighbours finds all item windows within the radius.
3. A document that meets an item is verified by weighted shingles: the share of the passage's word pairs, weighted by
   how few items have them, that the document holds, over the whole document. Sentences that many items share weigh
   little. At least ``SIMILAR`` is needed.
4. An exact check follows: word by word along every alignment of passage and document, parts are joined to stretches,
   and the best two in order must cover the share.

Items are the query set. They are read in blocks of at most ``BLOCK`` items, each broadcast (some 10 kB an item, the
index is built once per worker) and found in one scan of the corpus. Documents stay where they are: no shuffle beyond
``spread``.

Null and empty texts and passages give nothing; passages of fewer than five words must come out whole; those of fewer
than 25 words need one stretch of five words. Repeated items and repeated documents are all reported; extra columns
are ignored. Documents of a batch are fingerprinted together, very long ones in pieces that overlap by a window.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.physical import spread

SHARE = 0.4
BLOCK = 16_384
RADIUS, BLOCKS, BITS = 7, 4, 16
#: (words of a window, words between the starts of a document's windows): a stretch of size + stride - 1 words holds one
SIZES = ((5, 1), (6, 2), (8, 4), (12, 6), (18, 9), (27, 13), (40, 20), (60, 30), (90, 45), (135, 67))
LEAST = SIZES[0][0]
#: Words fingerprinted at a time
STEP = 1 << 15
#: Signs are kept for so many word hashes; words that share one differ to the exact check
ROWS = 1 << 14
#: Weight of words and shingles that one of so many items or more uses falls with their use
OFTEN = 64
#: Share of a passage's weighted word pairs that a document must hold
SIMILAR = 0.1
MARKUP = re.compile(r"<[^<>]{1,200}>|&#?\w{1,8};")
WORD = re.compile(r"[^\W_]+")
#: Item words without a match that may lie inside a stretch, and by how many words its alignment may drift
GAP, DRIFT = 4, 6
#: Share of a stretch's weight that has to agree
AGREE = 0.65


def words(text: str) -> list[str]:
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.casefold())


def size_of(n_words: int, share: float = SHARE) -> tuple[int, int]:
    """(window, stride) for a passage of ``n_words``."""
    if n_words < LEAST:
        return n_words, 1
    stretch = int(n_words * share / 2)
    return max((s for s in SIZES if s[0] + s[1] - 1 <= stretch), default=SIZES[0])


SIGNS = np.random.default_rng(7).integers(0, 2, (ROWS, 64), dtype=np.int8) * 2 - 1


class Blocks:
    """Multi-index of distinct 64-bit fingerprints: for each block, who has each of its values."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.lists = prints, radius, []
        self.flips = np.concatenate([[0], 1 << np.arange(BITS)])[: 1 if radius < BLOCKS else None]
        for b in range(BLOCKS):
            part = self.part(prints, b)
            order = np.argsort(part, kind="stable").astype(np.int32)
            self.lists.append((np.searchsorted(part[order], np.arange((1 << BITS) + 1)), order))

    @staticmethod
    def part(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the index) of all pairs within the radius, some of them repeated."""
        left, right = [], []
        for b, (start, order) in enumerate(self.lists):
            part = self.part(prints, b)
            for flip in self.flips:
                value = part ^ flip
                n = start[value + 1] - start[value]
                hit = np.flatnonzero(n)
                n = n[hit]
                at = np.repeat(hit, n)
                item = order[np.repeat(start[value[hit]] - np.cumsum(n) + n, n) + np.arange(len(at))]
                near = np.flatnonzero(np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius)
                left.append(at[near])
                right.append(item[near])
        return np.concatenate(left), np.concatenate(right)


class Index:
    """What a scan needs of some items (key, passage)."""

    def __init__(self, items: list[tuple], share: float = SHARE, radius: int = RADIUS):
        texts = [(key, words(passage)) for key, passage in items]
        self.items = [(key, ws) for key, ws in texts if ws]
        self.share = share
        uses: dict[str, int] = {}
        for _, ws in self.items:
            for w in set(ws):
                uses[w] = uses.get(w, 0) + 1
        n = len(self.items)
        # words of one item in OFTEN or more: at most OFTEN times the words of an item
        common = [w for w, u in uses.items() if u * OFTEN >= n]
        self.common = {w: ROWS + i for i, w in enumerate(common)}
        self.cache: dict[str, int] = {}
        weight = np.concatenate([np.full(ROWS, self.weight(0, n)), [self.weight(uses[w], n) for w in common]])
        self.weights_of = [np.array([self.weight(uses[w], n) for w in ws]) for _, ws in self.items]
        rows = [SIGNS[zlib.crc32(b"\0" + w.encode("utf-8", "surrogatepass")) % ROWS] for w in common]
        self.table = (np.concatenate([SIGNS, np.array(rows, np.int8).reshape(-1, 64)]) * np.rint(weight)[:, None]).astype(np.int16)
        self.ids_of = [self.ids(ws) for _, ws in self.items]
        self.parts = []  # (window, stride, blocks, for each print the items that have it)
        by_size: dict[tuple[int, int], list[int]] = {}
        for k, (_, ws) in enumerate(self.items):
            by_size.setdefault(size_of(len(ws), share), []).append(k)
        for (size, stride), members in sorted(by_size.items()):
            prints = [self.windows(self.ids_of[k], np.arange(len(self.ids_of[k]) - size + 1), size) for k in members]
            owner = np.repeat(members, [len(p) for p in prints])
            known, place = np.unique(np.concatenate(prints), return_inverse=True)
            pairs = np.unique(np.stack([place, owner]), axis=1)
            self.parts.append((size, stride, Blocks(known, radius), np.searchsorted(pairs[0], np.arange(len(known) + 1)), pairs[1]))
        self.shingles()
        # for every item its words by number, and itself in these numbers
        numbers = [{w: i for i, w in enumerate(dict.fromkeys(ws))} for _, ws in self.items]
        self.vocabulary = [(known, np.array([known[w] for w in ws], np.int64)) for known, (_, ws) in zip(numbers, self.items)]

    @staticmethod
    def weight(uses: int, n: int) -> float:
        return 1 + np.log2((1 + n) / max(uses, 1, (1 + n) / OFTEN))

    def ids(self, ws: list[str]) -> np.ndarray:
        """Row of the table for each word."""
        cache, common = self.cache, self.common
        out = []
        for w in ws:
            i = cache.get(w)
            if i is None:
                i = common.get(w, -1)
                if i < 0:
                    i = zlib.crc32(w.encode("utf-8", "surrogatepass")) % ROWS
                if len(cache) < 1 << 18:
                    cache[w] = i
            out.append(i)
        return np.array(out, np.int64)

    def windows(self, ids: np.ndarray, starts: np.ndarray, size: int, total: np.ndarray | None = None) -> np.ndarray:
        """SimHash of the windows at ``starts``; whole numbers, so equal windows agree wherever they stand."""
        total = self.sums(ids) if total is None else total
        return np.packbits(total[starts + size] > total[starts], axis=1).view(np.uint64).ravel()

    def sums(self, ids: np.ndarray) -> np.ndarray:
        total = np.zeros((len(ids) + 1, 64), np.int32)
        np.cumsum(self.table[ids], axis=0, out=total[1:])
        return total

    @staticmethod
    def pairs(ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * (1 << 32) + ids[1:] if len(ids) > 1 else ids.copy()

    def shingles(self) -> None:
        """Word pairs of all items: sorted values, for each its items, its weight; the weight of every item's pairs."""
        each = [np.unique(self.pairs(ids)) for ids in self.ids_of]
        values = np.concatenate(each) if each else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        order = np.argsort(values, kind="stable")
        self.shingle, first, uses = np.unique(values[order], return_index=True, return_counts=True)
        self.shingle_from = np.append(first, len(values))
        self.shingle_items = owner[order]
        # a pair that u items have weighs 1/u: what many share is no evidence for one of them
        self.shingle_weight = 1.0 / uses
        total = np.zeros(len(each))
        np.add.at(total, self.shingle_items, np.repeat(self.shingle_weight, uses))
        self.shingle_total = total

    def similarity(self, ids: np.ndarray) -> np.ndarray:
        """For every item the weighted share of its word pairs that the document holds."""
        got = np.unique(self.pairs(ids))
        at = np.searchsorted(self.shingle, got)
        at = at[self.shingle[np.minimum(at, len(self.shingle) - 1)] == got] if len(self.shingle) else at[:0]
        n = self.shingle_from[at + 1] - self.shingle_from[at]
        items = self.shingle_items[np.repeat(self.shingle_from[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.bincount(items, np.repeat(self.shingle_weight[at], n), minlength=len(self.items)) / self.shingle_total

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (document, item) that meet within the radius, of documents that end at ``ends`` of ``ids``."""
        begins = np.concatenate([[0], ends[:-1]])
        doc = np.repeat(np.arange(len(ends)), ends - begins)
        place = np.arange(len(ids)) - begins[doc]
        room = ends[doc] - np.arange(len(ids))
        total = self.sums(ids)
        out = [np.zeros((2, 0), np.int64)]
        for size, stride, blocks, first, owners in self.parts:
            starts = np.flatnonzero((place % stride == 0) & (room >= size))
            if not len(starts):
                continue
            known, back = np.unique(self.windows(ids, starts, size, total), return_inverse=True)
            at, known_at = blocks.within(known)
            if not len(at):
                continue
            met = np.unique(np.stack([at, known_at]), axis=1)  # distinct prints that meet
            low, high = np.searchsorted(met[0], [back, back + 1])
            n = high - low
            where = np.repeat(starts, n)
            prints = met[1][np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            m = first[prints + 1] - first[prints]
            items = owners[np.repeat(first[prints] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            out.append(np.unique(np.stack([doc[np.repeat(where, m)], items]), axis=1))
        return np.unique(np.concatenate(out, axis=1), axis=1)

    def stretches(self, ws: np.ndarray, k: int) -> list[list[int]]:
        """[item from, item to, document from, document to) of the runs along the diagonals that agree in most of
        their weight; parts that drift apart by a few words are joined. Sentences of one pattern with other names in
        them agree in many words and little weight. ``ws``: the document's words as places in the item's vocabulary."""
        item, weights = self.vocabulary[k][1], self.weights_of[k]
        at = np.flatnonzero(ws >= 0)
        if len(item) * len(at) == 0:
            return []
        by_word = np.argsort(item, kind="stable")
        low = np.searchsorted(item[by_word], ws[at])
        n = np.searchsorted(item[by_word], ws[at], side="right") - low
        i = by_word[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        j = np.repeat(at, n)
        order = np.lexsort((i, j - i))
        i, d = i[order], (j - i)[order]
        runs = []
        # parts of one diagonal with at most two words between matches
        cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) > 3)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(i)]])):
            if b - a >= 4:
                part = i[a:b]
                if weights[part].sum() >= AGREE * weights[part[0] : part[-1] + 1].sum():
                    runs.append([int(part[0]), int(part[-1]) + 1, int(part[0] + d[a]), int(part[-1] + d[a]) + 1])
        runs.sort()
        out: list[list[int]] = []
        for run in runs:
            for old in out:
                if -DRIFT <= run[0] - old[1] <= GAP and -DRIFT <= run[2] - old[3] <= GAP + DRIFT and run[1] > old[1]:
                    old[1], old[3] = run[1], max(old[3], run[3])
                    break
            else:
                out.append(run)
        return out

    def holds(self, text_words: list[str], k: int) -> bool:
        ws = self.items[k][1]
        if len(ws) < LEAST:
            return any(text_words[j : j + len(ws)] == ws for j in range(len(text_words) - len(ws) + 1))
        known = self.vocabulary[k][0]
        runs = self.stretches(np.array([known.get(w, -1) for w in text_words], np.int64), k)
        need = self.share * len(ws)
        if max((r[1] - r[0] for r in runs), default=0) >= need:
            return True
        for i, x in enumerate(runs):
            for y in runs[i + 1 :]:
                a, b = (x, y) if x[0] <= y[0] else (y, x)
                if a[2] < b[2] and max(b[1], a[1]) - max(b[0], a[1]) + a[1] - a[0] >= need:
                    return True
        return False

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """Word rows of whole texts, some ``STEP`` words at a time; a longer text comes in overlapping pieces."""
        longest = max((p[0] for p in self.parts), default=1)
        stride = int(np.lcm.reduce([p[1] for p in self.parts])) if self.parts else 1
        step = max(STEP // stride, -(-4 * longest // stride)) * stride
        which, rows, n = [], [], 0
        for i, text in enumerate(texts):
            ids = self.ids(words(text or ""))
            for start in range(0, max(1, len(ids) - longest + 1), step):
                part = ids[start : start + step + longest - 1]
                which.append(i)
                rows.append(part)
                n += len(part)
                if n >= STEP:
                    yield which, rows
                    which, rows, n = [], [], 0
        if rows:
            yield which, rows

    def leaked(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Sorted (place in ``texts``, place in ``items``) of the items that the texts hold."""
        met: set[tuple[int, int]] = set()
        if self.parts:
            for which, rows in self.pieces(texts):
                doc, item = self.candidates(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
                met.update((which[d], int(k)) for d, k in zip(doc, item))
        out, last, ws, alike = [], -1, [], np.zeros(0)
        for i, k in sorted(met):
            if i != last:
                last, ws = i, words(texts[i])
                alike = self.similarity(self.ids(ws))
            if (alike[k] >= SIMILAR or len(self.items[k][1]) < LEAST) and self.holds(ws, k):
                out.append((i, k))
        return out


#: The index that a worker built last, by the name of its block
BUILT: dict[str, Index] = {}


def built(name: str, block: list[tuple]) -> Index:
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Index(block)
    return BUILT[name]


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc, item) for every document that holds a share of an item's passage in one or two stretches."""
    schema = f"`{doc}` {documents.schema[doc].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    item_type = to_arrow_type(items.schema[item].dataType)
    rows = spread(documents.select(doc, text).where(f"`{text}` <> ''"), doc)
    sc = documents.sparkSession.sparkContext

    def against(block: list[tuple]) -> DataFrame:
        shared, name = sc.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built(name, shared.value)
            for batch in batches:
                found = index.leaked(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array([i for i, _ in found], pa.int64())), pa.array([index.items[k][0] for _, k in found], item_type)], names=[doc, item])

        return rows.mapInArrow(run, schema)

    out, block = None, []
    for row in items.select(item, passage).where(f"`{passage}` <> '' AND `{item}` IS NOT NULL").toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK:
            out, block = against(block) if out is None else out.unionByName(against(block)), []
    if block or out is None:
        out = against(block) if out is None else out.unionByName(against(block))
    return out
