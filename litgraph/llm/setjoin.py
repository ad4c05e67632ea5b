"""All similar pairs between set-valued records: recursive chosen-path splitting.

Equal sets collapse to one class first. In each of ``TREES`` trees every set goes down the branches of the tokens that a
random hash of (node, token) chooses, each with probability ``BRANCH``/size: two similar sets share a branch with a
probability that the similarity bounds, dissimilar ones hardly ever. A token leads a path down only once. Nodes of at
most ``SMALL`` sets are compared by brute force, larger ones are split again on other tokens, so a token of most records
only costs further levels: as many as it takes, up to some log2 of the number of sets. Only node, sketch and path go
from level to level; tokens are fetched for the sets of large nodes. A large node whose sets are alike on average, as
their sketches tell, needs no splitting, since most of its pairs are results; it is compared in blocks of bounded size,
as is what is large after the last level. Nothing is left out.
Comparison starts with sizes and 128-bit one-bit minhash sketches (bound five deviations off); what passes is verified
exactly on the sets.

Within one table the pairs are of distinct classes; ``similar_papers`` adds the copies.
Sets of fewer than ``least`` values, null and empty fields give no pair; repeated values count once; a key in several
rows keeps its largest set; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packed import ids
from ..plans.physical import cut, spread, written

THRESHOLD, LEAST = 0.6, 5
TREES, SMALL = 8, 48
#: Levels beyond log2 of the number of sets
MORE_LEVELS = 2
#: Sets of a large node that are compared in one block, and the average similarity from which a node is not split
ALIKE_BLOCK, ALIKE = 192, 0.5
#: Branches chosen per set on the first level, and on later ones
BRANCH = (3.0, 2.0)
SKETCH_BITS = 128
SCALE = 1 << 40
#: Most nodes whose list is broadcast (8 bytes each)
BROADCAST_NODES = 200_000
#: Copies of one set up to which all their pairs are written; further ones are linked to the smallest key of the class
COPIES = 64

RNG = np.random.default_rng(20240229)
FACTORS = RNG.integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = RNG.integers(0, 1 << 63, SKETCH_BITS, dtype=np.uint64)


#: For each tree what its first branches are drawn with
TREE_FACTORS = RNG.integers(1, 1 << 63, TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TREE_OFFSETS = RNG.integers(0, 1 << 63, TREES, dtype=np.uint64)


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """One bit of the least value of each of 128 hash functions over the set, as two signed words."""
    mixed = hashes[:, None] * FACTORS + OFFSETS
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bits = (mixed.min(axis=0) >> np.uint64(7)) & np.uint64(1)
    return tuple(int(x) for x in np.packbits(bits.astype(np.uint8)).view(np.int64))


def first_branches(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their tokens) of the first level of all trees."""
    mixed = codes.view(np.uint64) * TREE_FACTORS[:, None] + TREE_OFFSETS[:, None]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    tree, token = np.nonzero((mixed >> np.uint64(24)).astype(np.float64) * len(codes) < BRANCH[0] * SCALE)
    return mixed[tree, token].view(np.int64), codes[token]


SETS = "field_name string, `{key}` {kind}, size int, tokens array<string>, s0 bigint, s1 bigint, codes array<bigint>, roots array<bigint>, root_codes array<bigint>"


def set_rows(df: DataFrame, key: str, fields: list[str], values: Callable = ids, least: int = LEAST) -> DataFrame:
    """(field_name, key, size, tokens, s0, s1, codes, roots, root_codes) for every row and field with at least ``least``
    distinct values: the set, its sketch, its tokens as hashes that differ between fields, and its first branches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in fields:
                at, sizes, tokens, s0, s1, codes, roots, root_codes = [], [], [], [], [], [], [], []
                salt = np.uint64(token_hash("\0" + field))
                for i, packed in enumerate(batch.column(field).to_pylist()):
                    got = sorted(set(values(packed)))
                    if len(got) < least:
                        continue
                    hashes = np.array([token_hash(t) for t in got], np.uint64)
                    a, b = sketch(hashes)
                    codes.append((hashes ^ salt).view(np.int64))
                    nodes, chosen_codes = first_branches(codes[-1])
                    roots.append(nodes)
                    root_codes.append(chosen_codes)
                    at.append(i)
                    sizes.append(len(got))
                    tokens.append(got)
                    s0.append(a)
                    s1.append(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * len(at), pa.string()), batch.column(key).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.string())), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (codes, roots, root_codes))],
                    names=["field_name", key, "size", "tokens", "s0", "s1", "codes", "roots", "root_codes"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(key, *fields).where(F.col(key).isNotNull()), key)
    return rows.mapInArrow(run, SETS.format(key=key, kind=kind))


def classes(rows: DataFrame, key: str) -> DataFrame:
    """(field_name, key, cid): the class of equal sets each key belongs to; ``cid`` hashes field and set in 256 bits."""
    one = rows.select("field_name", key, "size", F.sha2(F.concat_ws("\0", "field_name", "tokens"), 256).alias("cid"))
    return one.groupBy("field_name", key).agg(F.max(F.struct("size", "cid"))["cid"].alias("cid"))


def chosen(branch: float):
    """(node, path) of the branches that a set in a node goes down; ``codes`` are its tokens."""
    left = F.array_except("codes", "path")
    taken = F.filter(left, lambda t: F.pmod(F.xxhash64("node", t), F.lit(SCALE)) * F.greatest(F.size("codes") - F.size("path"), F.lit(1)) < F.lit(branch * SCALE))
    return F.inline(F.transform(taken, lambda t: F.struct(F.xxhash64("node", t).alias("node"), F.array_append("path", t).alias("path"))))


def alike_nodes(frontier: DataFrame) -> DataFrame:
    """Nodes of the frontier whose sets agree on average in ALIKE of their values.

    Of two sets of similarity J a bit of their sketches agrees with probability (1 + J) / 2; the mean over all pairs of
    a node follows from how many of its sets have the bit.
    """
    ones = [F.sum(F.shiftright("s0", i).bitwiseAND(1)) / F.count("*") for i in range(32)]
    match = sum((p * p + (1 - p) * (1 - p) for p in ones), F.lit(0.0)) / len(ones)
    return frontier.groupBy("node").agg((2 * match - 1).alias("j")).where(F.col("j") >= ALIKE).select("node")


def compare(groups: DataFrame, threshold: float, two_sided: bool = False) -> DataFrame:
    """Candidate pairs of bounded groups ``m`` of structs."""
    far = int(SKETCH_BITS * (1 - threshold) / 2 + 5 * (SKETCH_BITS * (1 + threshold) / 2 * (1 - threshold) / 2) ** 0.5)
    x = groups.select(F.posexplode("m").alias("i", "x"), "m").where("i + 1 < size(m)")
    y = x.select("x", F.explode(F.expr("slice(m, i + 2, size(m) - i - 1)")).alias("y"))
    ok = (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size")) & (
        F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) <= far
    )
    if two_sided:
        ok &= (F.col("x.blk") != F.col("y.blk")) | F.col("x.same")
    return y.where(ok).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))


def in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of nodes of any size ``n``: blocks of sets within a node, every block against every block."""
    blocks = rows.withColumn("k", F.ceil(F.col("n") / ALIKE_BLOCK)).withColumn("blk", F.pmod(F.xxhash64("sid", "node"), F.col("k")))
    meet = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    keyed = meet.select("node", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), F.struct("sid", "size", "s0", "s1", "blk", (F.col("blk") == F.col("other")).alias("same")).alias("r"))
    return compare(keyed.groupBy("node", "lo", "hi").agg(F.collect_list("r").alias("m")).where("size(m) > 1"), threshold, two_sided=True)


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of all pairs of ``sets`` (as of ``distinct_sets``) at Jaccard ``threshold`` or more."""
    levels = max(2, sets.count().bit_length() + MORE_LEVELS)
    found, frontier = [], None
    for level in range(levels):
        if frontier is None:
            nodes = sets.select("sid", "size", "s0", "s1", F.inline(F.arrays_zip(F.col("roots").alias("node"), F.transform("root_codes", lambda t: F.array(t)).alias("path"))))
        else:
            nodes = written(frontier.join(sets.select("sid", "codes"), "sid").select("sid", "size", "s0", "s1", chosen(BRANCH[1])))
        large = cut(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > SMALL))
        many = large.count()
        listed = F.broadcast(large) if many <= BROADCAST_NODES else large
        small = nodes.join(listed, "node", "left_anti") if many else nodes
        found.append(compare(small.groupBy("node").agg(F.collect_list(F.struct("sid", "size", "s0", "s1")).alias("m")).where("size(m) > 1"), threshold))
        if not many:
            break
        frontier = written(nodes.join(listed, "node"))
        if not level:
            continue  # what shares one token is hardly alike
        alike = cut(alike_nodes(frontier))
        if not alike.isEmpty():
            found.append(in_blocks(frontier.join(alike, "node", "left_semi"), threshold))
            frontier = frontier.join(alike, "node", "left_anti")
            if frontier.isEmpty():
                break
    else:
        found.append(in_blocks(frontier, threshold))

    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    pairs = candidates.distinct()
    whole = sets.select("sid", "cid", "tokens", "size")
    left = pairs.join(whole.select(F.col("sid").alias("a"), F.col("cid").alias("cid_a"), F.col("tokens").alias("ta"), F.col("size").alias("na")), "a")
    both = left.join(whole.select(F.col("sid").alias("b"), F.col("cid").alias("cid_b"), F.col("tokens").alias("tb"), F.col("size").alias("nb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    # in whole numbers, so that a similarity of just the threshold counts
    return both.where(shared * 1000 >= F.lit(round(threshold * 1000)) * (F.col("na") + F.col("nb") - shared)).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per class, numbered."""
    cid = F.sha2(F.concat_ws("\0", "field_name", "tokens"), 256)
    one = rows.withColumn("cid", cid).groupBy("cid").agg(*(F.any_value(c).alias(c) for c in ("field_name", "size", "tokens", "s0", "s1", "codes", "roots", "root_codes")))
    return written(one.withColumn("sid", F.monotonically_increasing_id()))


def similar_papers(papers: DataFrame, key: str = "pmid", fields: tuple = ("refs", "cited_by"), values: Callable = ids, copies: int | None = COPIES) -> DataFrame:
    """(field_name, pmid_a, pmid_b) of all papers whose sets in one field are similar.

    Of copies of one set all pairs come up to ``copies`` of them (None: always, m * (m - 1) / 2 rows for m copies). Of a
    larger class of m each other member comes with the smallest key: m - 1 rows. That key stands for all m in
    pairs with other classes, so one row there stands for m (or m * m') pairs; ``paper_classes`` has the members.
    """
    rows = written(set_rows(papers, key, list(fields), values))
    members = classes(rows, key)
    sized = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min(key).alias("first"))
    members = cut(members.join(sized, "cid").withColumnRenamed(key, "k"))
    pairs = similar_sets(distinct_sets(rows))
    few = F.lit(True) if copies is None else F.col("copies") <= copies
    speak = members.where(few | (F.col("k") == F.col("first"))).select("cid", "field_name", "k")
    across = pairs.join(speak.select(F.col("cid").alias("a"), "field_name", F.col("k").alias("ka")), "a").join(speak.select(F.col("cid").alias("b"), F.col("k").alias("kb")), "b")
    same = members.where((F.col("copies") > 1) & few).select("cid", "field_name", "k")
    alike = same.select("cid", "field_name", F.col("k").alias("ka")).join(same.select("cid", F.col("k").alias("kb")), "cid").where("ka < kb")
    many = members.where(~few & (F.col("k") != F.col("first"))).select("field_name", F.col("first").alias("ka"), F.col("k").alias("kb"))
    out = across.select("field_name", "ka", "kb").unionByName(alike.select("field_name", "ka", "kb")).unionByName(many)
    return out.select("field_name", F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()


def paper_classes(papers: DataFrame, key: str = "pmid", fields: tuple = ("refs", "cited_by")) -> DataFrame:
    """(field_name, key, class_key, copies): the smallest key with the same set, and how many keys have it."""
    members = cut(classes(set_rows(papers, key, list(fields)), key))
    sized = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min(key).alias("class_key"))
    return members.join(sized, "cid").select("field_name", key, "class_key", "copies")
