"""Several values packed in one field: one row per value, with its place in the list.

``scan`` is a finite-state tokenizer. Its state is the open quote (if any), whether the last character was an
escape, and the nesting depth of ``[]`` and ``{}``. It walks over lexemes (runs of plain characters, quotes, escapes,
brackets, delimiters) and ends a value at every delimiter outside quotes. ``split_packed`` runs it over whole columns
in Arrow batches.

Results for odd input: null, empty, blank and ``[]`` fields give no row; empty values between delimiters are skipped
and not counted; repeated values stay; an unclosed quote is an ordinary character; further columns of the input are
dropped unless named as key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.physical import spread

LEXEME = re.compile(r"""\\u[0-9a-fA-F]{4}|\\.|""|["']|[\[\]{}]|[;|\t\r\n]|,|:|\s|[^\\"'\[\]{};|\t\r\n,:\s]+""", re.S)
STRONG = frozenset(";|\t\r\n")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
BLANKS = re.compile(r"\s+")
SURROGATE = re.compile("[\ud800-\udfff]")


def unescape(lexeme: str) -> str:
    if lexeme[1] == "u" and len(lexeme) == 6:
        return chr(int(lexeme[2:], 16))
    return ESCAPES.get(lexeme[1], lexeme[1])


def last_closer(text: str, start: int, quote: str, delimiters: frozenset) -> int:
    """Last place after ``start`` where a ``quote`` can close: before a delimiter, a closing bracket, a colon, a comma or
    the end. -1 if there is none."""
    last, i, n = -1, start + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == quote:
            if quote == '"' and text[i + 1 : i + 2] == quote:
                i += 2
                continue
            j = i + 1
            while j < n and text[j] == " ":
                j += 1
            if j == n or text[j] in delimiters or text[j] in "]}:,":
                last = i
        i += 1
    return last


def scan(text: str, delimiters: frozenset) -> list[tuple[str, bool]]:
    """Values of ``text`` with a flag for those that were quoted. Keys of ``{"key": value}`` are dropped."""
    out: list[tuple[str, bool]] = []
    buf: list[str] = []
    quote, quoted, depth = "", False, 0
    last: dict[str, int] = {}  # of each quote, found once
    nested = text.lstrip()[:1] in ("[", "{")

    def end() -> None:
        nonlocal quoted
        value = "".join(buf)
        if SURROGATE.search(value):  # escaped in halves; a half alone is no character
            value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        buf.clear()
        if quoted or value.strip():
            out.append((value, quoted))
        quoted = False

    for m in LEXEME.finditer(text):
        x = m.group()
        c = x[0]
        if quote:
            if c == "\\" and len(x) > 1:
                buf.append(unescape(x))
            elif x == quote:
                quote = ""
            elif x == '""' and quote == '"':
                if not buf and text[m.end() : m.end() + 1] in ("", ",", ";", "]", " "):
                    quote = ""
                else:
                    buf.append('"')
            else:
                buf.append(x)
        elif c in "\"'" and not buf and not quoted and (x == '""' or m.start() < (last[c] if c in last else last.setdefault(c, last_closer(text, m.start(), c, delimiters)))):
            quoted = True
            quote = "" if x == '""' else c
        elif nested and c in "[{":
            depth += 1
        elif nested and c in "]}" and depth:
            end()
            depth -= 1
        elif nested and c == ":" and quoted:
            buf.clear()
            quoted = False
        elif c in delimiters or (nested and c == ","):
            end()
        elif c == "\\" and len(x) > 1:
            buf.append(unescape(x))
        elif not (c.isspace() and (quoted or not buf)):
            buf.append(x)
    end()
    return out


ID_DELIMITERS = frozenset(";|,[]{} \t\r\n ")
DIGITS = re.compile(r"\d+")


def ids(text: str | None) -> list[str]:
    """The ids of a packed list, as their digits; labels such as ``PMID:`` fall away."""
    if not text:
        return []
    found = (DIGITS.search(v) for v, _ in scan(text.strip().strip("[]"), ID_DELIMITERS))
    return [m.group() for m in found if m]


INITIALS = re.compile(r"(?:[^\W\d_]\.?[ -]?){1,4}")
JOINED = re.compile(r"\s+(?:and|&)\s+", re.I)
LEADING_JOIN = re.compile(r"^(?:and\s+|&\s*)", re.I)


def tidy(value: str) -> str:
    return BLANKS.sub(" ", value).strip()


def is_initials(part: str) -> bool:
    return bool(INITIALS.fullmatch(part)) and sum(map(str.isalpha, part)) <= 3 and ("." in part or part.isupper())


def names(text: str | None) -> list[str]:
    """The people of a packed list.

    A delimiter other than the comma, outside quotes, makes commas part of the names ("Last, First; ..."). Otherwise
    commas divide, unless every second part is initials ("Last, F. M., Last, F."), there are just two single words, or
    words that join leave one comma in every piece ("Last, First and Last, First"). Words that join ("and", "&")
    divide as well.
    """
    if not text or not text.strip():
        return []
    if text.lstrip()[0] in "[{":
        return [v for v in (tidy(x) for x, _ in scan(text, frozenset(","))) if v and v.lower() != "null"]
    values = scan(text, STRONG)
    if len(values) > 1 or any(c in text for c in STRONG):
        if not (len(values) == 1 and values[0][1]):
            return join_free([(tidy(LEADING_JOIN.sub("", x.strip())), q) for x, q in values])
    joined = [x.strip().strip(",") for x in JOINED.split(text)]
    if len(joined) > 1 and '"' not in text and all(x.count(",") == 1 for x in joined):
        return [tidy(x) for x in joined]
    parts = [(LEADING_JOIN.sub("", x.strip()), q) for x, q in scan(text, frozenset(","))]
    flat = join_free([(tidy(x), q) for x, q in parts])
    plain = not any(q for _, q in parts)
    if plain and len(flat) > 1 and len(flat) % 2 == 0:
        if all(is_initials(x) for x in flat[1::2]) and not any(is_initials(x) for x in flat[::2]):
            return [f"{a}, {b}" for a, b in zip(flat[::2], flat[1::2])]
        if len(flat) == 2 and all(" " not in x for x in flat) and "," in text and not JOINED.search(text):
            return [f"{flat[0]}, {flat[1]}"]
    return flat


def join_free(values: list[tuple[str, bool]]) -> list[str]:
    out: list[str] = []
    for value, quoted in values:
        out += [v for v in ([value] if quoted else (tidy(x) for x in JOINED.split(value))) if v]
    return out


def split_packed(df: DataFrame, key: str, splitters: dict[str, Callable[[str | None], list[str]]]) -> DataFrame:
    """(key, field_name, pos, item_value) for every value of the columns that ``splitters`` names.

    Narrow: one pass over the rows, no shuffle beyond ``spread`` on inputs of few splits.
    """
    kind = df.schema[key].dataType
    columns = list(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in columns:
                rows, values, places = [], [], []
                for i, text in enumerate(batch.column(column).to_pylist()):
                    got = splitters[column](text)
                    values += got
                    rows += [i] * len(got)
                    places += range(1, len(got) + 1)
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(key).take(pa.array(rows, pa.int64())), pa.array([column] * len(rows), pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string())],
                        names=[key, "field_name", "pos", "item_value"],
                    )

    slim = spread(df.select(key, *columns), key)
    return slim.mapInArrow(run, f"`{key}` {kind.simpleString()}, field_name string, pos int, item_value string")


def split_arrays(df: DataFrame, keep: list[str], splitters: dict[str, Callable[[str | None], list[str]]]) -> DataFrame:
    """The columns ``keep`` and, for every column of ``splitters``, the array of its values. Narrow like the above."""
    columns = [*keep, *splitters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [pa.array([f(text) for text in batch.column(c).to_pylist()], pa.list_(pa.string())) for c, f in splitters.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=columns)

    slim = spread(df.select(*columns), keep[0])
    kinds = [f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` array<string>" for c in splitters]
    return slim.mapInArrow(run, ", ".join(kinds))


PAPER_FIELDS = {"authors": names, "refs": ids, "cited_by": ids}


def packed_values(papers: DataFrame) -> DataFrame:
    return split_packed(papers, "rec_id", PAPER_FIELDS)
