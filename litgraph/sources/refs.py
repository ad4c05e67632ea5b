"""Reference-manager exports: RIS and EndNote XML.

``read_refs`` reads whole files in the executors and gives (doc_seq, doc_id, title, text, source, pmid, doi, url).
``LAYOUT`` says where each column is in either format; both readers only follow it. Records with neither title nor
abstract are dropped but counted in the numbering. An unknown format or broken XML is an error that names the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Place(NamedTuple):
    """RIS tags in order of preference, whether all values of the tag count or its first, path in an XML record."""

    tags: tuple[str, ...]
    every: bool
    path: str


#: The columns in RIS and in EndNote XML.
LAYOUT = {
    "title": Place(("TI", "T1"), False, "titles/title"),
    "text": Place(("AB", "N2"), True, "abstract"),
    "pmid": Place(("AN",), False, "accession-num"),
    "doi": Place(("DO",), False, "electronic-resource-num"),
    "url": Place(("UR",), False, "urls/related-urls/url"),
}
#: Fixed value: a tagged line of RIS.
FIELD = re.compile(r"^([A-Z][A-Z0-9]) {1,2}-[^\S\n]?(.*)$", re.M)
MARK = "﻿"


def sniff(path: str, text: str) -> str:
    """``xml`` or ``ris``: by marks of XML at the head, then by an opening RIS tag, then by the file's ending."""
    head = text.lstrip(MARK + " \t\r\n")[:512].lower()
    ending = path.lower().rpartition(".")[2]
    for format, said in (("xml", head.startswith("<?xml") or "<records>" in head or "<xml>" in head), ("ris", re.search(r"(?m)^TY {1,2}-\s", text)), ("xml", ending == "xml"), ("ris", ending in ("ris", "txt"))):
        if said:
            return format
    raise ValueError(f"cannot tell the format of {path}: expected RIS or EndNote XML")


def ris_rows(text: str) -> Iterator[dict[str, str]]:
    """One row per record. Lines without a tag go on the value before them; a record begins with TY, after ER, and with
    the first tag; what has no tag but ER is no record."""
    lines = "\n".join(text.lstrip(MARK).splitlines())
    marks = list(FIELD.finditer(lines))
    ends = [m.start() for m in marks[1:]] + [len(lines)]
    tags = [m[1] for m in marks]
    values = [" ".join(filter(None, [m[2].strip(), *map(str.strip, lines[m.end() : end].split("\n"))])) for m, end in zip(marks, ends)]
    numbers = accumulate(int(tag == "TY" or before == "ER") for tag, before in zip(tags, ["ER", *tags]))
    for _, fields in groupby(zip(numbers, tags, values), key=lambda f: f[0]):
        of: dict[str, list[str]] = {}
        for _, tag, value in fields:
            of.setdefault(tag, []).append(value)
        of.pop("ER", None)
        if of:
            yield {column: ris_value(of, place) for column, place in LAYOUT.items()}


def ris_value(of: dict[str, list[str]], place: Place) -> str:
    given = next((of[tag] for tag in place.tags if tag in of), [""])
    return " ".join(given).strip() if place.every else given[0]


def xml_rows(text: str) -> Iterator[dict[str, str]]:
    """One row per ``record`` element; of elements at one path the first counts, with its text at any depth."""
    columns = {place.path: column for column, place in LAYOUT.items()}
    events = ElementTree.XMLPullParser(("start", "end"))
    events.feed(text.lstrip(MARK))
    events.close()
    above: list[str] = []
    row: dict[str, str] = {}
    for event, element in events.read_events():
        if event == "start":
            above.append(element.tag)
            continue
        if "record" in above:
            path = "/".join(above[above.index("record") + 1 :])
            if path in columns:
                row.setdefault(columns[path], " ".join("".join(element.itertext()).split()))
        if above.pop() == "record":
            yield {column: row.get(column, "") for column in LAYOUT}
            row = {}
            element.clear()


def parse_refs(path: str, text: str) -> list[dict]:
    try:
        rows: Iterable[dict[str, str]] = list(xml_rows(text) if sniff(path, text) == "xml" else ris_rows(text))
    except ElementTree.ParseError as broken:
        raise ValueError(f"{path} is not well-formed XML: {broken}") from broken
    out = []
    for i, row in enumerate(rows):
        if row["title"] or row["text"]:
            pmid = row["pmid"] if row["pmid"].isdigit() else ""
            out.append({"doc_seq": i, "doc_id": f"PMID:{pmid}" if pmid else f"ref:{i}", "source": "refs", **row, "pmid": pmid})
    return out


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """One or many files. ``path`` may be a folder or pattern; doc_seq counts within each file."""
    files = spark.read.text(path, wholetext=True).selectExpr("value", "input_file_name() AS path")
    columns = ["path", "doc_seq", "doc_id", "title", "text", "source", "pmid", "doi", "url"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"path": p, **r} for p, v in zip(pdf["path"], pdf["value"]) for r in parse_refs(p, v)]
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, "path string, doc_seq bigint, doc_id string, title string, text string, source string, pmid string, doi string, url string")
