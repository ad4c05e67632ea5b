"""Lists of paper ids: from a list, a delimited string, or a file."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = r"[\s,;]+"
PREFIX = r"(?i)^pmid:?"


def parse_pmid_input(value) -> list[str]:
    """Ids in order, the first of equal ones. A string that names a file (with or without ``@``) is read from there.
    None and blanks give nothing; ids are not checked to be digits."""
    if value is None:
        return []
    if isinstance(value, str):
        path = value.removeprefix("@").strip()
        if path and (value.startswith("@") or os.path.isfile(path)):
            with open(path, encoding="utf-8") as f:
                value = f.read()
        parts = re.split(PARTS, value)
    else:
        parts = [p for v in value for p in re.split(PARTS, str(v))]
    return list(dict.fromkeys(i for i in (re.sub(PREFIX, "", p.strip()) for p in parts) if i))


def split_ids(value: Column | str) -> Column:
    """The same rule as a column: array of distinct ids in order of their first place; null gives an empty array."""
    c = F.col(value) if isinstance(value, str) else value
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), PARTS), lambda p: F.regexp_replace(p, PREFIX, ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def id_frame(spark: SparkSession, value) -> DataFrame:
    """(id, ord)"""
    return spark.createDataFrame([(x, i) for i, x in enumerate(parse_pmid_input(value))], "id string, ord bigint")
