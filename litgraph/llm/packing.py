"""Filling fixed-capacity containers: sum-of-squares online packing.

Each document goes into the open fill level that leaves the least sum of squared counts of partly filled containers,
kept in one array of counts by level. Texts longer than a container are cut at token boundaries into full containers
and one rest; nothing else is cut. Documents are packed in bins of hash partitions, all of them at once; every
partition ends with a few partly filled containers, so the space left over falls with the documents per partition.

Tokens are ``\\w+|[^\\w\\s]+`` (Unicode). Null and empty texts, and texts of blanks only, hold no token and take no
container. Repeated texts are packed each. A null document id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import cut, spread

CAPACITY = 1024
#: Documents a packing partition aims at
PER_PARTITION = 50_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Characters that are tokenized at a time; cuts fall on whitespace, so no token is divided
CHUNK = 1 << 20
BLANK = re.compile(r"\s")


def count_tokens(text: str) -> int:
    n, start = 0, 0
    while len(text) - start > CHUNK:
        gap = BLANK.search(text, start + CHUNK)
        if gap is None:
            break
        n += len(TOKEN.findall(text, start, gap.start()))
        start = gap.start()
    return n + len(TOKEN.findall(text, start))


def token_counts(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_tokens) of all rows with at least one token. Narrow."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(t) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    rows = spread(documents.select(key, column).where(f"`{column}` <> ''"), key)
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint").where("n_tokens > 0")


class SumOfSquares:
    """Online packer. ``levels[h]`` counts the open containers filled to h; their numbers are stacked in ``open[h]``."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before) for an item of 1..capacity."""
        top = self.capacity - size
        # moving a container from h to h + size changes the sum of squares by 2 * (levels[h + size] - levels[h]) + 2;
        # a full container no longer counts, a new one adds 2 * levels[size] + 1
        h, container = 0, -1
        best = 2 * self.levels[size] + 1 if size < self.capacity else 0
        if top > 0:
            change = 2 * (self.levels[size + 1 : self.capacity + 1] - self.levels[1 : top + 1]) + 2
            change[-1] = 1 - 2 * self.levels[top]
            change[self.levels[1 : top + 1] == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
            if change[at] <= best:
                h = at + 1
        if h:
            container = self.open[h].pop()
            self.levels[h] -= 1
        else:
            container = self.used
            self.used += 1
        if h + size < self.capacity:
            self.levels[h + size] += 1
            self.open[h + size].append(container)
        return container, h


def packed(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first_token, n_tokens, partition, container, start): every piece of every document once.

    ``start`` is the token of the container the piece begins at. A container is named by (partition, container).
    """
    kind = counts.schema[key].dataType.simpleString()
    counts = cut(counts)
    partitions = max(1, -(-counts.count() // PER_PARTITION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(capacity)
        for batch in batches:
            rows, pieces, firsts, sizes, parts, bins, starts = [], [], [], [], [], [], []
            part = batch.column("partition").to_pylist()
            for i, n in enumerate(batch.column("n_tokens").to_pylist()):
                for piece, first in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - first)
                    container, start = packer.place(size)
                    rows.append(i)
                    pieces.append(piece)
                    firsts.append(first)
                    sizes.append(size)
                    parts.append(part[i])
                    bins.append(container)
                    starts.append(start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (pieces, firsts, sizes, parts, bins, starts))],
                names=[key, "piece", "first_token", "n_tokens", "partition", "container", "start"],
            )

    placed = counts.repartition(partitions, F.coalesce(F.xxhash64(key), F.lit(0))).withColumn("partition", F.spark_partition_id().cast("bigint"))
    ordered = placed.sortWithinPartitions(F.xxhash64(key), key, "n_tokens")
    return ordered.mapInArrow(run, f"`{key}` {kind}, piece bigint, first_token bigint, n_tokens bigint, partition bigint, container bigint, start bigint")


def must_split(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents that the packer cuts: those whose pieces number more than one."""
    return packed(token_counts(documents), capacity=capacity).where("piece = 1").select("doc_id")
