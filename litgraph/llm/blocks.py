"""All pairs of rows that share a key, block against block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """(keys, <column>_x, <column>_y) of every two rows of different ``item`` that share the keys, each pair once.

    A row of a key with n rows goes to every pair of its ceil(n / block) blocks that holds its own, so no group of the
    join has more than two blocks. Where no key has more rows than a block, they are joined as they are.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    rest = [c for c in rows.columns if c not in keys]
    side = lambda df, s, *more: df.select(*keys, *more, *(F.col(c).alias(f"{c}_{s}") for c in rest))
    if (counts.agg(F.max("n")).first()[0] or 0) <= block:
        return side(rows, "x").join(side(rows, "y"), keys).where(f"{item}_x < {item}_y")
    placed = rows.join(counts.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("__k")), keys).withColumn("__own", F.pmod(F.xxhash64(item), "__k").cast("int"))
    met = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    met = met.withColumn("__low", F.least("__own", "__other")).withColumn("__high", F.greatest("__own", "__other"))
    x, y = side(met.where("__own = __low"), "x", "__low", "__high"), side(met.where("__own = __high"), "y", "__low", "__high")
    return x.join(y, [*keys, "__low", "__high"]).where(f"{item}_x < {item}_y OR (__low < __high AND {item}_x <> {item}_y)").drop("__low", "__high")
