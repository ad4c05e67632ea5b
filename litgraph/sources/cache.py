"""Keyed cache with a time to live, as a Parquet table. A key may have several values, those of its latest fetch, or a
null that says there are none; expired rows count as missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.physical import cut, place_within, written

SCHEMA = "key string, fetched timestamp, value string"


def link_key(kind: str, ids) -> object:
    """Key of one request: ``links:<kind>:<sha1 of the ids>``."""
    return F.concat(F.lit(f"links:{kind}:"), F.sha1(F.array_join(ids, ",")))


def batches(asked: DataFrame, column: str, size: int) -> DataFrame:
    """(batch, ids): the distinct ids in their order, ``size`` to a request. The order is found by range partitions."""
    one = place_within(asked.select(F.col(column).alias("id"), F.lit(0).alias("all")), "all", [F.col("id")], "at")
    return one.groupBy(F.floor((F.col("at") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def live(entries: DataFrame, ttl_days: float | None, now=None) -> DataFrame:
    """Values of the latest fetch of each key, if it is not older than ``ttl_days`` (None: never expires)."""
    latest = entries.groupBy("key").agg(F.max("fetched").alias("fetched"))
    if ttl_days is not None:
        age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("fetched")
        latest = latest.where(age <= ttl_days * 86400)
    return entries.select("key", "fetched", "value").join(latest, ["key", "fetched"], "left_semi")


class Cache:
    """``ttl_days`` 0 switches it off. A table that can't be read counts as empty."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: float | None = 30):
        self.spark, self.path, self.ttl_days = spark, path, ttl_days

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception:  # noqa: BLE001 - a missing or broken cache is a miss
            return self.spark.createDataFrame([], SCHEMA)

    def get(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(found (key, value), missing (key))."""
        if self.ttl_days == 0:
            return self.spark.createDataFrame([], "key string, value string"), keys.select("key").distinct()
        held = live(self.entries(), self.ttl_days)
        wanted = keys.select("key").distinct()
        return wanted.join(held.select("key", "value"), "key"), wanted.join(held.select("key"), "key", "left_anti")

    def put(self, values: DataFrame) -> None:
        if self.ttl_days != 0:
            values.select("key", F.current_timestamp().alias("fetched"), "value").write.mode("append").parquet(self.path)

    def through(self, keys: DataFrame, produce: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Values of ``keys``; what is missing is produced and kept, with a null where nothing came. A producer that
        fails keeps nothing."""
        found, missing = self.get(keys)
        missing = cut(missing)
        if missing.isEmpty():
            return found
        fresh = written(produce(missing).select("key", "value"))
        none = missing.join(fresh, "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"))
        self.put(fresh.unionByName(none))
        return cut(found).unionByName(fresh).unionByName(none)
