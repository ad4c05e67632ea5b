"""Links from a service, read through the cache.

``fetch`` takes the ids it is asked for as (id) and gives (pmid, other, link, source). A link is one JSON value, an id
without links a null value; so no cell grows with the links of an id. A fetch that fails keeps nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from .cache import Cache, link_key

ROW = "pmid string, other string, link string, source string"


def fetched_links(spark: SparkSession, ids: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str, cfg: Config = Config()) -> DataFrame:
    """(pmid, other, link, source) of ``ids`` (id); held ``citation_cache_days`` (0: not at all)."""
    key = lambda c: link_key(cfg.expand_source, F.array(c))
    asked = ids.where("id IS NOT NULL").select("id", key("id").alias("key")).distinct()

    def produce(missing: DataFrame) -> DataFrame:
        rows = fetch(missing.join(asked, "key").select("id"))
        return rows.select(key("pmid").alias("key"), F.to_json(F.struct("pmid", "other", "link", "source")).alias("value"))

    held = Cache(spark, path, cfg.citation_cache_days).through(asked.select("key"), produce)
    return held.where("value IS NOT NULL").select(F.from_json("value", ROW).alias("r")).select("r.*")


def cached(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], path: str, cfg: Config = Config()) -> Callable[[DataFrame], DataFrame]:
    """``fetch`` behind the cache: what expansions take as ``links`` in place of a table."""
    return lambda ids: fetched_links(spark, ids, fetch, path, cfg)
