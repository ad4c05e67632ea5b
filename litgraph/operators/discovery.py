"""A-B-C candidates: pairs of terms without an edge that share intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .graph import symmetric


def two_hop(edges: DataFrame) -> DataFrame:
    """(a, b, c, ab, bc): paths a-b-c with a <> c and no edge a-c. ``edges`` (a, b, pmi) holds each pair once.

    The edge table is bounded by the trim to max_graph_nodes, so Spark broadcasts it by its measured size.
    """
    both = symmetric(edges.select("a", "b", "pmi"))
    left = both.select("a", "b", F.col("pmi").alias("ab"))
    right = both.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("pmi").alias("bc"))
    direct = both.select("a", F.col("b").alias("c"))
    return left.join(right, "b").where("a <> c").join(direct, ["a", "c"], "left_anti")


def candidates(edges: DataFrame, cfg: Config = Config(), anchors: list[str] | None = None) -> DataFrame:
    """(concept_a, concept_c, shared_b, n_intermediates, score, direct_cooccurrence), best ``top_candidates``.

    Score: sum over b of the products of the rounded PMIs. With anchors, an anchor is always A, and of two anchors the
    one listed first; anchors that are not in the graph are skipped. Linked pairs are never candidates, so the direct
    count is 0, and a negative limit on it rejects everything. Ties: (concept_a, concept_c) ascending.
    """
    paths = two_hop(edges)
    if anchors:
        at = F.create_map(*[x for i, t in reversed(list(enumerate(anchors))) for x in (F.lit(t), F.lit(i))])
        place_a, place_c = at[F.col("a")], at[F.col("c")]
        paths = paths.where(place_a.isNotNull() & (place_c.isNull() | (place_a < place_c)))
    else:
        paths = paths.where("a < c")
    if cfg.max_direct_cooccurrence < 0:
        paths = paths.where(F.lit(False))
    found = paths.groupBy("a", "c").agg(F.sort_array(F.collect_list("b")).alias("shared_b"), F.round(F.sum(F.col("ab") * F.col("bc")), 9).alias("score"))
    found = found.where(F.size("shared_b") >= cfg.min_b_links)
    out = found.select(F.col("a").alias("concept_a"), F.col("c").alias("concept_c"), "shared_b", F.size("shared_b").alias("n_intermediates"), "score", F.lit(0).alias("direct_cooccurrence"))
    return out.orderBy(F.desc("score"), "concept_a", "concept_c").limit(cfg.top_candidates).withColumn("score", F.round("score", 4))


def export_rows(found: DataFrame) -> DataFrame:
    """As written to CSV: the first ten intermediates, joined."""
    return found.select("concept_a", "concept_c", "n_intermediates", F.array_join(F.slice("shared_b", 1, 10), "; ").alias("intermediates"), "score", "direct_cooccurrence")
