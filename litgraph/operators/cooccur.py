"""Document-level co-occurrence graph with PMI.

Mentions carry doc_seq, doc_id and term. Pairs are enumerated from one sorted array per document, after the semi-join
to the kept terms (at most ``top_terms``), so a document gives at most top_terms^2/2 pairs and the pair table has as
many rows at any corpus size. No self-join. Null terms drop out; repeated mentions count once per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..plans.physical import cut, written
from . import graph

#: Kept terms up to which the list is broadcast
BROADCAST_TERMS = 100_000


def doc_term_sets(mentions: DataFrame, keep_terms: DataFrame | None = None) -> DataFrame:
    """(doc_seq, terms): sorted distinct kept terms of documents with two or more. Without kept terms all are kept."""
    rows = mentions.where("term IS NOT NULL").select("doc_seq", "term")
    if keep_terms is not None and (n := keep_terms.count()):
        terms = keep_terms.select("term")
        rows = rows.join(F.broadcast(terms) if n <= BROADCAST_TERMS else terms, "term", "left_semi")
    return rows.groupBy("doc_seq").agg(F.array_sort(F.collect_set("term")).alias("terms")).where("size(terms) >= 2")


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, weight, first_seq) with a < b."""
    first = sets.select("doc_seq", F.posexplode("terms").alias("i", "a"), "terms").where("i + 1 < size(terms)")
    both = first.select("doc_seq", "a", F.explode(F.expr("slice(terms, i + 2, size(terms) - i - 1)")).alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("doc_seq").alias("first_seq"))


def node_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def pmi_edges(sets: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(a, b, weight, pmi, first_seq) of the pairs over both floors. The floor looks at PMI before rounding."""
    nodes = node_counts(sets)
    n = sets.agg(F.greatest(F.count("*"), F.lit(1)).cast("double")).first()[0]
    pairs = pair_counts(sets).where(F.col("weight") >= cfg.min_cooccurrence)
    a = nodes.select(F.col("term").alias("a"), F.col("count").alias("na"))
    b = nodes.select(F.col("term").alias("b"), F.col("count").alias("nb"))
    pmi = F.log((F.col("weight") / F.lit(n)) / ((F.col("na") / F.lit(n)) * (F.col("nb") / F.lit(n))))
    edges = pairs.join(a, "a").join(b, "b").withColumn("pmi", pmi)
    if cfg.min_pmi is not None:
        edges = edges.where(F.col("pmi") >= cfg.min_pmi)
    return edges.select("a", "b", "weight", F.round("pmi", 4).alias("pmi"), "first_seq")


def term_degree(edges: DataFrame) -> DataFrame:
    return graph.symmetric(edges.select("a", "b")).groupBy(F.col("a").alias("term")).agg(F.count("*").alias("degree"))


def trim(edges: DataFrame, limit: int) -> DataFrame:
    """Edges among the ``limit`` best connected nodes. Ties go to the node that the first kept edge brought first.

    The edges are read three times, so they are materialised first: as many rows as kept pairs, not as documents.
    """
    edges = cut(edges)
    end = lambda term, side: F.struct(F.col(term).alias("term"), F.struct("first_seq", "a", "b", F.lit(side).alias("side")).alias("at"))
    ends = edges.select(F.inline(F.array(end("a", 0), end("b", 1))))
    nodes = ends.groupBy("term").agg(F.count("*").alias("degree"), F.min("at").alias("at"))
    kept = cut(nodes.orderBy(F.desc("degree"), "at").limit(limit).select("term"))
    return graph.induced(edges, kept, "a", "b", "term", small=True)


def build(mentions: DataFrame, keep_terms: DataFrame | None, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(nodes (term, count), edges (a, b, weight, pmi)) after the trim."""
    sets = written(doc_term_sets(mentions, keep_terms))
    edges = trim(pmi_edges(sets, cfg), cfg.max_graph_nodes)
    return node_counts(sets), edges

