"""Frequency of every distinct term: heavy-light aggregation.

One pass over the rows normalises terms and removes what was delivered twice; it leaves (document, term, times), which is
written once. Heavy terms are found on it by a mergeable frequent-items sketch, whose result is at most ``HEAVY`` terms,
whatever the input. Rows of heavy terms never shuffle by term: they are added up in one fixed array of counters per
task. Only rows of the remaining terms are shuffled by term. Both count tables are exact; the sketch only decides the
route.

Input rows may be null, blank or repeated: a null document, a null term and a term that is empty once normalised drop
out; a row delivered twice (same document, place and term) counts once, and a null place counts as one place of its
own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_term
from ..plans.physical import written

HEAVY = 32
TRACKED = 4096


def normal_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.select("doc_id", "pos", normal_term("term").alias("term")).where("doc_id IS NOT NULL AND term <> ''")


def per_document(mentions: DataFrame) -> DataFrame:
    """(doc_id, term, tf). One exchange: both groupings find their rows where (document, term) puts them, so neither a
    term nor a document of a third of all rows ends in one task."""
    rows = normal_mentions(mentions).repartition("doc_id", "term")
    return rows.groupBy("doc_id", "term", "pos").agg(F.lit(1).alias("one")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def heavy_terms(rows: DataFrame, heavy: int = HEAVY) -> list[str]:
    """At most ``heavy`` terms that may hold over half a percent of the rows."""
    got = rows.agg(F.expr(f"approx_top_k(term, {heavy}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    floor = (got["n"] or 0) / 200
    return [x["item"] for x in (got["top"] or []) if x["count"] > floor]


def counted(times: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(term, corpus_count, doc_freq) from (doc_id, term, tf)."""
    top = heavy_terms(times, heavy)
    in_top = F.col("term").isin(top) if top else F.lit(False)
    light = times.where(~in_top).groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("doc_freq"))
    if not top:
        return light
    at = F.create_map(*[x for i, t in enumerate(top) for x in (F.lit(t), F.lit(i))])
    counters = times.where(in_top).select("tf", at[F.col("term")].alias("h")).agg(
        *[F.sum(F.when(F.col("h") == i, F.col("tf"))).alias(f"n{i}") for i in range(len(top))],
        *[F.count_if(F.col("h") == i).alias(f"d{i}") for i in range(len(top))],
    )
    one = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("corpus_count"), F.col(f"d{i}").alias("doc_freq")) for i, t in enumerate(top)])
    exact = counters.select(F.inline(one)).where("doc_freq > 0")
    return light.unionByName(exact)


def term_frequency(mentions: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(term, corpus_count, doc_freq) for every distinct term."""
    return counted(written(per_document(mentions)), heavy)


def marked(mentions: DataFrame) -> DataFrame:
    """Every term with ``mark``: rare (one document), common (over a third of the documents) or null.

    Where all documents number at most two, a term can be both; it is then rare.
    """
    times = written(per_document(mentions))
    n = times.select("doc_id").distinct().count()
    mark = F.when(F.col("doc_freq") == 1, "rare").when(F.col("doc_freq") * 3 > n, "common")
    return counted(times).withColumn("mark", mark)
