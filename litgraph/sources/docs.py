"""Corpus assembly: documents from texts, tables, id lists and reference files, one after the other."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import pmid_of
from ..operators import expansion, graph
from .ids import id_frame
from .refs import read_refs

COLUMNS = ("doc_id", "title", "text", "source", "pmid", "journal", "year", "url")


def documents_from_texts(spark: SparkSession, texts: list[str], prefix: str = "doc") -> DataFrame:
    rows = [(i, f"{prefix}{i}", "", t, "text") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_seq bigint, doc_id string, title string, text string, source string")


def from_table(documents: DataFrame) -> DataFrame:
    """Documents table as a corpus: id ``PMID:<pmid>`` where there is one, else ``ref:<doc_id>``."""
    pmid = F.nullif(F.trim("pmid"), F.lit(""))
    return documents.select(
        F.col("doc_id").alias("doc_seq"),
        F.when(pmid.isNotNull(), F.concat(F.lit("PMID:"), pmid)).otherwise(F.concat(F.lit("ref:"), F.col("doc_id").cast("string"))).alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        "source",
        pmid.alias("pmid"),
        "journal",
        F.col("pub_year").alias("year"),
    )


def fetch_by_ids(library: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the library by pmid, in order of ``ids`` (id, ord); the first of equal ones, without empty texts."""
    asked = library.withColumn("id", pmid_of()).where("id IS NOT NULL AND trim(text) <> ''").join(ids.select("id", "ord"), "id")
    return graph.first_wins(asked, "id", "doc_seq").drop("id")


def search(library: DataFrame, query: str, limit: int) -> DataFrame:
    """An offline stand-in for a search service: documents whose title or text holds the words of the query.

    Words next to each other and AND ask for all of them, OR for either side, NOT for the absence of the next word; a
    quoted phrase is one word. AND binds closer than OR.
    """
    both = F.lower(F.concat_ws(" ", "title", "text"))
    either = None
    for side in re.split(r"\bOR\b(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", query):
        hit, absent = None, False
        for phrase, word in re.findall(r'"([^"]*)"|(\S+)', side):
            if word == "NOT":
                absent = True
            elif word != "AND":
                has = F.contains(both, F.lit((phrase or word).lower()))
                hit = (~has if absent else has) if hit is None else hit & (~has if absent else has)
                absent = False
        if hit is not None:
            either = hit if either is None else either | hit
    return library.where(F.lit(True) if either is None else either).orderBy("doc_seq").limit(limit)


#: ``doc_seq`` holds the part in its upper bits and the place within the part in the lower ones
PLACE_BITS = 48
#: Part of documents that an expansion adds behind loaded ones
ADDED = 1 << 10


def part_of(doc_seq: str) -> Column:
    return F.shiftright(doc_seq, PLACE_BITS).cast("int")


def placed(doc_seq: Column, part: int) -> Column:
    """``doc_seq`` of a place within a part: sortable over all parts, a bigint. Places are taken as they come."""
    return (doc_seq.cast("bigint") + F.lit(part << PLACE_BITS)).alias("doc_seq")


def stacked(parts: list[DataFrame], first: int = 0) -> DataFrame:
    """Parts in order, numbered from ``first``; no row of different parts is merged."""
    out = None
    for k, p in enumerate(parts, first):
        have = [F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
        rows = p.select(placed(F.col("doc_seq"), k), *[c.cast("string") for c in have])
        out = rows if out is None else out.unionByName(rows)
    return out


def load_documents(spark: SparkSession, *, library: DataFrame | None = None, query: str | None = None, pmids=None, refs: str | None = None, texts: list[str] | None = None, links=None, cfg: Config = Config()) -> DataFrame:
    """Query, ids, reference file, texts: in this order. With ``expand_rounds`` and the plain strategy, what the search
    over ``links`` reaches is fetched from the library and added behind.

    ``library`` stands for the services the documents would come from: a table of documents as ``from_table`` gives.
    """
    parts = []
    if query:
        parts.append(search(library, query, cfg.pubmed_retmax))
    if pmids is not None:
        wanted = id_frame(spark, pmids)
        parts.append(fetch_by_ids(library, wanted).withColumn("doc_seq", F.col("ord")))
    if refs:
        parts.append(read_refs(spark, refs))
    if texts:
        parts.append(documents_from_texts(spark, texts))
    if not parts:
        raise ValueError("no input: give a query, ids, a reference file or texts")
    if cfg.expand_rounds > 0 and cfg.expand_strategy == "bfs" and links is not None and library is not None:
        held = stacked(parts).withColumn("id", pmid_of()).where("id IS NOT NULL")
        seeds = held.select("id", F.col("doc_seq").alias("ord"))
        reached = expansion.expand_pmids(seeds, links, cfg.expand_rounds, cfg.expand_link, cfg.expand_source, cfg.expand_max).where("round > 0")
        added = fetch_by_ids(library, reached.withColumn("ord", F.coalesce("ord", F.col("round").cast("bigint"))))
        return stacked(parts).unionByName(stacked([added.withColumn("doc_seq", F.col("ord"))], ADDED))
    return stacked(parts)
