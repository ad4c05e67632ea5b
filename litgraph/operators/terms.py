"""Term extraction, counting and ranking.

Documents are (doc_seq, doc_id, title, text): ``doc_seq`` is the place in the corpus, ``doc_id`` a string. Null titles
and texts count as empty; null doc_ids drop out; a doc_id that comes twice keeps its first place and its last content.
Documents without a term still count in the number of documents. Ties are broken by term, ascending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import CONTENT_WORD, STOPLIST, SYMBOL, content, normal_term
from ..plans.physical import cut, spread


#: Ids that come more than once, up to which they are broadcast (about 30 bytes each)
BROADCAST_IDS = 500_000


def one_per_id(docs: DataFrame) -> DataFrame:
    """(doc_seq, doc_id, content): last content at the first place.

    Only ids move to find those that come again; texts of all others stay where they are read. Where more ids come
    again than can be broadcast, all rows are grouped.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_seq", "doc_id", content().alias("content"))
    again = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = again.count()
    if not n:
        return rows
    repeated = rows if n > BROADCAST_IDS else rows.join(F.broadcast(again), "doc_id", "left_semi")
    merged = repeated.groupBy("doc_id").agg(F.min("doc_seq").alias("doc_seq"), F.max_by("content", "doc_seq").alias("content")).select("doc_seq", "doc_id", "content")
    return merged if n > BROADCAST_IDS else rows.join(F.broadcast(again), "doc_id", "left_anti").select("doc_seq", "doc_id", "content").unionByName(merged)


def keep(term: Column, cfg: Config) -> Column:
    ok = F.char_length(term) >= cfg.min_entity_len
    return ok & ~term.isin(*sorted(cfg.stopwords)) if cfg.stopwords else ok


def pattern_terms(cfg: Config) -> Column:
    """All terms of ``content`` in order: symbols, then content words. A symbol is both, and counts twice."""
    symbols = F.regexp_extract_all("content", F.lit(SYMBOL), 0)
    if cfg.normalize_entities:
        symbols = F.transform(symbols, F.lower)
    words = F.transform(F.regexp_extract_all("content", F.lit(CONTENT_WORD), 0), normal_term)
    words = F.filter(words, lambda t: ~t.isin(*STOPLIST))
    return F.filter(F.concat(symbols, words), lambda t: keep(t, cfg))


def extract(docs: DataFrame, cfg: Config = Config(), extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """mentions (doc_seq, doc_id, pos, term). ``extractor`` maps (doc_seq, doc_id, content) to the same columns and
    stands for a model; without one the patterns are used."""
    texts = spread(one_per_id(docs), "doc_id")
    if extractor is not None:
        return extractor(texts).where(keep(F.col("term"), cfg))
    return texts.select("doc_seq", "doc_id", F.posexplode(pattern_terms(cfg)).alias("pos", "term"))


def doc_terms(mentions: DataFrame) -> DataFrame:
    """(doc_seq, doc_id, term, tf)."""
    return mentions.groupBy("doc_seq", "doc_id", "term").agg(F.count("*").alias("tf"))


def term_counts(mentions: DataFrame) -> DataFrame:
    """(term, corpus_count, doc_freq). Counted per document first, so a frequent term shuffles one row per task."""
    return doc_terms(mentions).groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("doc_freq"))


def rank_terms(mentions: DataFrame, n_docs: int, cfg: Config = Config()) -> DataFrame:
    """(rank, term, score, corpus_count, doc_freq): total TF-IDF, the best ``top_terms``.

    The limit runs as a distributed top-k; only its rows are numbered.
    """
    idf = F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("doc_freq"))) + 1.0
    counts = term_counts(mentions).where(F.col("doc_freq") >= cfg.min_doc_freq)
    top = counts.withColumn("score", F.col("corpus_count") * idf).orderBy(F.desc("score"), "term").limit(cfg.top_terms)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "term"))
    return top.select(rank.alias("rank"), "term", "score", "corpus_count", "doc_freq")
