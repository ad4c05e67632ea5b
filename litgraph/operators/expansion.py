"""Growing a corpus along citation links: plain breadth-first search, or gated by relevance to the seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content, pmid_of
from ..plans.physical import cut
from . import graph, relevance, terms
from .embed import Factory, embedded_or_none

LINKS = ("references", "cited_by", "both")
SOURCES = ("icite", "ncbi", "all")


def link_table(links: DataFrame, link: str = "both", source: str = "all") -> DataFrame:
    """(id, other, pos) of the chosen kinds and services. Prefixes of ids fall away; null ids drop out; ``pos`` puts
    references before citing papers, iCite before NCBI, ids ascending."""
    if link not in LINKS:
        raise ValueError(f"link must be one of {LINKS}")
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    rows = links
    if link != "both":
        rows = rows.where(F.col("link") == link)
    if source != "all":
        rows = rows.where(F.col("source") == source)
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"(?i)^pmid:?\s*", ""))
    order = F.struct((F.col("source") != "icite").alias("s"), (F.col("link") != "references").alias("l"), F.col("other").alias("o"))
    return rows.select(bare("pmid").alias("id"), bare("other").alias("other"), "link", "source").where("id <> '' AND other <> ''").select("id", "other", order.alias("pos"))


def expand_pmids(seeds: DataFrame, links: DataFrame, rounds: int, link: str = "both", source: str = "all", max_records: int | None = 1000) -> DataFrame:
    """(id, round, ord). No rounds: the distinct seeds, capped. ``links`` is a table or a function from (id) to one."""
    steps = (lambda ids: link_table(links(ids), link, source)) if callable(links) else link_table(links, link, source)
    return graph.bfs(seeds, steps, max(0, rounds), max_records)


def terms_of(docs: DataFrame, cfg: Config) -> DataFrame:
    return terms.extract(docs, cfg).select("doc_id", "term").distinct()


def relevance_guided_expand(seed_docs: DataFrame, library: DataFrame, links, cfg: Config = Config(), embeddings: DataFrame | None = None, embedder: Factory | None = None) -> DataFrame:
    """Documents of ``library`` to append: (doc_seq, doc_id, title, text, expand_phase, relevance, rank).

    Citing papers first, then references: each direction is searched from the seeds, what is held already leaves,
    and the best K by relevance to the seeds stay, ties in order of discovery, or of the library without a cap. What the first direction drops may come back in the second. With
    ``embeddings`` (doc_id, vec), or those that ``embedder`` makes of the texts compared, vectors decide; without them,
    or if the model fails, terms do.
    """
    seeds = seed_docs.withColumn("id", pmid_of()).where("id IS NOT NULL").select("id", F.col("doc_seq").alias("ord"))
    held = seed_docs.select("doc_id").distinct()
    known = library.withColumn("id", pmid_of()).where("id IS NOT NULL").where(F.trim("text") != "")
    added = None
    for phase, link, rounds in (("forward", "cited_by", cfg.expand_fwd_rounds), ("backward", "references", cfg.expand_back_rounds)):
        reached = expand_pmids(seeds, links, rounds, link, cfg.expand_source, cfg.expand_max).where("round > 0")
        pool = graph.first_wins(known.join(reached.select("id", "ord"), "id"), "id", "doc_seq").join(held, "doc_id", "left_anti").withColumn("ord", F.coalesce("ord", "doc_seq"))
        if added is not None:
            pool = pool.join(added.select("doc_id"), "doc_id", "left_anti")
        pool = cut(pool)  # scored in several passes
        one = F.lit(phase).alias("pool")
        listed = pool.select(one, F.col("doc_id").alias("id"), "ord")
        vectors = embeddings
        if vectors is None and embedder is not None:
            both = seed_docs.select("doc_id", content().alias("content")).unionByName(pool.select("doc_id", content().alias("content")))
            vectors = embedded_or_none(both, "doc_id", "content", embedder, cfg)
        if vectors is not None:
            vec = lambda df: df.join(vectors, "doc_id")
            scores = relevance.embed_scores(vec(seed_docs).select(one, "vec"), vec(pool).select(one, F.col("doc_id").alias("id"), "ord", "vec"), cfg)
        else:
            p, c = (cut(terms_of(df, cfg).select(one, F.col("doc_id").alias("id"), "term")) for df in (seed_docs, pool))
            scores = relevance.term_scores(p, c, listed, cfg)
        kept = cut(relevance.top_k(scores, cfg.expand_top_k))
        got = pool.join(kept.select(F.col("id").alias("doc_id"), F.round("reported", 4).alias("relevance"), "rank"), "doc_id")
        got = got.select("doc_seq", "doc_id", "title", "text", F.lit(phase).alias("expand_phase"), "relevance", "rank")
        added = got if added is None else added.unionByName(got)
    return added


