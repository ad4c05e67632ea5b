"""Citation records, the paper graph and the senior-author graph.

Records: (pmid, doc_seq, title, year, journal, citation_count, authors, refs, cited_by) with arrays for the last three.
Documents: (doc_seq, doc_id, pmid, title, journal, url). A missing record is an empty one. Null ids drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import pmid_of
from . import graph
from .packed import ids, names, split_arrays

PAPER_URL = "https://pubmed.ncbi.nlm.nih.gov/"


def filled(*cols: Column) -> Column:
    """First of the columns that is neither null nor empty, else empty; trimmed."""
    return F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("")))


def unique_names(names_: Column) -> Column:
    """Whitespace collapsed, blanks dropped, the first of spellings that differ in case only; order kept."""
    tidy = F.filter(F.transform(F.coalesce(names_, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    low = F.transform(tidy, F.lower)
    return F.filter(tidy, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def records(papers: DataFrame) -> DataFrame:
    """Citation records from packed fields, the last one of each pmid. Lists come from the tokenizer of ``packed``.

    Only ids move to find pmids that come again; the fields are split where they are read.
    """
    columns = ["rec_id", "pmid", "title", "pub_year", "journal", "citation_count"]
    lists = split_arrays(graph.last_wins(papers.where("pmid IS NOT NULL"), "pmid", "rec_id"), columns, {"authors": names, "refs": ids, "cited_by": ids})
    return lists.select("pmid", F.col("rec_id").alias("doc_seq"), "title", F.col("pub_year").alias("year"), "journal", "citation_count", "authors", "refs", "cited_by")


def corpus(docs: DataFrame) -> DataFrame:
    """Documents with a pmid, the first of each pmid."""
    known = docs.withColumn("pmid", pmid_of()).where("pmid IS NOT NULL")
    return graph.first_wins(known, "pmid", "doc_seq")


def reported(recs: DataFrame) -> DataFrame:
    """(citer, cited): both lists in one direction, as they are reported, without links of a paper to itself."""
    none = F.array().cast("array<struct<citer:string,cited:string>>")
    end = lambda citer, cited: F.struct(citer.alias("citer"), cited.alias("cited"))
    out = F.transform("refs", lambda x: end(F.col("pmid"), x))
    back = F.transform("cited_by", lambda x: end(x, F.col("pmid")))
    return recs.select(F.inline(F.concat(F.coalesce(out, none), F.coalesce(back, none)))).where("citer <> cited")


def links(recs: DataFrame) -> DataFrame:
    """(citer, cited): distinct links."""
    return reported(recs).distinct()


def paper_edges(recs: DataFrame, papers: DataFrame) -> DataFrame:
    """Links with both ends in the corpus. ``papers`` has one row per pmid. Links out of it leave before the rest is
    made distinct."""
    return graph.induced(reported(recs), papers, key="pmid").distinct()


def paper_nodes(papers: DataFrame, recs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pmid, doc_seq, title, year, journal, global_citations, url, in_corpus_citations) before any pruning."""
    r = recs.select("pmid", F.col("title").alias("r_title"), F.col("year").alias("r_year"), F.col("journal").alias("r_journal"), "citation_count")
    cited = edges.groupBy(F.col("cited").alias("pmid")).agg(F.count("*").alias("in_corpus_citations"))
    both = papers.join(r, "pmid", "left").join(cited, "pmid", "left")
    return both.select(
        "pmid",
        "doc_seq",
        filled(F.col("r_title"), F.col("title")).alias("title"),
        filled(F.col("r_year").cast("string"), F.col("year").cast("string") if "year" in papers.columns else F.lit(None).cast("string")).alias("year"),
        filled(F.col("r_journal"), F.col("journal")).alias("journal"),
        F.col("citation_count").alias("global_citations"),
        F.coalesce(F.nullif(F.col("url"), F.lit("")) if "url" in papers.columns else F.lit(None).cast("string"), F.concat(F.lit(PAPER_URL), "pmid", F.lit("/"))).alias("url"),
        F.coalesce("in_corpus_citations", F.lit(0)).alias("in_corpus_citations"),
    )


def paper_graph(papers: DataFrame, recs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, edges, rounds of pruning) of the paper citation graph."""
    edges = paper_edges(recs, papers)
    nodes = paper_nodes(papers, recs, edges)
    nodes, edges, rounds = graph.k_core(nodes, edges, cfg.min_paper_degree, key="pmid")
    top = nodes.orderBy(F.desc("in_corpus_citations"), F.desc(F.coalesce("global_citations", F.lit(0))), "doc_seq").limit(cfg.max_graph_nodes)
    return top, graph.induced(edges, top, key="pmid", small=True), rounds


def senior_authors(papers: DataFrame, recs: DataFrame) -> DataFrame:
    """(pmid, author, citation_count): last of the deduplicated author list; papers without authors drop out."""
    named = papers.select("pmid").join(recs, "pmid").withColumn("people", unique_names(F.col("authors"))).where("size(people) > 0")
    return named.select("pmid", F.element_at("people", -1).alias("author"), "citation_count")


def author_edges(seniors: DataFrame, edges: DataFrame) -> DataFrame:
    """(citer, cited, weight): distinct paper links between two different senior authors."""
    a = seniors.select(F.col("pmid").alias("citer"), F.col("author").alias("a"))
    b = seniors.select(F.col("pmid").alias("cited"), F.col("author").alias("b"))
    pairs = edges.join(a, "citer").join(b, "cited").where("a <> b")
    return pairs.groupBy(F.col("a").alias("citer"), F.col("b").alias("cited")).agg(F.count("*").alias("weight"))


def author_nodes(seniors: DataFrame, weighted: DataFrame) -> DataFrame:
    led = seniors.groupBy("author").agg(F.count("*").alias("papers"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("global_citations"))
    cited = weighted.groupBy(F.col("cited").alias("author")).agg(F.sum("weight").alias("in_corpus_citations"))
    return led.join(cited, "author", "left").withColumn("in_corpus_citations", F.coalesce("in_corpus_citations", F.lit(0)))


def author_graph(papers: DataFrame, recs: DataFrame, cfg: Config = Config(), rank_by: str = "in_corpus_citations") -> tuple[DataFrame, DataFrame, int]:
    """(nodes, edges, rounds). The floor on papers holds for the view by papers only: after pruning, before the trim."""
    seniors = senior_authors(papers, recs)
    weighted = author_edges(seniors, paper_edges(recs, papers))
    nodes, edges, rounds = graph.k_core(author_nodes(seniors, weighted), weighted, cfg.min_author_degree, key="author")
    if rank_by == "papers":
        nodes = nodes.where(F.col("papers") >= cfg.min_author_papers)
    second = "in_corpus_citations" if rank_by == "papers" else "global_citations"
    top = nodes.orderBy(F.desc(rank_by), F.desc(second), "author").limit(cfg.max_graph_nodes)
    return top, graph.induced(edges, top, key="author", small=True), rounds


def most_cited(nodes: DataFrame, top_n: int | None = None, by: str = "in_corpus_citations") -> DataFrame:
    """Nodes by ``by`` and then the other count, nulls as 0; all of them if ``top_n`` is None or 0."""
    other = "global_citations" if by == "in_corpus_citations" else "in_corpus_citations"
    last = "doc_seq" if "doc_seq" in nodes.columns else "author"
    out = nodes.orderBy(*[F.desc(F.coalesce(c, F.lit(0))) for c in (by, other)], last)
    return out.limit(top_n) if top_n else out
