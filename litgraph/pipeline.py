"""The whole run: documents in, ranked terms, hypotheses, clusters and citation networks out."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import Config
from .functions.text import pmid_of
from .operators import citations, cluster, cooccur, discovery, expansion, terms
from .operators.embed import Factory, embedded_or_none
from .plans.physical import cut, written
from .sources.docs import ADDED, stacked


@dataclass
class PipelineResult:
    documents: DataFrame
    mentions: DataFrame
    ranked: DataFrame
    term_edges: DataFrame
    candidates: DataFrame
    clusters: DataFrame | None = None
    term_vectors: DataFrame | None = None
    papers: tuple | None = None
    authors: tuple | None = None
    added: DataFrame | None = None
    outputs: dict[str, str] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """One row of counts, of the stages that ran."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        tables = {"documents": self.documents, "mentions": self.mentions, "ranked_terms": self.ranked, "term_edges": self.term_edges, "candidates": self.candidates}
        if self.clusters is not None:
            tables["clusters"] = self.clusters.where("cluster_id >= 0").select("cluster_id").distinct()
        for name, parts in (("papers", self.papers), ("authors", self.authors)):
            if parts:
                tables |= {name: parts[0], f"{name}_edges": parts[1]}
        if self.added is not None:
            tables |= {f"added_{phase}": self.added.where(F.col("expand_phase") == phase) for phase in ("forward", "backward")}
        out = None
        for name, df in tables.items():
            out = count(df, name) if out is None else out.join(count(df, name))  # one row each
        return out


def run_pipeline(
    spark: SparkSession, documents: DataFrame, cfg: Config = Config(), *, records: DataFrame | None = None, library: DataFrame | None = None, links=None, anchors: list[str] | None = None,
    term_vectors: DataFrame | None = None, doc_vectors: DataFrame | None = None, embedder: Factory | None = None, extractor: Callable | None = None, out: str | None = None, progress: Callable[[str], None] = lambda _: None,
) -> PipelineResult:
    """``documents`` (doc_seq, doc_id, title, text, ...). Stages that are switched off or lack their input are not
    planned. Vectors come as tables, or from ``embedder``. ``links`` is a table or a function from ids to one. A run is
    stopped with ``spark.interruptTag`` on a tag the caller sets."""
    if documents.isEmpty():
        raise ValueError("no documents")
    added = None
    if cfg.expand_rounds > 0 and cfg.expand_strategy == "relevance" and library is not None and links is not None:
        progress("expanding by relevance")
        added = written(expansion.relevance_guided_expand(documents, library, links, cfg, doc_vectors, embedder))
        # behind the others: what cites, then what is cited, each in order of relevance
        place = F.when(F.col("expand_phase") == "forward", 0).otherwise(1 << 40) + F.col("rank")
        documents = stacked([documents]).unionByName(stacked([added.withColumn("doc_seq", place)], ADDED))
    progress("extracting terms")
    mentions = written(terms.extract(documents, cfg, extractor))
    n_docs = documents.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    ranked = cut(terms.rank_terms(mentions, n_docs, cfg))
    progress("building the term graph")
    _, edges = cooccur.build(mentions, ranked, cfg)
    edges = cut(edges)
    result = PipelineResult(documents, mentions, ranked, edges, discovery.candidates(edges, cfg, anchors), added=added)
    if cfg.do_clustering:
        if term_vectors is None:
            term_vectors = embedded_or_none(ranked, "term", "term", embedder, cfg)
        if term_vectors is not None:
            result.term_vectors = cut(ranked.withColumnRenamed("rank", "pos").join(term_vectors, "term").select("pos", "term", "vec"))
            result.clusters = cut(cluster.cluster_terms(result.term_vectors, cfg))
    if cfg.do_citation_network and records is not None:
        progress("building citation networks")
        papers, recs = written(citations.corpus(documents)), written(records)
        result.papers = citations.paper_graph(papers, recs, cfg)
        result.authors = citations.author_graph(papers, recs, cfg)
    if out:
        write(result, out, cfg, records)
    return result


def write(result: PipelineResult, out: str, cfg: Config, records: DataFrame | None) -> None:
    at = lambda name: os.path.join(out, name)
    sinks.local(out)
    o = result.outputs
    o["terms"] = sinks.write_csv(sinks.ranked_terms(result.ranked), at("ranked_terms.csv"))
    o["candidates"] = sinks.write_csv(discovery.export_rows(result.candidates), at("hypothesis_candidates.csv"))
    pmids = sinks.write_pmids(result.documents.withColumn("pmid", pmid_of()), at("pmids.txt"))
    if pmids:
        o["pmids"] = pmids
    if result.clusters is not None:
        o["clusters"] = sinks.write_csv(result.clusters, at("term_clusters.csv"))
        o["cluster_plane"] = sinks.write_scatter(cluster.plane(result.term_vectors), result.clusters, at("term_clusters.html"))
    if result.papers:
        nodes, edges, _ = result.papers
        ends = edges.select(F.col("citer").alias("a"), F.col("cited").alias("b"))
        o["citations"] = sinks.write_csv(citations.most_cited(nodes).select(*sinks.PAPER_COLUMNS), at("citation_ranking.csv"))
        view = sinks.paper_view(nodes)
        o["network"] = sinks.write_network(view, ends, at("citation_network.html"), "Citation network")
        o["network_3d"] = sinks.write_network(view, ends, at("citation_network_3d.html"), "Citation network", True, cfg.seed)
        o["graphml"] = sinks.write_graphml(view, ends, at("citation_network.graphml"))
    if result.authors:
        nodes, edges, _ = result.authors
        ends = edges.select(F.col("citer").alias("a"), F.col("cited").alias("b"))
        o["authors"] = sinks.write_csv(citations.most_cited(nodes).select(*sinks.AUTHOR_COLUMNS), at("author_ranking.csv"))
        o["author_network"] = sinks.write_network(sinks.author_view(nodes), ends, at("author_network.html"), "Senior authors")
        o["author_network_3d"] = sinks.write_network(sinks.author_view(nodes), ends, at("author_network_3d.html"), "Senior authors", True, cfg.seed)
        by_papers, _, _ = citations.author_graph(citations.corpus(result.documents), records, cfg, "papers")
        o["author_papers"] = sinks.write_csv(citations.most_cited(by_papers, by="papers").select(*sinks.AUTHOR_COLUMNS), at("author_paper_ranking.csv"))
