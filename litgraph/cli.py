"""Command line: ``python -m litgraph.cli --pmids ... --library documents.parquet --records papers.parquet --out DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators.citations import records as to_records
from .pipeline import run_pipeline
from .sources.docs import from_table, load_documents
from .sources.services import cached


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="litgraph", description="Literature-based discovery on Spark.")
    p.add_argument("--pubmed", metavar="QUERY", help="documents of the library that hold all words of QUERY")
    p.add_argument("--pmids", help="ids, delimited, or a file of them")
    p.add_argument("--refs", help="RIS or EndNote XML file")
    p.add_argument("--library", help="Parquet table of documents that queries and ids are looked up in")
    p.add_argument("--records", help="Parquet table of citation records")
    p.add_argument("--links", help="Parquet table of citation links")
    p.add_argument("--out", default="results")
    p.add_argument("--anchors", help="terms, comma-separated")
    p.add_argument("--expand", type=int, default=0, metavar="ROUNDS")
    p.add_argument("--expand-link", choices=("references", "cited_by", "both"), default="both")
    p.add_argument("--expand-source", choices=("icite", "ncbi", "all"), default="all")
    p.add_argument("--expand-strategy", choices=("bfs", "relevance"), default="bfs")
    p.add_argument("--expand-top-k", type=int, default=50)
    p.add_argument("--expand-max", type=int, default=1000)
    p.add_argument("--citations", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--citation-cache-days", type=int, default=30, help="how long links in --link-cache are held; 0 switches it off")
    p.add_argument("--link-cache", metavar="DIR", help="folder in which links that were looked up are kept")
    p.add_argument("--min-paper-degree", type=int, default=0)
    p.add_argument("--min-author-degree", type=int, default=0)
    p.add_argument("--min-author-papers", type=int, default=0)
    p.add_argument("--cluster", action="store_true")
    p.add_argument("--cluster-method", choices=("hdbscan", "kmeans"), default="hdbscan")
    p.add_argument("--n-clusters", type=int, default=12)
    p.add_argument("--min-cluster-size", type=int, default=0)
    p.add_argument("--vectors", help="Parquet table (term, vec) of term vectors")
    p.add_argument("--top-terms", type=int, default=200)
    p.add_argument("--min-doc-freq", type=int, default=2)
    p.add_argument("--scispacy-model", default="en_core_sci_sm", help="no effect here: a term model is given as run_pipeline(extractor=)")
    p.add_argument("--retmax", type=int, default=1000)
    p.add_argument("--email", default="", help="no effect here: documents come from --library")
    p.add_argument("--api-key", help="no effect here, as --email")
    return p


def config(a: argparse.Namespace) -> Config:
    return Config(
        scispacy_model=a.scispacy_model, min_doc_freq=a.min_doc_freq, top_terms=a.top_terms, cluster_method=a.cluster_method, n_clusters=a.n_clusters,
        min_cluster_size=a.min_cluster_size, do_clustering=a.cluster, entrez_email=a.email, entrez_api_key=a.api_key, pubmed_retmax=a.retmax,
        expand_rounds=a.expand, expand_link=a.expand_link, expand_source=a.expand_source, expand_max=a.expand_max, expand_strategy=a.expand_strategy,
        expand_top_k=a.expand_top_k, citation_cache_days=a.citation_cache_days, do_citation_network=a.citations, min_paper_degree=a.min_paper_degree,
        min_author_degree=a.min_author_degree, min_author_papers=a.min_author_papers,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not (a.pubmed or a.pmids or a.refs):
        print("give at least one of --pubmed, --pmids, --refs", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("litgraph").getOrCreate()
    cfg = config(a)
    read = lambda path: spark.read.parquet(path) if path else None
    library = from_table(read(a.library)) if a.library else None
    links = read(a.links)
    if links is not None and a.link_cache:
        table = links
        links = cached(spark, lambda ids: table.join(ids.select(F.col("id").alias("pmid")), "pmid", "left_semi"), a.link_cache, cfg)
    docs = load_documents(spark, library=library, query=a.pubmed, pmids=a.pmids, refs=a.refs, links=links, cfg=cfg)
    records = to_records(read(a.records)) if a.records else None
    anchors = [x.strip() for x in a.anchors.split(",")] if a.anchors else None
    result = run_pipeline(spark, docs, cfg, records=records, library=library, links=links, anchors=anchors, term_vectors=read(a.vectors), out=a.out, progress=print)
    print(", ".join(f"{name}: {n}" for name, n in result.summary().first().asDict().items()))
    for label, path in result.outputs.items():
        print(f"{label}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
