"""Literature-based discovery on Spark."""

from .config import Config
from .operators.citations import author_graph, most_cited, paper_graph
from .operators.citations import corpus as cited_corpus
from .operators.citations import records as citation_records
from .operators.cluster import cluster_terms
from .operators.cooccur import build as build_cooccurrence
from .operators.discovery import candidates as abc_candidates
from .operators.embed import embed
from .operators.expansion import expand_pmids, relevance_guided_expand
from .operators.terms import extract as extract_entities
from .operators.terms import rank_terms
from .pipeline import PipelineResult, run_pipeline
from .sinks import write_graphml, write_network, write_scatter
from .sources.docs import documents_from_texts, fetch_by_ids, from_table, load_documents, search
from .sources.ids import parse_pmid_input
from .sources.refs import read_refs as load_refs
from .sources.services import fetched_links

__version__ = "0.2.0"
__all__ = [
    "Config", "PipelineResult", "abc_candidates", "author_graph", "build_cooccurrence", "citation_records", "cited_corpus", "cluster_terms", "documents_from_texts", "embed",
    "expand_pmids", "extract_entities", "fetch_by_ids", "fetched_links", "from_table", "load_documents", "load_refs", "most_cited", "paper_graph", "parse_pmid_input",
    "rank_terms", "relevance_guided_expand", "run_pipeline", "search", "write_graphml", "write_network", "write_scatter",
]
