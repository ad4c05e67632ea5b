"""Settings of the literature pipeline. Values become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # terms
    scispacy_model: str = "en_core_sci_sm"
    min_entity_len: int = 3
    normalize_entities: bool = True
    min_doc_freq: int = 2
    top_terms: int = 200
    stopwords: frozenset = frozenset()
    # co-occurrence graph; cooccurrence_window has no effect, documents are the window
    cooccurrence_window: str = "document"
    min_cooccurrence: int = 2
    min_pmi: float | None = 0.0
    max_graph_nodes: int = 150
    # A-B-C candidates
    min_b_links: int = 2
    max_direct_cooccurrence: int = 0
    top_candidates: int = 100
    # embeddings and clusters
    embed_model: str = ""
    embed_batch_size: int = 16
    cluster_method: str = "hdbscan"
    n_clusters: int = 12
    min_cluster_size: int = 0
    do_clustering: bool = False
    seed: int = 0
    # document search
    entrez_email: str = ""
    entrez_api_key: str | None = None
    pubmed_retmax: int = 1000
    # citation expansion
    expand_rounds: int = 0
    expand_link: str = "both"
    expand_source: str = "all"
    expand_max: int = 1000
    expand_strategy: str = "bfs"
    expand_fwd_rounds: int = 1
    expand_back_rounds: int = 1
    expand_top_k: int = 50
    # relevance gate
    rocchio_gamma: float = 0.25
    rocchio_neg_frac: float = 0.25
    rocchio_min_candidates: int = 8
    relevance_center: bool = False
    # citation networks
    citation_cache_days: int = 30
    do_citation_network: bool = True
    min_paper_degree: int = 0
    min_author_degree: int = 0
    min_author_papers: int = 0
