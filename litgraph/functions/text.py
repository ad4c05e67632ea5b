"""Column functions over text and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters taken off both ends of a term.
EDGE = " .,;:()[]{}\"'"


def normal_term(term: Column | str) -> Column:
    """Lower case, runs of whitespace as one blank, ``EDGE`` characters off both ends. Null stays null."""
    c = F.col(term) if isinstance(term, str) else term
    return F.btrim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), F.lit(EDGE))


#: Words the pattern extractor drops.
STOPLIST = (
    "the", "and", "for", "with", "that", "this", "these", "those", "from",
    "were", "was", "are", "have", "has", "had", "not", "but", "all", "can",
    "may", "our", "their", "its", "which", "when", "than", "also", "been",
    "using", "used", "use", "study", "studies", "results", "result", "showed",
    "show", "data", "analysis", "patients", "patient", "cells", "cell",
    "expression", "levels", "level", "associated", "between", "within",
    "however", "thus", "therefore", "both", "more", "most", "such", "into",
    "during", "via", "two", "one", "three", "we", "in", "of", "to", "a", "an",
    "is", "by", "on", "as", "at", "or", "be", "it",
)
#: What counts as a gene-like symbol and as a content word. The boundary of the symbol is spelled out,
#: since \b means other things in other engines.
SYMBOL = r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]+[0-9][A-Za-z0-9]*(?![\p{L}\p{N}_])"
CONTENT_WORD = r"[A-Za-z][A-Za-z0-9\-]{2,}"


def content(title: str = "title", text: str = "text") -> Column:
    """Title and text as one: ``title. text``, or the text where there is no title. Null counts as empty."""
    t, x = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.when(t != "", F.concat(t, F.lit(". "), x)).otherwise(x)


def pmid_of(meta_pmid: str = "pmid", doc_id: str = "doc_id") -> Column:
    """The document's own pmid, else the digits or whatever follows ``PMID:`` in its id; null if neither is there."""
    from_id = F.trim(F.regexp_extract(F.col(doc_id), r"^PMID:(.*)$", 1))
    return F.coalesce(F.nullif(F.trim(F.col(meta_pmid)), F.lit("")), F.nullif(from_id, F.lit("")))
