"""Queries of the core and their SQL. Each callable takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import sinks
from .config import Config
from .functions.text import STOPLIST, content, normal_term
from .operators import citations, cluster, cooccur, discovery, evaluate, expansion, graph, layout, relevance, retrieval, terms
from .operators.packed import packed_values
from .plans.physical import written
from .sources import cache, docs, ids, refs
from .sources.tables import table

QUERIES = {}
SQL = {}
CFG = Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- packed fields -------------------------------------------------------------------------------------------------


@query()
def p1_found(spark, sf_dir):
    """One row per value of papers.authors, refs and cited_by."""
    return packed_values(table(spark, sf_dir, "papers"))


@query(
    """SELECT rec_id, field_name, CAST(generate_subscripts(v, 1) AS INTEGER) AS pos, unnest(v) AS item_value FROM (
  SELECT rec_id, 'refs' AS field_name, regexp_extract_all(refs, '[0-9]+') AS v FROM papers UNION ALL
  SELECT rec_id, 'cited_by', regexp_extract_all(cited_by, '[0-9]+') FROM papers)"""
)
def p1_id_values(spark, sf_dir):
    """The id fields alone, which SQL can check."""
    return p1_found(spark, sf_dir).where("field_name <> 'authors'")


PLAIN_LIST = "^[^\"'\\[{|\t\r\n&]*;[^\"'\\[{|\t\r\n&]*$"


@query(
    """SELECT rec_id, CAST(generate_subscripts(v, 1) AS INTEGER) AS pos, unnest(v) AS item_value FROM (SELECT rec_id,
  list_filter(list_transform(string_split(authors, ';'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS v FROM papers
  WHERE regexp_matches(authors, '"""
    + PLAIN_LIST.replace("'", "''")
    + """') AND NOT regexp_matches(authors, '(?i)(\\s|^)and\\s') AND NOT contains(authors, chr(92)))"""
)
def p1_plain_authors(spark, sf_dir):
    """The authors that nothing but semicolons divides, which SQL can check."""
    papers = table(spark, sf_dir, "papers")
    plain = papers.where(F.col("authors").rlike(PLAIN_LIST) & ~F.col("authors").rlike(r"(?i)(\s|^)and\s") & ~F.contains("authors", F.lit("\\")))
    return p1_found(spark, sf_dir).where("field_name = 'authors'").join(plain.select("rec_id"), "rec_id", "left_semi").select("rec_id", "pos", "item_value")


# --- text and terms ------------------------------------------------------------------------------------------------

DOCS_SQL = """d AS (SELECT doc_id AS doc_seq, CASE WHEN trim(pmid) <> '' THEN 'PMID:' || trim(pmid) ELSE 'ref:' || doc_id END AS doc_id, nullif(trim(pmid), '') AS pmid,
  coalesce(title, '') AS title, coalesce(text, '') AS text, source, journal, pub_year FROM documents),
content AS (SELECT doc_seq, doc_id, CASE WHEN title <> '' THEN title || '. ' || text ELSE text END AS content FROM d),
k AS (SELECT doc_id, min(doc_seq) AS doc_seq, arg_max(content, doc_seq) AS content FROM content GROUP BY doc_id)"""
STOP_SQL = ", ".join(f"'{w}'" for w in STOPLIST)
def terms_sql(text: str) -> str:
    """List of the terms of a text: symbols in lower case, then content words."""
    return rf"""list_filter(list_concat(
    list_transform(list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]+[0-9][A-Za-z0-9]*')), lambda x: lower(x)),
    list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL}))), lambda x: length(x) >= 3)"""


MENTIONS_SQL = rf"""{DOCS_SQL},
ts AS (SELECT doc_seq, doc_id, {terms_sql("content")} AS l FROM k),
m AS (SELECT doc_seq, doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS term FROM ts)"""
COUNTS_SQL = f"""{MENTIONS_SQL},
tc AS (SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS doc_freq FROM m GROUP BY term),
scored AS (SELECT term, corpus_count * (ln((1.0 + (SELECT count(*) FROM k)) / (1.0 + doc_freq)) + 1.0) AS score, corpus_count, doc_freq FROM tc WHERE doc_freq >= 2),
ranked AS (SELECT row_number() OVER (ORDER BY score DESC, term) AS rank, * FROM scored ORDER BY score DESC, term LIMIT 200)"""
EDGES_SQL = f"""{COUNTS_SQL},
dt AS (SELECT DISTINCT doc_seq, term FROM m WHERE term IN (SELECT term FROM ranked)),
big AS (SELECT doc_seq FROM dt GROUP BY doc_seq HAVING count(*) >= 2),
u AS (SELECT dt.* FROM dt JOIN big USING (doc_seq)),
n AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM big),
nodes AS (SELECT term, count(*) AS count FROM u GROUP BY term),
pairs AS (SELECT x.term AS a, y.term AS b, count(*) AS weight, min(x.doc_seq) AS first_seq FROM u x JOIN u y ON x.doc_seq = y.doc_seq AND x.term < y.term GROUP BY 1, 2),
raw AS (SELECT a, b, weight, first_seq, ln((weight / n) / ((x.count / n) * (y.count / n))) AS pmi FROM pairs JOIN nodes x ON x.term = a JOIN nodes y ON y.term = b, n WHERE weight >= 2),
edges AS (SELECT a, b, weight, round(pmi, 4) AS pmi, first_seq FROM raw WHERE pmi >= 0),
ends AS (SELECT a AS term, first_seq, a, b, 0 AS side FROM edges UNION ALL SELECT b, first_seq, a, b, 1 FROM edges),
deg AS (SELECT term, count(*) AS degree, min(row(first_seq, a, b, side)) AS loc FROM ends GROUP BY term),
kept AS (SELECT term FROM deg ORDER BY degree DESC, loc LIMIT 150),
te AS (SELECT * FROM edges WHERE a IN (SELECT term FROM kept) AND b IN (SELECT term FROM kept))"""
PATHS_SQL = f"""{EDGES_SQL},
s AS (SELECT a, b, pmi FROM te UNION ALL SELECT b, a, pmi FROM te),
hops AS (SELECT x.a, x.b, y.b AS c, x.pmi AS ab, y.pmi AS bc FROM s x JOIN s y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM s z WHERE z.a = x.a AND z.b = y.b))"""


def candidates_sql(where: str) -> str:
    return f"""{PATHS_SQL},
cand AS (SELECT a AS concept_a, c AS concept_c, list_sort(list(b)) AS shared_b, round(sum(ab * bc), 9) AS score FROM hops WHERE {where} GROUP BY a, c HAVING count(*) >= 2),
best AS (SELECT concept_a, concept_c, shared_b, len(shared_b) AS n_intermediates, round(score, 4) AS score, 0 AS direct_cooccurrence FROM cand ORDER BY cand.score DESC, concept_a, concept_c LIMIT 100)"""


def corpus(spark, sf_dir):
    return docs.from_table(table(spark, sf_dir, "documents"))


def mentions(spark, sf_dir):
    return terms.extract(corpus(spark, sf_dir), CFG)


def ranking(spark, sf_dir, found=None):
    found = mentions(spark, sf_dir) if found is None else found
    n_docs = corpus(spark, sf_dir).agg(F.count_distinct("doc_id")).first()[0]
    return terms.rank_terms(found, n_docs, CFG)


def term_sets(spark, sf_dir):
    """One extraction for the ranking and the sets: persisted, since three later actions read it."""
    found = mentions(spark, sf_dir).persist()
    return cooccur.doc_term_sets(found, ranking(spark, sf_dir, found).persist()).persist()


def trimmed(spark, sf_dir):
    return cooccur.trim(cooccur.pmi_edges(term_sets(spark, sf_dir), CFG), CFG.max_graph_nodes).persist()


@query(f"WITH {DOCS_SQL} SELECT doc_seq, doc_id, content FROM content")
def doc_content(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_seq", "doc_id", content().alias("content"))


@query(f"WITH {MENTIONS_SQL} SELECT doc_seq, doc_id, pos, term FROM m")
def term_mentions(spark, sf_dir):
    return mentions(spark, sf_dir)


@query(
    rf"""WITH {DOCS_SQL}, x AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]+[0-9][A-Za-z0-9]*'))) AS symbol FROM k)
SELECT symbol, count(*) AS corpus_count, count(DISTINCT doc_id) AS doc_freq FROM x GROUP BY symbol"""
)
def symbol_mentions(spark, sf_dir):
    found = terms.one_per_id(corpus(spark, sf_dir)).select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(terms.SYMBOL), 0)).alias("symbol"))
    return found.groupBy("doc_id", "symbol").count().groupBy("symbol").agg(F.sum("count").alias("corpus_count"), F.count("*").alias("doc_freq"))


@query(
    rf"""WITH x AS (SELECT trim(regexp_replace(lower(term), '\s+', ' ', 'g'), ' .,;:()[]{{}}"''') AS term FROM mentions)
SELECT term, count(*) AS rows FROM x WHERE length(term) >= 3 AND term NOT IN ({STOP_SQL}) GROUP BY term"""
)
def normalize_terms(spark, sf_dir):
    found = table(spark, sf_dir, "mentions").select(normal_term("term").alias("term"))
    return found.where(terms.keep(F.col("term"), CFG) & ~F.col("term").isin(*STOPLIST)).groupBy("term").agg(F.count("*").alias("rows"))


@query(f"WITH {COUNTS_SQL} SELECT term, corpus_count, doc_freq FROM tc")
def term_counts(spark, sf_dir):
    return terms.term_counts(mentions(spark, sf_dir))


@query(f"WITH {COUNTS_SQL} SELECT term, corpus_count, doc_freq FROM tc WHERE doc_freq >= 2")
def df_floor(spark, sf_dir):
    return terms.term_counts(mentions(spark, sf_dir)).where(F.col("doc_freq") >= CFG.min_doc_freq)


@query(f"WITH {COUNTS_SQL} SELECT CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score, corpus_count, doc_freq FROM ranked")
def rank_terms(spark, sf_dir):
    return ranking(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {COUNTS_SQL} SELECT term, round(score, 4) AS score, corpus_count, doc_freq FROM ranked")
def ranked_terms_csv(spark, sf_dir):
    return sinks.ranked_terms(ranking(spark, sf_dir))


# --- co-occurrence and hypotheses ----------------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT doc_seq, count(*) AS n_terms, string_agg(term, '|' ORDER BY term) AS terms FROM u GROUP BY doc_seq")
def doc_term_sets(spark, sf_dir):
    return term_sets(spark, sf_dir).select("doc_seq", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query(f"WITH {EDGES_SQL} SELECT term, count FROM nodes")
def term_nodes(spark, sf_dir):
    return cooccur.node_counts(term_sets(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT a, b, weight, first_seq FROM pairs")
def pair_counts(spark, sf_dir):
    return cooccur.pair_counts(term_sets(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT a, b, weight, pmi, first_seq FROM edges")
def pmi_edges(spark, sf_dir):
    return cooccur.pmi_edges(term_sets(spark, sf_dir), CFG)


@query(f"WITH {EDGES_SQL} SELECT term, degree FROM deg")
def term_degree(spark, sf_dir):
    return cooccur.term_degree(cooccur.pmi_edges(term_sets(spark, sf_dir), CFG))


@query(f"WITH {EDGES_SQL} SELECT a, b, weight, pmi FROM te")
def trim_graph(spark, sf_dir):
    return trimmed(spark, sf_dir).select("a", "b", "weight", "pmi")


@query(f"WITH {PATHS_SQL} SELECT a, b, c, ab, bc FROM hops")
def two_hop(spark, sf_dir):
    return discovery.two_hop(trimmed(spark, sf_dir))


@query(f"WITH {candidates_sql('a < c')} SELECT concept_a, concept_c, array_to_string(shared_b, '|') AS shared_b, n_intermediates, score, direct_cooccurrence FROM best")
def abc_candidates(spark, sf_dir):
    return discovery.candidates(trimmed(spark, sf_dir), CFG).withColumn("shared_b", F.array_join("shared_b", "|"))


ANCHORS = ["receptor", "enzyme", "no such term"]


@query(
    f"""WITH {candidates_sql("a IN ('receptor', 'enzyme') AND (c NOT IN ('receptor', 'enzyme') OR (a = 'receptor' AND c = 'enzyme'))")}
SELECT concept_a, concept_c, array_to_string(shared_b, '|') AS shared_b, n_intermediates, score, direct_cooccurrence FROM best"""
)
def abc_anchored(spark, sf_dir):
    return discovery.candidates(trimmed(spark, sf_dir), CFG, ANCHORS).withColumn("shared_b", F.array_join("shared_b", "|"))


@query(f"WITH {candidates_sql('a < c')} SELECT concept_a, concept_c, n_intermediates, array_to_string(shared_b[1:10], '; ') AS intermediates, score, direct_cooccurrence FROM best")
def candidate_rows(spark, sf_dir):
    return discovery.export_rows(discovery.candidates(trimmed(spark, sf_dir), CFG))


LAYOUT_SQL = """nd AS (SELECT DISTINCT a AS node FROM te UNION SELECT b FROM te),
dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM te UNION ALL SELECT b FROM te) GROUP BY node),
sy AS (SELECT a, b FROM te UNION ALL SELECT b, a FROM te),
an AS (SELECT sy.a AS node, min(row(-dg.degree, sy.b)) AS m FROM sy JOIN dg ON dg.node = sy.b GROUP BY sy.a),
pl AS (SELECT dg.node, degree, struct_extract_at(m, 2) AS anchor, row_number() OVER (ORDER BY degree DESC, dg.node) AS loc FROM dg JOIN an USING (node)),
rg AS (SELECT *, dense_rank() OVER (ORDER BY degree DESC) AS shell FROM pl WHERE loc > 1),
ri AS (SELECT *, max(shell) OVER () AS shells, count(*) OVER (PARTITION BY shell) AS m, row_number() OVER (PARTITION BY shell ORDER BY anchor, node) - 1 AS i FROM rg),
fl AS (SELECT node, degree, shell, shell / shells AS r, 1.0 - 2.0 * (i + 0.5) / m AS y0, (pi() * (3.0 - sqrt(5.0))) * i + 0.7 * shell AS th, 1.1 * shell AS ti FROM ri),
fz AS (SELECT *, sqrt(greatest(0.0::DOUBLE, 1.0 - y0 * y0)) AS rho FROM fl)"""


@query(
    f"""WITH {EDGES_SQL}, {LAYOUT_SQL}
SELECT node, degree, 0 AS shell, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM pl WHERE loc = 1 UNION ALL
SELECT node, degree, CAST(shell AS INTEGER), round(r * rho * cos(th), 6) + 0.0, round(r * (y0 * cos(ti) - rho * sin(th) * sin(ti)), 6) + 0.0, round(r * (y0 * sin(ti) + rho * sin(th) * cos(ti)), 6) + 0.0 FROM fz"""
)
def shell_layout(spark, sf_dir):
    edges = trimmed(spark, sf_dir).select("a", "b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = layout.shells(nodes, edges)
    return placed.select("node", "degree", "shell", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")])


# --- ids and corpus ------------------------------------------------------------------------------------------------


@query(
    r"""WITH x AS (SELECT rec_id, list_filter(list_transform(string_split_regex(coalesce(cited_by, ''), '[\s,;]+'), lambda p: regexp_replace(p, '(?i)^pmid:?', '')), lambda p: p <> '') AS l FROM papers),
y AS (SELECT rec_id, unnest(l) AS id, generate_subscripts(l, 1) AS loc FROM x)
SELECT rec_id, id, row_number() OVER (PARTITION BY rec_id ORDER BY min(loc)) AS ord FROM y GROUP BY rec_id, id"""
)
def pmid_parse(spark, sf_dir):
    found = table(spark, sf_dir, "papers").select("rec_id", F.posexplode(ids.split_ids("cited_by")).alias("ord", "id"))
    return found.select("rec_id", "id", (F.col("ord") + 1).cast("bigint").alias("ord"))


@query(f"WITH {DOCS_SQL} SELECT pmid, min(doc_seq) AS doc_seq FROM d WHERE pmid IS NOT NULL GROUP BY pmid")
def document_pmids(spark, sf_dir):
    return citations.corpus(corpus(spark, sf_dir)).select("pmid", "doc_seq")


@query(f"WITH {DOCS_SQL} SELECT pmid AS value FROM d WHERE pmid IS NOT NULL GROUP BY pmid")
def pmids_txt(spark, sf_dir):
    return sinks.pmid_lines(corpus(spark, sf_dir))


@query(f"WITH {DOCS_SQL}, f AS (SELECT * FROM d WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY doc_seq) = 1) SELECT 0 AS part, doc_id, title FROM f UNION ALL SELECT 1, doc_id, title FROM d")
def corpus_union(spark, sf_dir):
    """Two loads after each other: first of each pmid, then all."""
    c = corpus(spark, sf_dir)
    both = docs.stacked([citations.corpus(c), c])
    return both.select(docs.part_of("doc_seq").alias("part"), "doc_id", "title")


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_wins(spark, sf_dir):
    return graph.first_wins(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "doc_id").select("text", "doc_id")


@query(f"WITH {DOCS_SQL} SELECT doc_seq, doc_id, content FROM k")
def last_wins(spark, sf_dir):
    return terms.one_per_id(corpus(spark, sf_dir))


@query("SELECT pmid, max(rec_id) AS doc_seq FROM papers WHERE pmid IS NOT NULL GROUP BY pmid")
def record_per_pmid(spark, sf_dir):
    return recs(spark, sf_dir).select("pmid", "doc_seq")


# --- citations -----------------------------------------------------------------------------------------------------

RECS_SQL = f"""{DOCS_SQL},
r AS (SELECT * FROM papers WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY rec_id DESC) = 1),
corpus AS (SELECT pmid, min(doc_seq) AS doc_seq, arg_min(title, doc_seq) AS title, arg_min(coalesce(journal, ''), doc_seq) AS journal, arg_min(coalesce(pub_year, -1), doc_seq) AS yr FROM d WHERE pmid IS NOT NULL GROUP BY pmid),
lk AS (SELECT DISTINCT citer, cited FROM (SELECT pmid AS citer, unnest(regexp_extract_all(refs, '[0-9]+')) AS cited FROM r
  UNION ALL SELECT unnest(regexp_extract_all(cited_by, '[0-9]+')), pmid FROM r) WHERE citer <> cited),
pe AS (SELECT * FROM lk WHERE citer IN (SELECT pmid FROM corpus) AND cited IN (SELECT pmid FROM corpus)),
ic AS (SELECT cited AS pmid, count(*) AS c FROM pe GROUP BY cited),
pn AS (SELECT corpus.pmid, doc_seq, trim(coalesce(nullif(r.title, ''), nullif(corpus.title, ''), '')) AS title,
  coalesce(CAST(r.pub_year AS VARCHAR), CAST(nullif(yr, -1) AS VARCHAR), '') AS year, trim(coalesce(nullif(r.journal, ''), nullif(corpus.journal, ''), '')) AS journal,
  r.citation_count AS global_citations, coalesce(c, 0) AS in_corpus_citations FROM corpus LEFT JOIN r USING (pmid) LEFT JOIN ic USING (pmid)),
bl AS (SELECT pmid, pos, byline_id, trim(regexp_replace(author_name, '\\s+', ' ', 'g')) AS name FROM bylines),
bd AS (SELECT pmid, arg_min(name, row(pos, byline_id)) AS name, min(row(pos, byline_id)) AS loc FROM bl WHERE name <> '' GROUP BY pmid, lower(name)),
sr AS (SELECT bd.pmid, arg_max(name, loc) AS author, any_value(citation_count) AS citation_count FROM bd JOIN corpus USING (pmid) JOIN r USING (pmid) GROUP BY bd.pmid),
ae AS (SELECT a.author AS citer, b.author AS cited, count(*) AS weight FROM pe JOIN sr a ON a.pmid = pe.citer JOIN sr b ON b.pmid = pe.cited WHERE a.author <> b.author GROUP BY 1, 2),
aw AS (SELECT cited AS author, sum(weight) AS w FROM ae GROUP BY cited),
an0 AS (SELECT author, count(*) AS papers, sum(coalesce(citation_count, 0)) AS global_citations FROM sr GROUP BY author),
au AS (SELECT author, papers, CAST(global_citations AS BIGINT) AS global_citations, CAST(coalesce(w, 0) AS BIGINT) AS in_corpus_citations FROM an0 LEFT JOIN aw USING (author))"""


def recs(spark, sf_dir):
    """Records, with the authors from the bylines."""
    r = citations.records(table(spark, sf_dir, "papers")).drop("authors")
    by = table(spark, sf_dir, "bylines").groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("pos", "byline_id", "author_name"))).alias("b"))
    return r.join(by.select("pmid", F.transform("b", lambda x: x["author_name"]).alias("authors")), "pmid", "left")


def paper_parts(spark, sf_dir):
    return written(citations.corpus(corpus(spark, sf_dir))), written(recs(spark, sf_dir))


@query(f"WITH {RECS_SQL} SELECT citer, cited FROM pe")
def paper_edges(spark, sf_dir):
    papers, r = paper_parts(spark, sf_dir)
    return citations.paper_edges(r, papers)


@query(f"WITH {RECS_SQL} SELECT node, count(*) AS degree FROM (SELECT citer AS node FROM pe UNION ALL SELECT cited FROM pe) GROUP BY node")
def paper_degree(spark, sf_dir):
    return graph.degree(paper_edges(spark, sf_dir))


@query(f"WITH {RECS_SQL} SELECT pmid, title, year, journal, in_corpus_citations, coalesce(CAST(global_citations AS VARCHAR), '') AS global_citations, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url FROM pn")
def paper_nodes(spark, sf_dir):
    papers, r = paper_parts(spark, sf_dir)
    return as_text(citations.paper_nodes(papers, r, citations.paper_edges(r, papers)))


def as_text(nodes):
    """As in the CSV: an unknown count is empty, not 0."""
    return nodes.select(*sinks.PAPER_COLUMNS).withColumn("global_citations", F.coalesce(F.col("global_citations").cast("string"), F.lit("")))


TOP_PAPERS = "SELECT * FROM pn ORDER BY in_corpus_citations DESC, coalesce(global_citations, 0) DESC, doc_seq LIMIT 150"


@query(f"WITH {RECS_SQL} SELECT pmid, title, year, journal, in_corpus_citations, coalesce(CAST(global_citations AS VARCHAR), '') AS global_citations, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url FROM ({TOP_PAPERS})")
def citation_ranking(spark, sf_dir):
    nodes, _, _ = citations.paper_graph(*paper_parts(spark, sf_dir), CFG)
    return as_text(citations.most_cited(nodes))


@query(f"WITH {RECS_SQL}, t AS ({TOP_PAPERS}) SELECT citer, cited FROM pe WHERE citer IN (SELECT pmid FROM t) AND cited IN (SELECT pmid FROM t)")
def paper_graph_edges(spark, sf_dir):
    return citations.paper_graph(*paper_parts(spark, sf_dir), CFG)[1].select("citer", "cited")


@query(
    f"""WITH {RECS_SQL}, t AS ({TOP_PAPERS}) SELECT pmid AS node, in_corpus_citations + 1 AS value,
round(10 + 30 * CASE WHEN max(in_corpus_citations) OVER () > 0 THEN in_corpus_citations / max(in_corpus_citations) OVER () ELSE 0 END, 6) AS size FROM t"""
)
def paper_view(spark, sf_dir):
    nodes, _, _ = citations.paper_graph(*paper_parts(spark, sf_dir), CFG)
    return sinks.paper_view(nodes).select("node", "value", F.round("size", 6).alias("size"))


@query(f"WITH {RECS_SQL} SELECT pmid, author, coalesce(citation_count, 0) AS citation_count FROM sr")
def senior_authors(spark, sf_dir):
    return citations.senior_authors(*paper_parts(spark, sf_dir)).withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def weighted(spark, sf_dir):
    papers, r = paper_parts(spark, sf_dir)
    seniors = citations.senior_authors(papers, r)
    return seniors, citations.author_edges(seniors, citations.paper_edges(r, papers))


@query(f"WITH {RECS_SQL} SELECT citer, cited, weight FROM ae")
def author_edges(spark, sf_dir):
    return weighted(spark, sf_dir)[1]


@query(f"WITH {RECS_SQL} SELECT author, papers, in_corpus_citations, global_citations FROM au ORDER BY in_corpus_citations DESC, global_citations DESC, author LIMIT 150")
def author_ranking(spark, sf_dir):
    nodes, _, _ = citations.author_graph(*paper_parts(spark, sf_dir), CFG)
    return citations.most_cited(nodes).select(*sinks.AUTHOR_COLUMNS)


@query(f"WITH {RECS_SQL} SELECT author, papers, in_corpus_citations, global_citations FROM au WHERE papers >= 2 ORDER BY papers DESC, in_corpus_citations DESC, author LIMIT 150")
def author_paper_ranking(spark, sf_dir):
    nodes, _, _ = citations.author_graph(*paper_parts(spark, sf_dir), Config(min_author_papers=2), "papers")
    return citations.most_cited(nodes, by="papers").select(*sinks.AUTHOR_COLUMNS)


def k_core_sql(nodes: str, key: str, edges: str, k: int, rounds: int) -> str:
    steps = [f"c0 AS (SELECT {key} AS node FROM {nodes})"]
    for i in range(rounds):
        e = f"SELECT citer, cited FROM {edges} WHERE citer IN (SELECT node FROM c{i}) AND cited IN (SELECT node FROM c{i})"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT node FROM (SELECT unnest([citer, cited]) AS node FROM ({e})) GROUP BY node HAVING count(*) >= {k})")
    return ", ".join(steps) + f" SELECT node FROM c{rounds}"


@query(f"WITH {RECS_SQL}, {k_core_sql('corpus', 'pmid', 'pe', 5, 40)}")
def kcore_papers(spark, sf_dir):
    papers, r = paper_parts(spark, sf_dir)
    return graph.k_core(papers.select("pmid"), citations.paper_edges(r, papers), 5, key="pmid")[0].select(F.col("pmid").alias("node"))


@query(f"WITH {RECS_SQL}, {k_core_sql('au', 'author', 'ae', 3, 40)}")
def kcore_authors(spark, sf_dir):
    seniors, edges = weighted(spark, sf_dir)
    return graph.k_core(citations.author_nodes(seniors, edges), edges, 3, key="author")[0].select(F.col("author").alias("node"))


# --- expansion -----------------------------------------------------------------------------------------------------

LINKS_SQL = r"""la AS (SELECT regexp_replace(trim(pmid), '(?i)^pmid:?\s*', '') AS id, regexp_replace(trim(other), '(?i)^pmid:?\s*', '') AS other, link, source FROM links),
l AS (SELECT trim(id) AS id, trim(other) AS other, link, source, row(source <> 'icite', link <> 'references', trim(other)) AS pos FROM la WHERE trim(id) <> '' AND trim(other) <> ''),
seeds AS (SELECT DISTINCT pmid AS id FROM trials WHERE trial_role = 'seed' AND trim(pmid) <> '')"""


def bfs_sql(rounds: int, where: str) -> str:
    steps = ["b0 AS (SELECT id, 0 AS round FROM seeds)"]
    for r in range(1, rounds + 1):
        steps.append(f"b{r} AS MATERIALIZED (SELECT id, round FROM b{r - 1} UNION ALL SELECT DISTINCT other, {r} FROM l WHERE {where} AND id IN (SELECT id FROM b{r - 1} WHERE round = {r - 1}) AND other NOT IN (SELECT id FROM b{r - 1}))")
    return f"WITH {LINKS_SQL}, {', '.join(steps)} SELECT id, round FROM b{rounds}"


def seeds(spark, sf_dir):
    found = table(spark, sf_dir, "trials").where("trial_role = 'seed'").select(F.col("pmid").alias("id")).distinct()
    return found.select("id", F.lit(0).alias("ord"))


@query(bfs_sql(1, "link = 'references'"))
def bfs_1(spark, sf_dir):
    return expansion.expand_pmids(seeds(spark, sf_dir), table(spark, sf_dir, "links"), 1, "references", "all", None).select("id", "round")


@query(bfs_sql(2, "link = 'cited_by' AND source = 'icite'"))
def bfs_2(spark, sf_dir):
    return expansion.expand_pmids(seeds(spark, sf_dir), table(spark, sf_dir, "links"), 2, "cited_by", "icite", None).select("id", "round")


@query(bfs_sql(2, "true"))
def bfs_both(spark, sf_dir):
    return expansion.expand_pmids(seeds(spark, sf_dir), table(spark, sf_dir, "links"), 2, "both", "all", None).select("id", "round")


CAP = 5000


@query(
    f"""WITH {LINKS_SQL}, b0 AS (SELECT id, 0 AS round, row_number() OVER (ORDER BY id) AS ord FROM seeds),
n0 AS (SELECT other AS id, min(row(b0.ord, pos)) AS loc FROM l JOIN b0 USING (id) WHERE other NOT IN (SELECT id FROM b0) GROUP BY other),
b1 AS (SELECT id, round, ord FROM b0 UNION ALL SELECT id, 1, (SELECT count(*) FROM b0) + row_number() OVER (ORDER BY loc, id) FROM n0),
n1 AS (SELECT other AS id, min(row(b1.ord, pos)) AS loc FROM l JOIN b1 USING (id) WHERE round = 1 AND ord <= {CAP} AND other NOT IN (SELECT id FROM b1 WHERE ord <= {CAP}) GROUP BY other),
b2 AS (SELECT * FROM b1 WHERE ord <= {CAP} UNION ALL SELECT id, 2, (SELECT count(*) FROM b1 WHERE ord <= {CAP}) + row_number() OVER (ORDER BY loc, id) FROM n1)
SELECT id, round, ord FROM b2 WHERE ord <= {CAP}"""
)
def bfs_capped(spark, sf_dir):
    return expansion.expand_pmids(seeds(spark, sf_dir), table(spark, sf_dir, "links"), 2, "both", "all", CAP)


# --- relevance -----------------------------------------------------------------------------------------------------

POOL_SQL = f"""{MENTIONS_SQL},
tr AS (SELECT DISTINCT review, pmid FROM trials WHERE trial_role = 'seed' AND review IS NOT NULL AND pmid IS NOT NULL),
tg AS (SELECT DISTINCT review, pmid FROM trials WHERE trial_role = 'target' AND review IS NOT NULL AND pmid IS NOT NULL EXCEPT SELECT review, pmid FROM tr),
dt AS (SELECT DISTINCT doc_id, term FROM m),
prof AS (SELECT review AS pool, dt.doc_id AS id, term FROM tr JOIN dt ON dt.doc_id = 'PMID:' || tr.pmid),
pool AS (SELECT review AS pool, k.doc_id AS id, k.doc_seq AS ord FROM tg JOIN k ON k.doc_id = 'PMID:' || tg.pmid),
cand AS (SELECT pool, pool.id, term FROM pool JOIN dt ON dt.doc_id = pool.id),
size AS (SELECT pool, id, count(*) AS n FROM cand GROUP BY pool, id),
q0 AS (SELECT pool, term, count(*)::DOUBLE AS w FROM prof GROUP BY pool, term),
q AS (SELECT pool, term, w / sqrt(sum(w * w) OVER (PARTITION BY pool)) AS w FROM q0)"""


def score_sql(q: str, name: str) -> str:
    return f"""{name}n AS (SELECT pool, sqrt(sum(w * w)) AS norm FROM {q} GROUP BY pool),
{name}h AS (SELECT pool, id, sum(w) AS dot FROM cand JOIN {q} USING (pool, term) GROUP BY pool, id),
{name} AS (SELECT pool.pool, pool.id, ord, round(coalesce(dot, 0) / (coalesce(nullif(norm, 0), 1) * sqrt(coalesce(n, 1))), 12) AS score
  FROM pool LEFT JOIN size USING (pool, id) LEFT JOIN {name}h USING (pool, id) LEFT JOIN {name}n USING (pool))"""


def rocchio_sql(gamma: float, k: int = 50, n: str = "") -> str:
    """Negatives of the first scores s0, and the scores s1 (with ``n`` behind the names) after they are taken off."""
    return f"""rk{n} AS (SELECT *, count(*) OVER (PARTITION BY pool) AS n, row_number() OVER (PARTITION BY pool ORDER BY score, ord) AS loc FROM s0),
neg{n} AS (SELECT pool, id FROM rk{n} WHERE n >= 8 AND loc <= CASE WHEN n - greatest(1, round_even(n * 0.25, 0)) < {k} THEN greatest(0, n - {k}) ELSE greatest(1, round_even(n * 0.25, 0)) END),
ga{n} AS (SELECT pool, term, count(*)::DOUBLE AS w FROM cand JOIN neg{n} USING (pool, id) GROUP BY pool, term),
gb{n} AS (SELECT pool, term, w / sqrt(sum(w * w) OVER (PARTITION BY pool)) AS w FROM ga{n}),
q2{n} AS (SELECT pool, term, coalesce(q.w, 0) - {gamma} * coalesce(gb{n}.w, 0) AS w FROM q FULL JOIN gb{n} USING (pool, term)), {score_sql('q2' + n, 's1' + n)}"""


ROCCHIO_SQL = f"""{POOL_SQL}, {score_sql('q', 's0')}, {rocchio_sql(0.25)}"""


def pools(spark, sf_dir):
    """(profile, candidates, listed): for every review its seeds' terms, and its targets among the documents."""
    trials = table(spark, sf_dir, "trials")
    seed, target = evaluate.role(trials, "seed"), evaluate.role(trials, "target")
    target = target.join(seed, ["review", "pmid"], "left_anti")
    keyed = lambda df: df.select(F.col("review").alias("pool"), F.concat(F.lit("PMID:"), "pmid").alias("doc_id"))
    asked = keyed(seed).unionByName(keyed(target)).select("doc_id").distinct()
    held = corpus(spark, sf_dir).join(asked, "doc_id", "left_semi")
    found = written(terms.extract(held, CFG).select("doc_id", "term").distinct())
    profile = keyed(seed).join(found, "doc_id").select("pool", F.col("doc_id").alias("id"), "term")
    first = held.groupBy("doc_id").agg(F.min("doc_seq").alias("ord"))
    listed = keyed(target).join(first, "doc_id").select("pool", F.col("doc_id").alias("id"), "ord")
    cand = listed.join(found.withColumnRenamed("doc_id", "id"), "id").select("pool", "id", "term")
    return tuple(written(df) for df in (profile, cand, listed))


@query(f"WITH {POOL_SQL}, {score_sql('q', 's0')} SELECT pool, id, round(score, 6) AS score FROM s0")
def rel_terms(spark, sf_dir):
    scores = relevance.term_scores(*pools(spark, sf_dir), Config(rocchio_gamma=0))
    return scores.select("pool", "id", F.round("score", 6).alias("score"))


@query(f"WITH {ROCCHIO_SQL} SELECT pool, id, round(score, 6) AS score FROM s1")
def rel_terms_rocchio(spark, sf_dir):
    return relevance.term_scores(*pools(spark, sf_dir), CFG).select("pool", "id", F.round("score", 6).alias("score"))


@query(f"WITH {ROCCHIO_SQL} SELECT pool, id, CAST(row_number() OVER (PARTITION BY pool ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s1 QUALIFY rank <= 50")
def topk_reported(spark, sf_dir):
    scores = relevance.term_scores(*pools(spark, sf_dir), CFG)
    return relevance.top_k(scores, CFG.expand_top_k).select("pool", "id", "rank")


SWEEP = [10, 25, 50, 100, 200]


@query(f"""WITH {ROCCHIO_SQL}, pk AS (SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY score DESC, ord) AS picked FROM s1)
SELECT 'top' || kk AS arm, pool AS review, substr(id, 6) AS pmid FROM pk, (SELECT unnest({SWEEP}) AS kk) WHERE picked <= kk""")
def topk_sweep(spark, sf_dir):
    """One ranking, every K."""
    kept = relevance.top_k(relevance.term_scores(*pools(spark, sf_dir), CFG), 0)
    return evaluate.sweep(kept.select(F.col("pool").alias("review"), F.substring("id", 6, 1000).alias("pmid"), "picked"), SWEEP)


VECS_SQL = """v AS (SELECT label AS pool, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5 AS seed FROM embeddings),
w AS (SELECT pool, id, seed, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-9)) AS e FROM v),
mu AS (SELECT pool, list(m ORDER BY dim) AS m FROM (SELECT pool, dim, avg(x) AS m FROM (SELECT pool, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM w WHERE NOT seed) GROUP BY 1, 2) GROUP BY pool),
c1 AS (SELECT pool, id, seed, list_transform(list_zip(e, m), lambda x: x[1] - x[2]) AS e FROM w JOIN mu USING (pool)),
c AS (SELECT pool, id, seed, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-9)) AS e FROM c1)"""


def cosine_sql(src: str, name: str, gamma: float) -> str:
    mean = lambda rows, n: f"{n} AS (SELECT pool, list(m ORDER BY dim) AS m FROM (SELECT pool, dim, avg(x) AS m FROM (SELECT pool, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM {rows}) GROUP BY 1, 2) GROUP BY pool), {n}u AS (SELECT pool, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-9)) AS q FROM {n})"
    dots = lambda q, n: f"{n} AS (SELECT pool, id, e, round(list_dot_product(e, q), 12) AS score FROM {src} JOIN {q} USING (pool) WHERE NOT seed)"
    return f"""{mean(f"(SELECT * FROM {src} WHERE seed)", name + "p")}, {dots(name + "pu", name + "a")},
{name}r AS (SELECT *, count(*) OVER (PARTITION BY pool) AS n, row_number() OVER (PARTITION BY pool ORDER BY score, id) AS loc FROM {name}a),
{name}g AS (SELECT pool, e FROM {name}r WHERE n >= 8 AND loc <= CASE WHEN n - greatest(1, round_even(n * 0.25, 0)) < 50 THEN greatest(0, n - 50) ELSE greatest(1, round_even(n * 0.25, 0)) END),
{mean(name + "g", name + "m")},
{name}x AS (SELECT p.pool, CASE WHEN m.q IS NULL THEN p.q ELSE list_transform(list_zip(p.q, m.q), lambda x: x[1] - {gamma} * x[2]) END AS y FROM {name}pu p LEFT JOIN {name}mu m USING (pool)),
{name}q AS (SELECT pool, list_transform(y, lambda x: x / greatest(sqrt(list_dot_product(y, y)), 1e-9)) AS q FROM {name}x), {dots(name + "q", name)}"""


def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pool"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"))
    v = v.withColumn("seed", F.row_number().over(Window.partitionBy("pool").orderBy("id")) <= 5)
    return v.where("seed").select("pool", "vec"), v.where("NOT seed").select("pool", "id", "ord", "vec")


@query(f"WITH {VECS_SQL}, {cosine_sql('w', 's', 0.25)}, {cosine_sql('c', 'z', 0.25)} SELECT s.pool, s.id, round(s.score, 6) AS score, round(z.score, 6) AS reported FROM s JOIN z USING (pool, id)")
def rel_embed(spark, sf_dir):
    scores = relevance.embed_scores(*vectors(spark, sf_dir), CFG)
    return scores.select("pool", "id", F.round("score", 6).alias("score"), F.round("reported", 6).alias("reported"))


@query(f"WITH {VECS_SQL}, {cosine_sql('c', 'z', 0.25)} SELECT pool, id, round(score, 6) AS score FROM z")
def rel_embed_centred(spark, sf_dir):
    scores = relevance.embed_scores(*vectors(spark, sf_dir), Config(relevance_center=True))
    return scores.select("pool", "id", F.round("score", 6).alias("score"))


def phase_sql(link: str, more: str = "") -> str:
    return f"""WITH pool AS (SELECT 'p' AS pool, doc_id AS id, doc_seq AS ord, doc_seq FROM kn WHERE doc_id NOT IN (SELECT doc_id FROM sd) {more}
  AND pmid IN (SELECT other FROM l WHERE link = '{link}' AND id IN (SELECT pmid FROM sd)) AND pmid NOT IN (SELECT pmid FROM sd)),
cand AS (SELECT pool, id, term FROM pool JOIN tx USING (doc_seq)),
size AS (SELECT pool, id, count(*) AS n FROM cand GROUP BY pool, id),
q0 AS (SELECT 'p' AS pool, term, count(*)::DOUBLE AS w FROM prof GROUP BY term),
q AS (SELECT pool, term, w / sqrt(sum(w * w) OVER (PARTITION BY pool)) AS w FROM q0), {score_sql('q', 's0')}, {rocchio_sql(0.25)}
SELECT id, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM s1 QUALIFY rank <= 50"""


@query(
    rf"""WITH {DOCS_SQL}, {LINKS_SQL},
tx AS (SELECT DISTINCT doc_seq, term FROM (SELECT doc_seq, unnest({terms_sql("content")}) AS term FROM content)),
sd AS (SELECT * FROM d WHERE pmid IN (SELECT id FROM seeds)),
kn AS (SELECT * FROM d WHERE pmid IS NOT NULL AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY doc_seq) = 1),
prof AS (SELECT doc_id AS id, term FROM (SELECT doc_id, max(doc_seq) AS doc_seq FROM sd GROUP BY doc_id) JOIN tx USING (doc_seq)),
fw AS ({phase_sql("cited_by")}), bw AS ({phase_sql("references", "AND doc_id NOT IN (SELECT id FROM fw)")})
SELECT id AS doc_id, 'forward' AS expand_phase, round(score, 4) AS relevance, CAST(rank AS INTEGER) AS rank FROM fw UNION ALL SELECT id, 'backward', round(score, 4), CAST(rank AS INTEGER) FROM bw"""
)
def rel_expand(spark, sf_dir):
    """Relevance-gated growth of the corpus from the documents that are seeds of a trial."""
    library = corpus(spark, sf_dir)
    seed_ids = seeds(spark, sf_dir).select(F.col("id").alias("pmid"))
    seed_docs = library.join(seed_ids, "pmid", "left_semi")
    return expansion.relevance_guided_expand(seed_docs, library, table(spark, sf_dir, "links"), Config(expand_max=None)).select("doc_id", "expand_phase", "relevance", "rank")


# --- evaluation ----------------------------------------------------------------------------------------------------

LINKED_SQL = f"""{RECS_SQL},
ts AS (SELECT DISTINCT review, pmid FROM trials WHERE trial_role = 'seed' AND review IS NOT NULL AND pmid IS NOT NULL),
tt AS (SELECT DISTINCT review, pmid FROM trials WHERE trial_role = 'target' AND review IS NOT NULL AND pmid IS NOT NULL),
back AS (SELECT DISTINCT review, cited AS pmid FROM ts JOIN lk ON lk.citer = ts.pmid EXCEPT SELECT review, pmid FROM ts),
fwd AS (SELECT DISTINCT review, citer AS pmid FROM ts JOIN lk ON lk.cited = ts.pmid EXCEPT SELECT review, pmid FROM ts),
both_ AS (SELECT review, pmid FROM back UNION SELECT review, pmid FROM fwd)"""
SCORED_SQL = """ry AS (SELECT review, max(pub_year) AS ry FROM trials GROUP BY review),
cut AS (SELECT arm, arms.review, arms.pmid FROM arms LEFT JOIN ry USING (review) LEFT JOIN (SELECT pmid, pub_year FROM r) USING (pmid) WHERE pub_year IS NULL OR ry IS NULL OR pub_year <= ry),
tn AS (SELECT review, pmid FROM tt EXCEPT SELECT review, pmid FROM ts),
rv AS (SELECT review FROM ts UNION SELECT review FROM tn),
hit AS (SELECT arm, cut.review, count(*) AS n_retrieved, count(tn.pmid) AS hits FROM cut LEFT JOIN tn ON tn.review = cut.review AND tn.pmid = cut.pmid GROUP BY 1, 2),
nt AS (SELECT review, count(*) AS n_target FROM tn GROUP BY review),
gr AS (SELECT arm, review, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_target, 0) AS n_target, coalesce(hits, 0) AS hits
  FROM rv CROSS JOIN (SELECT DISTINCT arm FROM arms) LEFT JOIN hit USING (arm, review) LEFT JOIN nt USING (review)),
pr AS (SELECT *, CASE WHEN n_retrieved > 0 THEN hits / n_retrieved ELSE 0 END AS precision, CASE WHEN n_target > 0 THEN hits / n_target ELSE 0 END AS recall FROM gr),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
ARMS_SQL = f"""{LINKED_SQL},
arms AS (SELECT 'backward' AS arm, * FROM back UNION ALL SELECT 'forward', * FROM fwd UNION ALL SELECT 'both', * FROM both_), {SCORED_SQL}"""
#: Gates of the arms: what each compares, terms of titles, and the first scores
GATES_SQL = f"""{LINKED_SQL},
tl AS (SELECT pmid AS id, title || '. ' AS content FROM r WHERE trim(title) <> ''),
tk AS (SELECT DISTINCT id, term FROM (SELECT id, unnest({terms_sql("content")}) AS term FROM tl)),
gp AS (SELECT 'bwd' AS gate, * FROM ts UNION ALL SELECT 'bwd', * FROM fwd UNION ALL SELECT 'fwd', * FROM ts UNION ALL SELECT 'fwd', * FROM back UNION ALL SELECT 'seeds_bwd', * FROM ts UNION ALL SELECT 'seeds_fwd', * FROM ts),
gc AS (SELECT 'bwd' AS gate, * FROM back UNION ALL SELECT 'fwd', * FROM fwd UNION ALL SELECT 'seeds_bwd', * FROM back UNION ALL SELECT 'seeds_fwd', * FROM fwd),
prof AS (SELECT gate || ':' || review AS pool, id, term FROM gp JOIN tk ON tk.id = gp.pmid),
pool AS (SELECT gate || ':' || review AS pool, gate, review, pmid AS id, pmid AS ord FROM gc WHERE pmid IN (SELECT id FROM tk)),
cand AS (SELECT pool, pool.id, term FROM pool JOIN tk ON tk.id = pool.id),
size AS (SELECT pool, id, count(*) AS n FROM cand GROUP BY pool, id),
q0 AS (SELECT pool, term, count(*)::DOUBLE AS w FROM prof GROUP BY pool, term),
q AS (SELECT pool, term, w / sqrt(sum(w * w) OVER (PARTITION BY pool)) AS w FROM q0), {score_sql('q', 's0')}"""


def picked_sql(scores: str, n: str) -> str:
    return f"pk{n} AS (SELECT gate, review, {scores}.id AS pmid, row_number() OVER (PARTITION BY {scores}.pool ORDER BY score DESC, {scores}.ord) AS picked FROM {scores} JOIN pool ON pool.pool = {scores}.pool AND pool.id = {scores}.id)"


def portions(spark, sf_dir, by_titles=False):
    """(trials, what the seeds link to as ``retrieval.portions``)."""
    r, trials = written(citations.records(table(spark, sf_dir, "papers"))), table(spark, sf_dir, "trials")
    texts = written(evaluate.title_terms(r)) if by_titles else None
    return trials, retrieval.portions(trials, citations.reported(r), r.select("pmid", F.col("year").alias("pub_year")), texts)


def arm(spark, sf_dir, direction):
    links = citations.reported(citations.records(table(spark, sf_dir, "papers")))
    return evaluate.seed_links(table(spark, sf_dir, "trials"), links, direction)


@query(f"WITH {ARMS_SQL} SELECT review, pmid FROM fwd")
def arm_forward(spark, sf_dir):
    return arm(spark, sf_dir, "forward")


@query(f"WITH {ARMS_SQL} SELECT review, pmid FROM back")
def arm_backward(spark, sf_dir):
    return arm(spark, sf_dir, "backward")


@query(f"WITH {ARMS_SQL} SELECT review, pmid FROM both_")
def arm_both(spark, sf_dir):
    return arm(spark, sf_dir, "both")


def scored(spark, sf_dir, arms=evaluate.PLAIN):
    trials, held = portions(spark, sf_dir, by_titles=any(a not in evaluate.PLAIN for a in arms))
    return evaluate.rates(written(retrieval.counted(held, arms)), trials, arms)


@query(f"WITH {ARMS_SQL} SELECT arm, review, pmid FROM cut")
def year_cutoff(spark, sf_dir):
    return retrieval.retrieved(portions(spark, sf_dir)[1])


@query(f"WITH {ARMS_SQL} SELECT arm, review, n_retrieved, n_target, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def eval_prf(spark, sf_dir):
    return scored(spark, sf_dir).select("arm", "review", "n_retrieved", "n_target", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


MEASURES = ("precision", "recall", "f1", "n_retrieved")


@query(f"WITH {ARMS_SQL} SELECT arm, count(*) AS reviews, {', '.join(f'round(median({m}), 6) AS median_{m}, round(avg({m}), 6) AS mean_{m}' for m in MEASURES)} FROM f GROUP BY arm")
def eval_summary(spark, sf_dir):
    summary = evaluate.summarize(scored(spark, sf_dir))
    return summary.select("arm", "reviews", *[F.round(f"{s}_{m}", 6).alias(f"{s}_{m}") for m in MEASURES for s in ("median", "mean")])


ARMS_BY_RELEVANCE = ["relevance", "relevance_fwd", "relevance_seeds", "relevance_seeds:0.25:10"]
GAMMAS = [0.0, 0.25, 0.5]


@query(
    f"""WITH {GATES_SQL}, {rocchio_sql(0.25)}, {picked_sql("s1", "")},
arms AS (SELECT DISTINCT * FROM (SELECT 'relevance' AS arm, review, pmid FROM pk WHERE gate = 'bwd' AND picked <= 50 UNION ALL SELECT 'relevance', * FROM fwd
  UNION ALL SELECT 'relevance_fwd', review, pmid FROM pk WHERE gate = 'fwd' AND picked <= 50 UNION ALL SELECT 'relevance_fwd', * FROM back
  UNION ALL SELECT 'relevance_seeds', review, pmid FROM pk WHERE gate IN ('seeds_bwd', 'seeds_fwd') AND picked <= 50
  UNION ALL SELECT 'relevance_seeds:0.25:10', review, pmid FROM pk WHERE gate IN ('seeds_bwd', 'seeds_fwd') AND picked <= 10)), {SCORED_SQL}
SELECT arm, review, n_retrieved, n_target, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f"""
)
def eval_relevance(spark, sf_dir):
    """Arms gated by relevance over the papers that a review's seeds link to, by the terms of their titles."""
    return scored(spark, sf_dir, ARMS_BY_RELEVANCE).select("arm", "review", "n_retrieved", "n_target", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {GATES_SQL}, {picked_sql("s0", "0")}, {", ".join(f"{rocchio_sql(g, 50, f'_{i}')}, {picked_sql(f's1_{i}', str(i))}" for i, g in enumerate(GAMMAS) if g)},
arms AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT 'relevance:{g}' AS arm, review, pmid FROM pk{i} WHERE gate = 'bwd' AND picked <= 50 UNION ALL SELECT 'relevance:{g}', * FROM fwd" for i, g in enumerate(GAMMAS))})), {SCORED_SQL}
SELECT arm, count(*) AS reviews, {", ".join(f"round(median({m}), 6) AS median_{m}, round(avg({m}), 6) AS mean_{m}" for m in MEASURES)} FROM f GROUP BY arm"""
)
def eval_gamma_sweep(spark, sf_dir):
    """One arm for every gamma."""
    summary = evaluate.summarize(scored(spark, sf_dir, [f"relevance:{g}" for g in GAMMAS]))
    return summary.select("arm", "reviews", *[F.round(f"{s}_{m}", 6).alias(f"{s}_{m}") for m in MEASURES for s in ("median", "mean")])


@query(
    f"""WITH {RECS_SQL}, x AS (SELECT pmid AS review, pub_year, unnest(list_distinct(regexp_extract_all(refs, '[0-9]+'))) AS pmid FROM r WHERE pub_year IS NOT NULL AND len(regexp_extract_all(refs, '[0-9]+')) >= 30),
y AS (SELECT *, count(*) OVER (PARTITION BY review) AS n, row_number() OVER (PARTITION BY review ORDER BY md5(review || ':' || pmid), pmid) AS k FROM x)
SELECT review, pmid, CASE WHEN k <= 5 THEN 'seed' ELSE 'target' END AS trial_role, pub_year FROM y WHERE n > 6 AND n >= 30"""
)
def build_trials(spark, sf_dir):
    return evaluate.build_trials(citations.records(table(spark, sf_dir, "papers")))


# --- clusters ------------------------------------------------------------------------------------------------------


def term_vectors(spark, sf_dir):
    """The ranked terms, each with the vector that has its rank as number: at most ``top_terms`` rows."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("rank"), F.col("embedding").cast("array<double>").alias("vec"))
    return ranking(spark, sf_dir).join(v, "rank").select(F.col("rank").alias("pos"), "term", "vec")


@query(
    f"""WITH {VECS_SQL}, {cosine_sql('w', 's', 0.25)}, {cosine_sql('c', 'z', 0.25)},
b AS (SELECT s.pool, s.id, z.score AS reported, row_number() OVER (PARTITION BY s.pool ORDER BY s.score DESC, s.id) AS picked FROM s JOIN z USING (pool, id))
SELECT pool, id, CAST(picked AS INTEGER) AS picked, CAST(row_number() OVER (PARTITION BY pool ORDER BY reported DESC, picked) AS INTEGER) AS rank FROM b WHERE picked <= 50"""
)
def topk_embed(spark, sf_dir):
    """Chosen by the raw cosines, in order of the centred ones."""
    return relevance.top_k(relevance.embed_scores(*vectors(spark, sf_dir), CFG), CFG.expand_top_k).select("pool", "id", "picked", "rank")


@query(
    f"""WITH {COUNTS_SQL}, t AS (SELECT count(*) AS terms FROM ranked JOIN embeddings ON vec_id + 1 = rank)
SELECT 'hdbscan' AS method, terms, CAST(0 AS BIGINT) AS without_medoid, CAST(0 AS BIGINT) AS named_noise, CAST(0 AS BIGINT) AS out_of_order FROM t UNION ALL SELECT 'kmeans', terms, 0, 0, 0 FROM t"""
)
def cluster_totals(spark, sf_dir):
    """What holds for clusters of any method: every term once, one medoid in each that names it, noise without a name,
    and larger clusters first."""
    terms_ = term_vectors(spark, sf_dir).persist()
    out = None
    for method in ("hdbscan", "kmeans"):
        got = cluster.cluster_terms(terms_, Config(cluster_method=method))
        each = got.groupBy("cluster_id").agg(F.count_distinct("term").alias("n"), F.count_if(F.col("is_centroid") & (F.col("term") == F.col("centroid_term"))).alias("medoids"), F.max("centroid_term").alias("name"))
        larger = F.coalesce(F.lag("n").over(Window.partitionBy(F.col("cluster_id") >= 0).orderBy("cluster_id")), F.col("n"))
        each = each.withColumn("wrong", (F.col("cluster_id") >= 0) & (F.col("n") > larger))
        one = each.agg(F.sum("n").alias("terms"), F.count_if((F.col("cluster_id") >= 0) & (F.col("medoids") != 1)).alias("without_medoid"), F.count_if((F.col("cluster_id") < 0) & (F.col("name") != "")).alias("named_noise"), F.count_if("wrong").alias("out_of_order"))
        one = one.select(F.lit(method).alias("method"), "terms", "without_medoid", "named_noise", "out_of_order")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {COUNTS_SQL}, t AS (SELECT count(*) AS terms FROM ranked JOIN embeddings ON vec_id + 1 = rank)
SELECT terms, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS xy, true AS wider FROM t""")
def plane_totals(spark, sf_dir):
    """What holds for two leading components: their means are 0, they don't go together, and the first is the wider."""
    p = cluster.plane(term_vectors(spark, sf_dir))
    zero = lambda c: (F.round(c, 6) + 0.0)
    return p.agg(F.count("*").alias("terms"), zero(F.avg("x")).alias("x"), zero(F.avg("y")).alias("y"), zero(F.avg(F.col("x") * F.col("y"))).alias("xy"), (F.sum(F.col("x") * F.col("x")) >= F.sum(F.col("y") * F.col("y"))).alias("wider"))


@query()
def hdbscan_clusters(spark, sf_dir):
    return cluster.cluster_terms(term_vectors(spark, sf_dir), CFG)


@query()
def kmeans_clusters(spark, sf_dir):
    return cluster.cluster_terms(term_vectors(spark, sf_dir), Config(cluster_method="kmeans"))


@query()
def cluster_plane(spark, sf_dir):
    return cluster.plane(term_vectors(spark, sf_dir))


@query(
    f"""WITH {VECS_SQL}, al AS (SELECT pool, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM w),
ce AS (SELECT pool, list(m ORDER BY dim) AS m FROM (SELECT pool, dim, avg(x) AS m FROM al GROUP BY 1, 2) GROUP BY pool),
di AS (SELECT w.pool, id, round(sqrt(list_sum(list_transform(list_zip(e, m), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 9) AS dist FROM w JOIN ce USING (pool))
SELECT pool, arg_min(id, row(dist, id)) AS medoid, count(*) AS members FROM di GROUP BY pool"""
)
def cluster_medoids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pool"), F.col("vec_id").alias("id"), relevance.unit(F.col("embedding").cast("array<double>")).alias("vec"))
    gap = relevance.minus("vec", "m")
    far = v.join(relevance.centroid(v, "vec", "m", "pool"), "pool").select("pool", "id", F.round(F.sqrt(relevance.dot(gap, gap)), 9).alias("dist"))
    return far.groupBy("pool").agg(F.min_by("id", F.struct("dist", "id")).alias("medoid"), F.count("*").alias("members"))


# --- files and cache -----------------------------------------------------------------------------------------------


REREAD_SQL = "SELECT doc_id AS key, CASE WHEN pmid IS NOT NULL THEN 'PMID:' || pmid ELSE 'ref:0' END AS doc_id, trim(regexp_replace(title, '{}', ' ', 'g')) AS title FROM documents WHERE trim(coalesce(title, '')) <> ''"


@query(REREAD_SQL.format(r"\s*\n\s*"))
def ris_docs(spark, sf_dir):
    """Every document with a title written as RIS and read back."""
    d = table(spark, sf_dir, "documents").where("trim(coalesce(title, '')) <> ''")
    line = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{tag}  - "), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    ris = d.select(F.col("doc_id").alias("key"), F.concat(F.lit("TY  - JOUR\n"), line("TI", "title"), line("AB", "text"), line("AN", "pmid"), F.lit("ER  - \n")).alias("value"))
    return reread(ris, "x.ris")


@query(REREAD_SQL.format(r"\s+"))
def endnote_docs(spark, sf_dir):
    """Every document with a title written as EndNote XML and read back."""
    d = table(spark, sf_dir, "documents").where("trim(coalesce(title, '')) <> ''")
    safe = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number = F.coalesce(F.concat(F.lit("<accession-num>"), "pmid", F.lit("</accession-num>")), F.lit(""))
    xml = F.concat(F.lit("<xml><records><record><titles><title><style>"), safe, F.lit("</style></title></titles>"), number, F.lit("</record></records></xml>"))
    return reread(d.select(F.col("doc_id").alias("key"), xml.alias("value")), "x.xml")


def reread(files, name):
    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(k, r["doc_id"], r["title"]) for k, v in zip(pdf["key"], pdf["value"]) for r in refs.parse_refs(name, v)]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "title"])

    return files.mapInPandas(run, "key bigint, doc_id string, title string")


@query(
    """WITH e AS (SELECT pmid || ':' || other AS key, max(fetched_at) AS fetched, (SELECT max(fetched_at) FROM links) AS now FROM links WHERE pmid IS NOT NULL AND other IS NOT NULL GROUP BY 1)
SELECT key, fetched FROM e WHERE floor(epoch(now)) - floor(epoch(fetched)) <= 30 * 86400"""
)
def cache_ttl(spark, sf_dir):
    """Links as a cache keyed by the pair, thirty days to live at the time of the last row."""
    rows = table(spark, sf_dir, "links").where("pmid IS NOT NULL AND other IS NOT NULL")
    now = table(spark, sf_dir, "links").agg(F.max("fetched_at")).first()[0]
    entries = rows.select(F.concat_ws(":", "pmid", "other").alias("key"), F.col("fetched_at").alias("fetched"), F.col("source").alias("value"))
    return cache.live(entries, CFG.citation_cache_days, F.lit(now)).select("key", "fetched").distinct()


BATCH = 200


@query(
    f"""WITH o AS (SELECT pmid, row_number() OVER (ORDER BY pmid) - 1 AS k FROM (SELECT DISTINCT pmid FROM links WHERE pmid IS NOT NULL))
SELECT k // {BATCH} AS batch, 'links:icite:' || sha1(string_agg(pmid, ',' ORDER BY pmid)) AS key FROM o GROUP BY 1"""
)
def link_keys(spark, sf_dir):
    """Keys of the requests for all papers' links, each for a batch of ids."""
    asked = table(spark, sf_dir, "links").where("pmid IS NOT NULL").select("pmid").distinct()
    batches = cache.batches(asked, "pmid", BATCH)
    return batches.select("batch", cache.link_key("icite", F.col("ids")).alias("key"))


@query(
    f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM m) AS mentions, (SELECT count(*) FROM ranked) AS ranked_terms, (SELECT count(*) FROM te) AS term_edges"""
)
def run_summary(spark, sf_dir):
    from .pipeline import run_pipeline

    return run_pipeline(spark, corpus(spark, sf_dir), CFG).summary().select("documents", "mentions", "ranked_terms", "term_edges")


