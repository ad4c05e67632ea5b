"""Queries of the training-data operators and their SQL. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.packed import packed_values
from ..plans.physical import written
from ..sources.tables import table
from . import cooccurrence, encoding, frequency, leakage, names, packing, setjoin

QUERIES = {}
SQL = {}

#: mentions as the problems read them: one row per document and normalised term
TERMS_SQL = r"""t AS (SELECT doc_id, pos, trim(regexp_replace(lower(term), '\s+', ' ', 'g'), ' .,;:()[]{}"''') AS term FROM mentions
  WHERE doc_id IS NOT NULL AND term IS NOT NULL),
dt AS (SELECT DISTINCT doc_id, term FROM t WHERE term <> '')"""

PAIRS_SQL = f"""WITH {TERMS_SQL},
r AS (SELECT doc_id FROM dt GROUP BY doc_id HAVING count(*) >= 2),
u AS (SELECT dt.* FROM dt JOIN r USING (doc_id)),
n AS (SELECT count(*) AS n FROM r),
df AS (SELECT term, count(*) AS df FROM u GROUP BY term),
k AS (SELECT u.* FROM u JOIN df USING (term), n WHERE df >= 4 AND df * 10 <= n),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS w FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2),
e AS (SELECT a, b, w, x.df AS df_a, y.df AS df_b FROM p JOIN df x ON x.term = a JOIN df y ON y.term = b, n WHERE w >= 4 AND w * n >= 10 * x.df * y.df)"""


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, sf_dir):
    return cooccurrence.relations(table(spark, sf_dir, "mentions"))


SQL["p2_found"] = f"""{PAIRS_SQL},
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT x.b AS a, y.b AS b FROM s x JOIN s y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a AS term_a, b AS term_b, 'together' AS relation FROM e
UNION ALL SELECT a, b, 'bridged' FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = c.a AND p.b = c.b)"""


@query
def p2_pairs(spark, sf_dir):
    return cooccurrence.scored_pairs(table(spark, sf_dir, "mentions"))


SQL["p2_pairs"] = f"""{PAIRS_SQL}
SELECT a AS term_a, b AS term_b, w, df_a, df_b, round(w * n::DOUBLE / (df_a * df_b), 6) AS lift,
  round(CASE WHEN w < df_a THEN (1 - df_b / n::DOUBLE) / (1 - w / df_a::DOUBLE) END, 6) AS conviction FROM e, n"""


@query
def p3_found(spark, sf_dir):
    return frequency.marked(table(spark, sf_dir, "mentions")).where("mark IS NOT NULL").select("term", "mark")


@query
def p3_terms(spark, sf_dir):
    return frequency.marked(table(spark, sf_dir, "mentions"))


SQL["p3_terms"] = f"""WITH {TERMS_SQL},
f AS (SELECT term, count(*) AS doc_freq FROM dt GROUP BY term),
c AS (SELECT term, count(*) AS corpus_count FROM (SELECT DISTINCT doc_id, pos, term FROM t WHERE term <> '') GROUP BY term)
SELECT term, corpus_count, doc_freq, CASE WHEN doc_freq = 1 THEN 'rare' WHEN doc_freq * 3 > (SELECT count(DISTINCT doc_id) FROM dt) THEN 'common' END AS mark
FROM f JOIN c USING (term)"""
SQL["p3_found"] = f"SELECT term, mark FROM ({SQL['p3_terms']}) WHERE mark IS NOT NULL"


@query
def p8_found(spark, sf_dir):
    return encoding.garbled(table(spark, sf_dir, "documents")).select("doc_id")


@query
def p8_restored(spark, sf_dir):
    return encoding.garbled(table(spark, sf_dir, "documents"))


#: Two- and three-byte sequences of UTF-8 read as Latin pages, which no sound text has; and characters that stand for
#: lost bytes
SURE = "Ã[\u00a1-\u00a9\u00ab\u00ad-\u00b9\u00bb-\u00bf]|â€[\u0153\u2122\u02dc\u201c]|�"


@query
def p8_sure(spark, sf_dir):
    """Of the garbled documents those with sequences that are never sound, which SQL can check."""
    docs = table(spark, sf_dir, "documents")
    return encoding.garbled(docs).join(docs.where(F.col("text").rlike(SURE)).select("doc_id"), "doc_id", "left_semi").select("doc_id")


SQL["p8_sure"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{SURE}')"


@query
def p6_found(spark, sf_dir):
    return packing.must_split(table(spark, sf_dir, "documents"))


SQL["p6_found"] = r"""SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')) > 1024"""


@query
def p6_packed(spark, sf_dir):
    return packing.packed(packing.token_counts(table(spark, sf_dir, "documents")))


@query
def p6_containers(spark, sf_dir):
    """Containers by how much of them is used: one row per used share in percent."""
    pieces = packing.packed(packing.token_counts(table(spark, sf_dir, "documents")))
    fill = pieces.groupBy("partition", "container").agg(F.sum("n_tokens").alias("tokens"))
    return fill.groupBy(F.floor(F.col("tokens") * 100 / packing.CAPACITY).alias("percent")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))


@query
def p6_totals(spark, sf_dir):
    """What no packing may change: one row of documents, tokens, pieces beyond the first, containers filled beyond
    capacity, documents cut though they fit, tokens that overlap in their container or are lost, and whether the
    containers number at most 1 % more than the tokens need (a hundred are free, for small inputs)."""
    counts = written(packing.token_counts(table(spark, sf_dir, "documents")))
    pieces = written(packing.packed(counts))
    bins = pieces.groupBy("partition", "container").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("top"))
    bins = bins.agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull"), F.sum(F.abs(F.col("top") - F.col("tokens"))).alias("gaps"), F.count("*").alias("containers"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).agg(F.count("*").alias("documents"), F.sum(F.col("pieces") - 1).alias("more_pieces"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("needless"))
    tight = F.col("containers") <= F.ceil(F.col("tokens") * 1.01 / packing.CAPACITY) + 100
    return docs.join(bins).select("documents", "tokens", "more_pieces", "overfull", "needless", "gaps", tight.alias("tight"))


SQL["p6_totals"] = r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')) AS n FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum((n - 1) // 1024) AS BIGINT) AS more_pieces, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS gaps, true AS tight FROM n WHERE n > 0"""

#: Letters and digits in lower case with one blank between words, markup taken out, as both engines write it
PLAIN_WORDS = {
    "spark": lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"<[^<>]{1,200}>|&#?\w{1,8};", " ")), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")),
    "sql": lambda c: rf"(' ' || trim(regexp_replace(lower(regexp_replace({c}, '<[^<>]{{1,200}}>|&#?\w{{1,8}};', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')",
}


@query
def p7_whole(spark, sf_dir):
    """Of the leaks those in which the text holds the whole passage word for word, which SQL can check."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    plain = PLAIN_WORDS["spark"]
    found = written(leakage.leaks(docs, items))
    both = found.join(docs.select("doc_id", plain("text").alias("t")), "doc_id").join(items.select("item_id", plain("passage").alias("p")), "item_id")
    return both.where(F.contains("t", F.col("p"))).select("doc_id", "item_id").distinct()


SQL["p7_whole"] = f"""SELECT doc_id, item_id FROM (SELECT doc_id, {PLAIN_WORDS["sql"]("text")} AS t FROM documents) d
JOIN (SELECT item_id, {PLAIN_WORDS["sql"]("passage")} AS p FROM eval_items WHERE passage <> '') i ON contains(t, p)"""


@query
def p7_found(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p7_items(spark, sf_dir):
    """Items that leaked, with the number of documents that hold them."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


@query
def p5_found(spark, sf_dir):
    return setjoin.similar_papers(table(spark, sf_dir, "papers"))


SETS_SQL = """s AS (SELECT f AS field_name, pmid, list_sort(list_distinct(regexp_extract_all(any_value(v), '[0-9]+'))) AS x FROM
  (SELECT 'refs' AS f, pmid, refs AS v FROM papers UNION ALL SELECT 'cited_by', pmid, cited_by FROM papers) WHERE pmid IS NOT NULL GROUP BY 1, 2)"""
SQL["p5_found"] = f"""WITH {SETS_SQL},
u AS (SELECT field_name, pmid, len(x) AS k, unnest(x) AS t FROM s WHERE len(x) >= 5)
SELECT field_name, a AS pmid_a, b AS pmid_b FROM (SELECT p.field_name, p.pmid AS a, q.pmid AS b, p.k + q.k AS sizes, count(*) AS c
  FROM u p JOIN u q ON p.field_name = q.field_name AND p.t = q.t AND p.pmid < q.pmid GROUP BY 1, 2, 3, 4) WHERE c * 1000 >= 600 * (sizes - c)"""


@query
def p5_classes(spark, sf_dir):
    return setjoin.paper_classes(table(spark, sf_dir, "papers"))


SQL["p5_classes"] = f"""WITH {SETS_SQL}
SELECT field_name, pmid, min(pmid) OVER (PARTITION BY field_name, x) AS class_key, count(*) OVER (PARTITION BY field_name, x) AS copies FROM s WHERE len(x) >= 5"""


@query
def p4_found(spark, sf_dir):
    return names.same_person(table(spark, sf_dir, "bylines"))


#: Two words of four letters or more: a family and a given name in either order
FULL_NAME = "^[A-Za-z]{4,},? [A-Za-z]{4,}$"


@query
def p4_alike(spark, sf_dir):
    """Of the links those between rows that have the same words in name and affiliation, which SQL can check. Names with
    initials leave their person open and are left out."""
    bylines = table(spark, sf_dir, "bylines")
    words = lambda c: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)), " ")
    b = written(bylines.where(F.col("affiliation").isNotNull() & F.col("author_name").rlike(FULL_NAME)).select("byline_id", words("author_name").alias("name"), words("affiliation").alias("place")))
    side = lambda s: b.select(F.col("byline_id").alias(f"byline_{s}"), F.col("name").alias(f"name_{s}"), F.col("place").alias(f"place_{s}"))
    linked = names.same_person(bylines).join(side("a"), "byline_a").join(side("b"), "byline_b")
    return linked.where("name_a = name_b AND place_a = place_b").select("byline_a", "byline_b")


SQL["p4_alike"] = f"""WITH b AS (SELECT byline_id, array_to_string(list_sort(regexp_extract_all(lower(author_name), '[a-z]+')), ' ') AS name,
  array_to_string(list_sort(regexp_extract_all(lower(affiliation), '[a-z]+')), ' ') AS place FROM bylines WHERE affiliation IS NOT NULL AND regexp_matches(author_name, '{FULL_NAME}'))
SELECT x.byline_id AS byline_a, y.byline_id AS byline_b FROM b x JOIN b y ON x.name = y.name AND x.place = y.place AND x.byline_id < y.byline_id"""


@query
def p4_persons(spark, sf_dir):
    """One row per byline with the person it names."""
    return names.persons(table(spark, sf_dir, "bylines"))


@query
def p4_paper_authors(spark, sf_dir):
    """One row per author of papers.authors and per byline with the person it names."""
    papers = table(spark, sf_dir, "papers")
    authors = packed_values(papers).where("field_name = 'authors'")
    return names.paper_authors(authors, papers, table(spark, sf_dir, "bylines"))
