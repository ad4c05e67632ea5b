import math

from pyspark.sql import functions as F

from litgraph.config import Config
from litgraph.operators import cooccur, discovery, terms
from litgraph.sources.docs import documents_from_texts

CORPUS = [
    "Capsaicin activates TRPV1 and vasodilation follows.",
    "TRPV1 agonists cause vasodilation through cgrp release.",
    "Vasodilation relieves raynaud attacks with cgrp involvement.",
    "Raynaud patients lack cgrp mediated vasodilation.",
    "Unrelated soil bacteria fix nitrogen.",
    "Soil nitrogen feeds bacteria.",
]
LOOSE = Config(min_doc_freq=1, min_cooccurrence=1, min_pmi=None, min_b_links=1, top_terms=50)


def run(spark, texts, cfg):
    found = terms.extract(documents_from_texts(spark, texts), cfg)
    ranked = terms.rank_terms(found, len(texts), cfg)
    _, edges = cooccur.build(found, ranked, cfg)
    return found, ranked, edges


def test_planted_link(spark):
    found, ranked, edges = run(spark, CORPUS, LOOSE)
    assert "vasodilation" in {r["term"] for r in ranked.collect()}
    got = discovery.candidates(edges, LOOSE, ["trpv1"]).collect()
    pair = next(r for r in got if r["concept_c"] == "raynaud")
    assert pair["concept_a"] == "trpv1" and {"cgrp", "vasodilation"} <= set(pair["shared_b"]) and pair["direct_cooccurrence"] == 0


def test_symbol_counts_twice(spark):
    found = terms.extract(documents_from_texts(spark, ["TP53 binds éTP53 but 5HTR too"]), Config())
    got = [r["term"] for r in found.orderBy("pos").collect()]
    assert got == ["tp53", "tp53", "binds", "tp53", "htr", "too"]
    counts = {r["term"]: (r["corpus_count"], r["doc_freq"]) for r in terms.term_counts(found).collect()}
    assert counts["tp53"] == (3, 1)


def test_score_is_total_tf_idf(spark):
    found = terms.extract(documents_from_texts(spark, ["gene gene", "gene fog", "fog mist"]), Config())
    ranked = {r["term"]: r for r in terms.rank_terms(found, 3, Config()).collect()}
    assert math.isclose(ranked["gene"]["score"], 3 * (math.log(4 / 3) + 1)) and ranked["gene"]["rank"] == 1
    assert "mist" not in ranked


def test_ids_that_come_twice(spark):
    df = spark.createDataFrame([(0, "a", "", "first words"), (1, "b", "Title", "body"), (2, "a", "", "last words"), (3, None, "x", "y"), (4, "c", None, None)], "doc_seq long, doc_id string, title string, text string")
    got = {r["doc_id"]: (r["doc_seq"], r["content"]) for r in terms.one_per_id(df).collect()}
    assert got == {"a": (0, "last words"), "b": (1, "Title. body"), "c": (4, "")}


def test_pmi_counts_documents_with_two_terms(spark):
    found = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "c"), (3, "b"), (4, None)], "doc_seq long, term string")
    sets = cooccur.doc_term_sets(found)
    assert sets.count() == 3
    e = {(r["a"], r["b"]): (r["weight"], r["pmi"]) for r in cooccur.pmi_edges(sets, Config()).collect()}
    assert e == {("a", "b"): (2, round(math.log((2 / 3) / ((2 / 3) * (3 / 3))), 4))}


def test_zero_pmi_is_kept_and_none_disables(spark):
    found = spark.createDataFrame([(d, t) for d in range(3) for t in ("a", "b")], "doc_seq long, term string")
    sets = cooccur.doc_term_sets(found)
    assert [r["pmi"] for r in cooccur.pmi_edges(sets, Config()).collect()] == [0.0]
    assert cooccur.pmi_edges(sets, Config(min_pmi=0.1)).count() == 0 and cooccur.pmi_edges(sets, Config(min_pmi=None)).count() == 1


def test_no_ranked_terms_means_all(spark):
    found = spark.createDataFrame([(0, "a"), (0, "b")], "doc_seq long, term string")
    none = spark.createDataFrame([], "term string")
    assert cooccur.doc_term_sets(found, none).count() == 1


def test_row_order_does_not_matter(spark):
    _, _, edges = run(spark, CORPUS, LOOSE)
    found = terms.extract(documents_from_texts(spark, CORPUS), LOOSE)
    again = cooccur.build(found.orderBy(F.rand(3)).repartition(7), terms.rank_terms(found, 6, LOOSE), LOOSE)[1]
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, again.collect()))


def test_negative_limit_on_direct_links_rejects_all(spark):
    _, _, edges = run(spark, CORPUS, LOOSE)
    assert discovery.candidates(edges, Config(max_direct_cooccurrence=-1, min_b_links=1)).count() == 0


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_seq long, doc_id string, title string, text string")
    found = terms.extract(empty, Config())
    assert found.count() == 0 and terms.rank_terms(found, 0, Config()).count() == 0
    assert cooccur.build(found, None, Config())[1].count() == 0
