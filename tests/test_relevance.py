import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.config import Config
from litgraph.operators import cluster, evaluate, relevance


def pool(spark):
    """One profile document; X shares a term with the tail, M does not; eight tail documents."""
    profile = spark.createDataFrame([("p", "s", "alpha"), ("p", "s", "beta")], "pool string, id string, term string")
    rows = [("p", "X", "alpha"), ("p", "M", "beta"), ("p", "X", "clean"), ("p", "M", "noise")] + [("p", f"t{i}", w) for i in range(8) for w in ("noise", f"w{i}")]
    cand = spark.createDataFrame(rows, "pool string, id string, term string")
    listed = spark.createDataFrame([("p", i, k) for k, i in enumerate(["X", "M"] + [f"t{i}" for i in range(8)] + ["blank"])], "pool string, id string, ord long")
    return profile, cand, listed


def test_negatives_break_the_tie(spark):
    plain = {r["id"]: r["score"] for r in relevance.term_scores(*pool(spark), Config(rocchio_gamma=0)).collect()}
    assert plain["X"] == plain["M"] == 0.5 and plain["blank"] == 0
    moved = {r["id"]: r["score"] for r in relevance.term_scores(*pool(spark), Config(expand_top_k=1)).collect()}
    assert moved["X"] > moved["M"] > max(moved[f"t{i}"] for i in range(8))


def test_golden_scores(spark):
    """Two negatives of ten, as half rounds to even: 0.7071 becomes 0.7566 and 0.6136."""
    profile = spark.createDataFrame([("p", "s", t) for t in ("a", "b")], "pool string, id string, term string")
    rows = [("p", "X", "a"), ("p", "M", "b"), ("p", "M", "z"), ("p", "X", "y")] + [("p", f"t{i}", w) for i in range(8) for w in ("z",)]
    n = [relevance.negatives(F.lit(k), Config(expand_top_k=1)) for k in (10,)]
    assert spark.range(1).select(*n).first()[0] == 2
    got = relevance.term_scores(profile, spark.createDataFrame(rows, "pool string, id string, term string"), spark.createDataFrame([("p", i, k) for k, i in enumerate(["X", "M"] + [f"t{i}" for i in range(8)])], "pool string, id string, ord long"), Config(expand_top_k=1))
    s = {r["id"]: r["score"] for r in got.collect()}
    assert s["X"] > s["M"] > s["t0"]


@pytest.mark.parametrize("n, cfg, want", [(10, Config(rocchio_neg_frac=0.9, expand_top_k=8), 2), (2, Config(), 0), (100, Config(rocchio_gamma=0), 0), (8, Config(expand_top_k=50), 0), (60, Config(), 10)])
def test_how_many_negatives(spark, n, cfg, want):
    assert spark.range(1).select(relevance.negatives(F.lit(n), cfg)).first()[0] == want


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    common = np.array([10.0, 0, 0, 0])
    p, c = rng.normal(size=(3, 4)) + common, rng.normal(size=(60, 4)) + common
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)

    def expected(p, c):
        q = unit(p.mean(axis=0))
        s = c @ q
        neg = np.argsort(np.round(s, 12), kind="stable")[: len(c) - 50]
        return c @ unit(q - 0.25 * unit(c[neg].mean(axis=0)))

    pu, cu = unit(p), unit(c)
    want, centred = expected(pu, cu), expected(unit(pu - cu.mean(axis=0)), unit(cu - cu.mean(axis=0)))
    pdf = spark.createDataFrame([("k", x.tolist()) for x in p] + [("k", None)], "pool string, vec array<double>")
    cdf = spark.createDataFrame([("k", i, i, x.tolist()) for i, x in enumerate(c)], "pool string, id long, ord long, vec array<double>")
    got = {r["id"]: r for r in relevance.embed_scores(pdf, cdf, Config()).collect()}
    assert all(abs(got[i]["score"] - want[i]) < 1e-9 and abs(got[i]["reported"] - centred[i]) < 1e-9 for i in range(60))
    kept = relevance.top_k(relevance.embed_scores(pdf, cdf, Config()), 5).orderBy("rank").collect()
    assert {r["id"] for r in kept} == set(np.argsort(-want)[:5]) and [r["reported"] for r in kept] == sorted((r["reported"] for r in kept), reverse=True)


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal([5, 0, 0], 0.05, (6, 3)), rng.normal([0, 5, 0], 0.05, (6, 3))])
    labels = cluster.hdbscan(cluster.density_space(x), 3)
    assert len(set(labels[:6])) == 1 and len(set(labels[6:])) == 1 and labels[0] != labels[6] and labels.min() >= 0
    assert len(set(cluster.kmeans(cluster.unit_rows(x), 3, 0))) == 3
    got = cluster.grouped(list("abcde"), np.eye(5), np.array([1, 1, 1, -1, -1]))
    assert got.query("cluster_id == -1")["centroid_term"].tolist() == ["", ""] and got.query("is_centroid").shape[0] == 1
    assert [cluster.auto_min_cluster_size(n) for n in (5, 50, 200)] == [3, 3, 5]
    assert (cluster.hdbscan(np.zeros((1, 3)), 2) == -1).all() and (cluster.hdbscan(np.zeros((8, 3)), 3) >= -1).all()


def test_cluster_terms(spark):
    rows = [(i, f"t{i}", [float(i % 2), float(1 - i % 2), 0.01 * i]) for i in range(12)] + [(12, "none", None)]
    df = spark.createDataFrame(rows, "pos int, term string, vec array<double>")
    assert cluster.cluster_terms(df, Config(cluster_method="kmeans", n_clusters=2)).count() == 12
    assert cluster.cluster_terms(df.limit(0), Config()).count() == 0
    assert cluster.plane(df).count() == 12
    with pytest.raises(ValueError):
        cluster.cluster_terms(df, Config(cluster_method="magic"))


def test_evaluation(spark):
    trials = spark.createDataFrame([("r", "s1", "seed", 2020), ("r", "b", "target", 2020), ("r", "c", "target", 2020), ("r", "d", "target", 2020), ("r", "s1", "target", 2020), (None, "x", "seed", 1)], "review string, pmid string, trial_role string, pub_year int")
    got = spark.createDataFrame([("arm", "r", x) for x in ("a", "b", "c", "s1", "c")], "arm string, review string, pmid string")
    r = evaluate.precision_recall(got, trials).first()
    assert (r["n_retrieved"], r["n_target"], r["hits"]) == (3, 3, 2) and abs(r["f1"] - 2 / 3) < 1e-12
    years = spark.createDataFrame([("a", 2015), ("b", 2020), ("c", 2023)], "pmid string, pub_year int")
    assert {x["pmid"] for x in evaluate.year_cutoff(got, trials, years).collect()} == {"a", "b", "s1"}
    scored = spark.createDataFrame([("x", v, v, v, 1) for v in (0.1, 0.2, 0.9)], "arm string, precision double, recall double, f1 double, n_retrieved long")
    s = evaluate.summarize(scored).first()
    assert s["median_f1"] == 0.2 and abs(s["mean_f1"] - 0.4) < 1e-12
    none = evaluate.precision_recall(got.limit(0), trials)
    assert none.count() == 0
    row = lambda arm, p, f: {"arm": arm, "median_precision": p, "median_recall": 0.1, "median_f1": f, "median_n_retrieved": 3, "reviews": 2}
    said = evaluate.interpret([row("forward", 0.9, 0.1), row("backward", 0.1, 0.2)])
    assert ": supported" in said and "gamma" not in said
    assert "not supported" in evaluate.interpret([row("forward", 0.1, 0.9), row("backward", 0.2, 0.1)]) and "tied" in evaluate.interpret([row("forward", 0.2, 0.9), row("backward", 0.2, 0.1)])
    said = evaluate.interpret([row("relevance:0.0", 0.1, 0.2), row("relevance:0.25", 0.1, 0.3), row("relevance:0.5", 0.1, 0.3)])
    assert "best gamma by median F1: 0.25" in said and "+0.1000" in said and not evaluate.interpret([row("relevance:0.25", 0.1, 0.3)])
    assert "relevance:0.5" in evaluate.summary_table([row("relevance:0.5", 0.1, 0.3)])
    assert evaluate.parse_arm("relevance_centred:0.5:20") == ("relevance", True, 0.5, 20)
    with pytest.raises(ValueError):
        evaluate.parse_arm("sideways")


def test_seed_links(spark):
    trials = spark.createDataFrame([("r", "1", "seed", None), ("r", "2", "seed", None)], "review string, pmid string, trial_role string, pub_year int")
    links = spark.createDataFrame([("1", "2"), ("1", "5"), ("6", "1"), ("6", "2")], "citer string, cited string")
    found = lambda d: {r["pmid"] for r in evaluate.seed_links(trials, links, d).collect()}
    assert found("backward") == {"5"} and found("forward") == {"6"} and found("both") == {"5", "6"}
    with pytest.raises(ValueError):
        evaluate.seed_links(trials, links, "sideways")


def test_rel_expand_scores_all_it_reaches(spark, sf_dir, monkeypatch):
    from litgraph import queries

    asked, whole = [], queries.expansion.expand_pmids
    monkeypatch.setattr(queries.expansion, "expand_pmids", lambda *a: asked.append(a[5]) or whole(*a))
    assert queries.QUERIES["rel_expand"](spark, sf_dir).count() and set(asked) == {None}


def test_places_of_any_key(spark):
    from litgraph.plans.physical import place_within

    r = np.random.default_rng(8)
    rows = [("hot" if r.random() < 0.6 else f"k{r.integers(4)}", int(r.integers(5)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, score long, id long")
    order = [F.desc("score"), F.col("id")]
    want = {i: n for k in {x[0] for x in rows} for n, (_, i) in enumerate(sorted((-s, i) for q, s, i in rows if q == k), 1)}
    for most in (10, 10_000):
        assert {x["id"]: x["at"] for x in place_within(df, "key", order, "at", most).collect()} == want
    assert place_within(df.limit(0), "key", order, "at").count() == 0


def test_top_k_is_the_same_in_parts(spark):
    r = np.random.default_rng(9)
    df = spark.createDataFrame([("p", i, i, float(r.integers(6)), float(r.integers(9))) for i in range(400)], "pool string, id long, ord long, score double, reported double")
    best = relevance.top_k(df, 20).select("id", "picked", "rank").collect()
    every = [x for x in relevance.top_k(df, 0).select("id", "picked").collect() if x["picked"] <= 20]
    assert {(x["id"], x["picked"]) for x in best} == {(x["id"], x["picked"]) for x in every} and sorted(x["rank"] for x in best) == list(range(1, 21))
    assert [x["id"] for x in sorted(best, key=lambda x: x["picked"])] == [x["id"] for x in df.orderBy(F.desc("score"), "ord").limit(20).collect()]


def gate_inputs(spark):
    trials = spark.createDataFrame([("r", "s", "seed", 2020), ("r", "t1", "target", 2020), ("q", "s", "seed", 2020)], "review string, pmid string, trial_role string, pub_year int")
    links = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "t3"), ("f1", "s"), ("f2", "s"), ("f2", "s"), ("s", "s2")], "citer string, cited string")
    texts = spark.createDataFrame([("s", "pain"), ("t1", "pain"), ("t2", "fish"), ("f1", "fish"), ("f2", "pain"), ("t3", "pain"), ("t3", "x")], "pmid string, term string")
    return trials, evaluate.linked(trials, links), texts


def test_gated_arms(spark):
    trials, found, texts = gate_inputs(spark)
    arms = ["relevance:0:1", "relevance_fwd:0:1", "relevance_seeds:0:1", "relevance_seeds_centred:0:2"]
    got = {}
    for x in evaluate.gated_arms(trials, found, texts, arms).collect():
        got.setdefault((x["arm"], x["review"]), set()).add(x["pmid"])
    assert got["relevance_seeds:0:1", "r"] == {"t1", "f2"} == got["relevance_seeds:0:1", "q"]
    assert got["relevance:0:1", "r"] == {"f1", "f2"} | {"t1"} or got["relevance:0:1", "r"] == {"f1", "f2", "t2"}
    assert got["relevance_fwd:0:1", "r"] == {"t1", "t2", "t3", "s2", "f2"}
    assert got["relevance_seeds_centred:0:2", "r"] == {"t1", "t3", "f1", "f2"}
    assert {x["pmid"] for x in evaluate.scored_pmids(trials, found, ["relevance"]).collect()} == {"s", "f1", "f2", "t1", "t2", "t3", "s2"}
    assert evaluate.capped_profile(found.select("review", "pmid"), 2).groupBy("review").count().collect()[0]["count"] == 2
    with pytest.raises(ValueError):
        evaluate.gated_arms(trials, found, texts, ["backward"])
    assert evaluate.gated_arms(trials.limit(0), found.limit(0), texts, arms).count() == 0


def test_gated_arms_by_vectors(spark):
    trials, found, _ = gate_inputs(spark)
    vec = {"s": [1.0, 0.0], "t1": [1.0, 0.1], "t2": [0.0, 1.0], "t3": [0.6, 0.8], "f1": [0.1, 1.0], "f2": [1.0, 0.2]}
    vectors = spark.createDataFrame([(k, v) for k, v in vec.items()], "pmid string, vec array<double>")
    got = evaluate.gated_arms(trials, found, None, ["relevance_seeds:0:1", "relevance_seeds_centred:0:1"], vectors=vectors).where("review = 'r'").collect()
    assert {(x["arm"], x["pmid"]) for x in got} == {(a, p) for a in ("relevance_seeds:0:1", "relevance_seeds_centred:0:1") for p in ("t1", "f2")}
