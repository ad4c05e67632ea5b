"""Terms, pairs and similar sets, against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from litgraph.llm import cooccurrence, frequency, setjoin


def mentions(spark, seed=1, docs=300):
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for pos in range(r.randint(0, 9)):
            t = "Hot" if r.random() < 0.33 else r.choice([f" W{r.randint(0, 25)}. ", f"x{r.randint(0, 400)}", "a  b", None, " ", "(Q)"])
            rows.append((d, pos, t, "x"))
            if r.random() < 0.2:
                rows.append((d, pos, t, "x"))
    for d in range(docs, docs + 12):  # terms that stand together, and a third never with the first
        rows += [(d, 0, "left" if d % 2 else "right", "x")] + [(d, k, f"mid{k}", "x") for k in (1, 2, 3)]
    rows += [(None, 1, "w1", "x")]
    return spark.createDataFrame(rows, "doc_id long, pos int, term string, df string"), rows


def normal(t):
    return None if t is None else " ".join(t.lower().split()).strip(" .,;:()[]{}\"'") or None


@pytest.mark.parametrize("heavy", [1, 32])
def test_frequencies(spark, heavy):
    df, rows = mentions(spark)
    kept = {(d, p, normal(t)) for d, p, t, _ in rows if d is not None and normal(t)}
    count, docs = Counter(t for _, _, t in kept), defaultdict(set)
    for d, _, t in kept:
        docs[t].add(d)
    got = {r["term"]: (r["corpus_count"], r["doc_freq"]) for r in frequency.term_frequency(df, heavy).collect()}
    assert got == {t: (count[t], len(docs[t])) for t in count}
    n = len({d for d, _, _ in kept})
    marks = {r["term"]: r["mark"] for r in frequency.marked(df).collect()}
    assert all(m == ("rare" if len(docs[t]) == 1 else "common" if len(docs[t]) * 3 > n else None) for t, m in marks.items())


def test_frequencies_of_nothing(spark):
    df, _ = mentions(spark)
    assert frequency.term_frequency(df.limit(0)).count() == 0 and frequency.marked(df.limit(0)).count() == 0
    assert cooccurrence.relations(df.limit(0)).count() == 0


def test_relations(spark):
    df, rows = mentions(spark)
    terms = defaultdict(set)
    for d, _, t, _ in rows:
        if d is not None and normal(t):
            terms[d].add(normal(t))
    sets = [s for s in terms.values() if len(s) >= 2]
    n, count, pair = len(sets), Counter(t for s in sets for t in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    together = {p for p, w in pair.items() if w >= 4 and w * n >= 10 * count[p[0]] * count[p[1]]}
    near = defaultdict(set)
    for a, b in together:
        near[a].add(b)
        near[b].add(a)
    bridged = {(a, b) for a, b in itertools.combinations(sorted(near), 2) if (a, b) not in pair and len(near[a] & near[b]) >= 3}
    got = {(r["term_a"], r["term_b"], r["relation"]) for r in cooccurrence.relations(df).collect()}
    assert got == {(*p, "together") for p in together} | {(*p, "bridged") for p in bridged} and bridged and together
    scored = {(r["term_a"], r["term_b"]): r for r in cooccurrence.scored_pairs(df).collect()}
    assert set(scored) == together
    for (a, b), r in scored.items():
        assert r["w"] == pair[a, b] and (r["df_a"], r["df_b"]) == (count[a], count[b]) and abs(r["lift"] - pair[a, b] * n / count[a] / count[b]) < 1e-5


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_sets(spark):
    """A token in nearly all records, clusters of near copies larger than a node, exact copies, short and odd fields."""
    r = random.Random(7)
    rows, k = [], 0
    for _ in range(400):
        rows.append((f"{k:08d}", ["99"] + [str(r.randint(1000, 9999)) for _ in range(r.randint(3, 25))]))
        k += 1
    base = [str(i) for i in range(100, 120)]
    for _ in range(120):
        rows.append((f"{k:08d}", ["99"] + r.sample(base, 18)))
        k += 1
    for _ in range(70):
        rows.append((f"{k:08d}", ["5", "6", "7", "8", "9"]))
        k += 1
    df = spark.createDataFrame([(p, "; ".join(v), None, "x") for p, v in rows] + [("odd1", None, "", "x"), (None, "1 2 3 4 5", "", "x"), ("odd2", "[]", "1,2,3", "x")], "pmid string, refs string, cited_by string, cid string")
    sets = {p: set(v) for p, v in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a]) >= 5 and len(sets[b]) >= 5 and jaccard(sets[a], sets[b]) >= 0.6}
    copies = sorted(p for p, v in sets.items() if v == {"5", "6", "7", "8", "9"})
    star = {(copies[0], p) for p in copies[1:]}
    want = {w for w in want if not (w[0] in copies and w[1] in copies)} | star
    got = {(x["pmid_a"], x["pmid_b"]) for x in setjoin.similar_papers(df).collect()}
    assert not got - want
    assert len(got & want) >= 0.99 * len(want) and star <= got
    cls = {x["pmid"]: x["copies"] for x in setjoin.paper_classes(df).collect()}
    assert cls[copies[0]] == 70 and "odd2" not in cls
    assert setjoin.similar_papers(df.limit(0)).count() == 0


def test_sketch_agrees_with_similarity():
    h = lambda s: np.array([setjoin.token_hash(t) for t in s], np.uint64)
    bits = lambda s: np.unpackbits(np.array(setjoin.sketch(h(s)), np.int64).view(np.uint8))
    r = random.Random(2)
    gaps = []
    for _ in range(200):
        common = [str(r.random()) for _ in range(12)]
        a, b = set(common) | {str(r.random()) for _ in range(4)}, set(common) | {str(r.random()) for _ in range(4)}
        gaps.append(int((bits(sorted(a)) != bits(sorted(b))).sum()))
    assert abs(np.mean(gaps) - 128 * (1 - 0.6) / 2) < 2


@pytest.mark.parametrize("block", [2, 1000])
def test_shared_partners_of_hubs(spark, block):
    """Against brute force: one partner of all, a second of most, and chance; blocks smaller than a hub."""
    r = np.random.default_rng(3)
    edges = {(0, v) for v in range(2, 40)} | {(1, v) for v in range(2, 40, 2)}
    edges |= {(int(min(x)), int(max(x))) for x in r.integers(2, 40, (90, 2)) if x[0] != x[1]}
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(40)}
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if len(near[a] & near[b]) >= 3}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    got = [tuple(x) for x in cooccurrence.sharing(df, 3, block).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert cooccurrence.sharing(df.limit(0)).count() == 0


def test_a_document_and_a_term_of_a_third_of_the_rows(spark):
    rows = [(1, k, f"t{k % 50}") for k in range(300)] + [(k, 1, "all") for k in range(300)] + [(k, 2, f"t{k % 50}") for k in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, pos int, term string")
    got = {x["term"]: (x["corpus_count"], x["doc_freq"], x["mark"]) for x in frequency.marked(df).collect()}
    want = {}
    for d, p, t in set(rows):
        want.setdefault(t, []).append(d)
    assert got == {t: (len(d), len(set(d)), "common" if len(set(d)) * 3 > 300 else None) for t, d in want.items()}


def test_sets_with_three_tokens_of_all_and_a_large_cluster(spark, monkeypatch):
    """Small nodes, so that levels go deep: hot tokens are split away, a cluster of like sets is compared in blocks."""
    monkeypatch.setattr(setjoin, "SMALL", 6)
    monkeypatch.setattr(setjoin, "ALIKE_BLOCK", 10)
    r = random.Random(11)
    hot = ["1", "2", "3"]
    rows = [hot + [str(r.randint(1000, 99999)) for _ in range(r.randint(6, 20))] for _ in range(300)]
    for _ in range(20):
        base = r.choice(rows)
        rows.append(base[:-1] + [str(r.randint(1000, 99999))])
    core = [str(i) for i in range(200, 230)]
    rows += [hot + r.sample(core, 27) for _ in range(90)]
    df = spark.createDataFrame([(f"{k:08d}", " ".join(v), None) for k, v in enumerate(rows)], "pmid string, refs string, cited_by string")
    sets = [set(v) for v in rows]
    want = {(f"{a:08d}", f"{b:08d}") for a, b in itertools.combinations(range(len(sets)), 2) if jaccard(sets[a], sets[b]) >= 0.6}
    got = {(x["pmid_a"], x["pmid_b"]) for x in setjoin.similar_papers(df).collect()}
    assert not got - want and len(got) >= 0.99 * len(want)


def test_copies_in_all_pairs(spark):
    df = spark.createDataFrame([(f"{k:03d}", "1 2 3 4 5", "") for k in range(70)] + [("999", "1 2 3 4 5 6", "")], "pmid string, refs string, cited_by string")
    assert setjoin.similar_papers(df).count() == 69 + 1
    assert setjoin.similar_papers(df, copies=None).count() == 70 * 69 // 2 + 70
