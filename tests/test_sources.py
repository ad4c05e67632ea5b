import os
from datetime import datetime, timedelta

import pytest

from litgraph import cli, sinks
from litgraph.config import Config
from litgraph.operators import citations
from litgraph.pipeline import run_pipeline
from litgraph.sources import cache, docs, ids, refs

RIS = """TY  - JOUR
TI  - Capsaicin and pain
AB  - First half
   second half.
AN  - 12345678
DO  - 10.1/x
ER  -
TY  - JOUR
T1  - Other title
N2  - Other abstract.
AN  - WOS:0001
ER  -
TY  - JOUR
AN  - 999
ER  -
"""
XML = "<?xml version='1.0'?><xml><records><record><titles><title><style>Capsaicin targets <i>TRPV1</i></style></title></titles><accession-num>87654321</accession-num><abstract><style>Some  text</style></abstract></record></records></xml>"


def test_ids(spark, tmp_path):
    assert ids.parse_pmid_input("PMID:12345, 67890 67890; pmid:111") == ["12345", "67890", "111"]
    assert ids.parse_pmid_input([12345, "67890"]) == ["12345", "67890"] and ids.parse_pmid_input(None) == ids.parse_pmid_input("") == []
    f = tmp_path / "l.txt"
    f.write_text("1\n2\n1")
    assert ids.parse_pmid_input(str(f)) == ids.parse_pmid_input(f"@{f}") == ["1", "2"]
    df = spark.createDataFrame([("PMID:1, 2 2",), (None,)], "x string")
    assert [r[0] for r in df.select(ids.split_ids("x")).collect()] == [["1", "2"], []]


def test_ris():
    a, b = refs.parse_refs("x.ris", RIS)
    assert a["doc_id"] == "PMID:12345678" and a["text"] == "First half second half." and a["doi"] == "10.1/x"
    assert b["doc_id"] == "ref:1" and b["title"] == "Other title" and b["text"] == "Other abstract."


def test_endnote_and_sniffing():
    (r,) = refs.parse_refs("any.txt", XML)
    assert r["title"] == "Capsaicin targets TRPV1" and r["pmid"] == "87654321" and r["text"] == "Some text"
    with pytest.raises(ValueError):
        refs.parse_refs("x.xml", "<?xml version='1.0'?><broken>")
    with pytest.raises(ValueError):
        refs.sniff("x.pdf", "whatever")


def test_read_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    (tmp_path / "b.xml").write_text(XML)
    assert {r["doc_id"] for r in refs.read_refs(spark, str(tmp_path)).collect()} == {"PMID:12345678", "ref:1", "PMID:87654321"}


def test_cache(spark, tmp_path):
    c = cache.Cache(spark, str(tmp_path / "c"), 30)
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    made = []

    def produce(missing):
        made.append(sorted(r["key"] for r in missing.collect()))
        return missing.selectExpr("key", "'[]' AS value")

    assert c.through(keys, produce).count() == 2 and c.through(keys, produce).count() == 2
    c.through(keys.union(spark.createDataFrame([("n",)], "key string")), produce)
    assert made == [["a", "b"], ["n"]]
    now = datetime(2024, 6, 1)
    old = spark.createDataFrame([("a", now - timedelta(days=31), "x"), ("b", now - timedelta(days=29), "y"), ("a", now - timedelta(days=40), "z")], cache.SCHEMA)
    from pyspark.sql import functions as F

    assert [r["key"] for r in cache.live(old, 30, F.lit(now)).collect()] == ["b"] and cache.live(old, None).count() == 2

    def broken(missing):
        raise OSError("service down")

    with pytest.raises(OSError):
        c.through(spark.createDataFrame([("q",)], "key string"), broken)
    assert c.get(spark.createDataFrame([("q",)], "key string"))[1].count() == 1
    off = cache.Cache(spark, str(tmp_path / "off"), 0)
    off.put(spark.createDataFrame([("a", "1")], "key string, value string"))
    assert not os.path.exists(off.path)


def test_pipeline_and_sinks(spark, tmp_path):
    texts = ["Capsaicin TRPV1 vasodilation", "TRPV1 vasodilation cgrp", "Vasodilation raynaud cgrp", "Raynaud cgrp vasodilation"]
    d = spark.createDataFrame([(i, f"PMID:{i + 1}", "", t, str(i + 1), "") for i, t in enumerate(texts)], "doc_seq long, doc_id string, title string, text string, pmid string, journal string")
    rec = spark.createDataFrame([(str(i + 1), i, f"T{i} <b>", 2000 + i, "J", i, [f"A{i}"], [str(j + 1) for j in range(i)], []) for i in range(4)], "pmid string, doc_seq long, title string, year int, journal string, citation_count long, authors array<string>, refs array<string>, cited_by array<string>")
    vec = spark.createDataFrame([(t, [1.0, float(len(t))]) for t in ("vasodilation", "cgrp", "raynaud", "trpv1")], "term string, vec array<double>")
    cfg = Config(min_doc_freq=1, min_cooccurrence=1, min_pmi=None, min_b_links=1, do_clustering=True, cluster_method="kmeans", n_clusters=2)
    result = run_pipeline(spark, d, cfg, records=rec, term_vectors=vec, out=str(tmp_path / "out"))
    assert {"terms", "candidates", "pmids", "clusters", "citations", "network", "network_3d", "authors", "author_papers", "graphml"} <= set(result.outputs)
    assert all(os.path.exists(p) for p in result.outputs.values())
    assert [r["value"] for r in spark.read.text(result.outputs["pmids"]).collect()] == ["1", "2", "3", "4"]
    assert spark.read.csv(result.outputs["citations"], header=True).columns == list(sinks.PAPER_COLUMNS)
    assert "</b>" not in open(result.outputs["network"]).read().split("const G=")[1].split(";const")[0]
    row = result.summary().first()
    assert row["documents"] == 4 and row["ranked_terms"] > 0
    with pytest.raises(ValueError):
        run_pipeline(spark, d.limit(0), cfg)


def test_load_documents(spark):
    library = spark.createDataFrame([(i, f"PMID:{i}", "", f"text {i}", str(i)) for i in range(1, 6)], "doc_seq long, doc_id string, title string, text string, pmid string")
    links = spark.createDataFrame([("1", "3", "references", "icite"), ("3", "4", "references", "icite")], "pmid string, other string, link string, source string")
    got = docs.load_documents(spark, library=library, pmids="2 1", texts=["free"], links=links, cfg=Config(expand_rounds=2))
    assert [r["doc_id"] for r in got.orderBy("doc_seq").collect()] == ["PMID:2", "PMID:1", "doc0", "PMID:3", "PMID:4"]
    assert docs.load_documents(spark, library=library, query="text 5").count() == 1
    with pytest.raises(ValueError):
        docs.load_documents(spark)


def test_cli_needs_input(capsys):
    assert cli.main([]) == 2 and "--pmids" in capsys.readouterr().err


def test_records_keep_the_last(spark):
    rows = [(1, "7", "old", 2000, "J", 1, "A B", "1;2", ""), (2, "7", "new", 2001, "J", None, "C D; E F", None, "[3, 4]"), (3, None, "x", 1, "", 1, "", "", "")]
    df = spark.createDataFrame(rows, "rec_id long, pmid string, title string, pub_year int, journal string, citation_count long, authors string, refs string, cited_by string")
    (r,) = citations.records(df).collect()
    assert r["title"] == "new" and r["authors"] == ["C D", "E F"] and r["refs"] == [] and r["cited_by"] == ["3", "4"]


def relevance_inputs(spark):
    library = spark.createDataFrame([(i, f"PMID:{i}", "", t, str(i)) for i, t in enumerate(["pain receptor trial", "pain receptor block", "fish scales growth", "receptor pain model", "cake and butter", "pain block receptor"], 1)], "doc_seq long, doc_id string, title string, text string, pmid string")
    links = spark.createDataFrame([("1", "2", "references", "icite"), ("1", "3", "references", "icite"), ("1", "4", "cited_by", "icite"), ("1", "5", "cited_by", "ncbi"), ("1", "6", "references", "icite")], "pmid string, other string, link string, source string")
    return library, links


def test_relevance_expansion_through_the_loader(spark, tmp_path):
    library, links = relevance_inputs(spark)
    cfg = Config(expand_rounds=1, expand_strategy="relevance", expand_top_k=1, rocchio_gamma=0, min_doc_freq=1, min_cooccurrence=1, min_pmi=None, do_citation_network=False)
    loaded = docs.load_documents(spark, library=library, pmids="1", texts=["free text of pain"], links=links, cfg=cfg)
    result = run_pipeline(spark, loaded, cfg, library=library, links=links, out=str(tmp_path / "out"))
    assert [r["doc_id"] for r in result.documents.orderBy("doc_seq").collect()] == ["PMID:1", "doc0", "PMID:4", "PMID:2"]
    assert [r["value"] for r in spark.read.text(result.outputs["pmids"]).collect()] == ["1", "4", "2"]
    row = result.summary().first()
    assert (row["added_forward"], row["added_backward"]) == (1, 1)
    more = run_pipeline(spark, loaded, Config(**{**cfg.__dict__, "expand_top_k": 5}), library=library, links=links)
    assert [r["doc_id"] for r in more.documents.orderBy("doc_seq").collect()] == ["PMID:1", "doc0", "PMID:4", "PMID:5", "PMID:2", "PMID:6", "PMID:3"]


def test_models_of_vectors(spark):
    from litgraph.operators import embed

    letters_model = lambda: lambda texts: [[t.count("a") + 1.0, t.count("e") + 1.0, float(len(t))] for t in texts]

    def broken_model():
        raise RuntimeError("no weights")

    df = spark.createDataFrame([(1, "aa e"), (2, None), (3, " ")], "id long, text string")
    assert {r["id"]: r["vec"] for r in embed.embed(df, "id", "text", letters_model, Config(embed_batch_size=1)).collect()} == {1: [3.0, 2.0, 4.0], 2: None, 3: None}
    with pytest.warns(UserWarning):
        assert embed.embedded_or_none(df, "id", "text", broken_model) is None
    library, links = relevance_inputs(spark)
    from litgraph.operators import expansion

    cfg = Config(expand_top_k=1, rocchio_gamma=0)
    seed = library.where("doc_id = 'PMID:1'")
    by_terms = {r["doc_id"] for r in expansion.relevance_guided_expand(seed, library, links, cfg).collect()}
    with pytest.warns(UserWarning):
        assert {r["doc_id"] for r in expansion.relevance_guided_expand(seed, library, links, cfg, embedder=broken_model).collect()} == by_terms
    assert expansion.relevance_guided_expand(seed, library, links, cfg, embedder=letters_model).count() == 2


def test_links_through_the_cache(spark, tmp_path):
    from litgraph.sources import services

    library, links = relevance_inputs(spark)
    asked = []

    def fetch(ids):
        asked.append(sorted(r["id"] for r in ids.collect()))
        return links.join(ids.withColumnRenamed("id", "pmid"), "pmid", "left_semi")

    held = services.cached(spark, fetch, str(tmp_path / "links"))
    cfg = Config(expand_rounds=2)
    for _ in range(2):
        got = docs.load_documents(spark, library=library, pmids="1", links=held, cfg=cfg)
        assert {r["doc_id"] for r in got.collect()} == {f"PMID:{i}" for i in range(1, 7)}
    assert asked == [["1"], ["2", "3", "4", "5", "6"]]  # those without links are held as well


def test_search(spark):
    library, _ = relevance_inputs(spark)
    found = lambda q: [r["pmid"] for r in docs.search(library, q, 10).collect()]
    assert found("pain receptor") == ["1", "2", "4", "6"] and found("pain NOT block") == ["1", "4"] and found("fish OR cake AND butter") == ["3", "5"] and found('"pain block"') == ["6"]


def test_batches(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10, 31)], "pmid string")
    assert [(r["batch"], len(r["ids"])) for r in cache.batches(df, "pmid", 8).orderBy("batch").collect()] == [(0, 8), (1, 8), (2, 5)]


def test_odd_reference_files():
    ris = "\ufeffAN  - 5\nTI  - \nT1  - other\nAB  - a\nAB  - b\n c\n\nTY  - JOUR\nT1  - two\nER  - \nER  - \n"
    a, b = refs.parse_refs("x.ris", ris + "TY  - JOUR\nER  - \n")
    assert (a["title"], a["text"], a["pmid"]) == ("", "a b c", "5") and b["title"] == "two"
    assert refs.sniff("x.ris", "TY  - JOUR\nAB  - a <record of note\nER  - \n") == "ris"
    xml = "<xml><records><record><titles><title>A</title><title>B</title></titles></record><record/><record><abstract>x</abstract></record></records></xml>"
    assert [(r["doc_id"], r["title"], r["text"]) for r in refs.parse_refs("x", xml)] == [("ref:0", "A", ""), ("ref:2", "", "x")]


def test_repeated_ids_keep_first_place_and_last_content(spark):
    from litgraph.operators import graph, terms

    df = spark.createDataFrame([(3, "a", "", "late"), (1, "a", "", "early"), (2, "b", "t", None), (5, None, "", "x")], "doc_seq long, doc_id string, title string, text string")
    assert {(r["doc_seq"], r["doc_id"], r["content"]) for r in terms.one_per_id(df).collect()} == {(1, "a", "late"), (2, "b", "t. ")}
    assert {(r["doc_id"], r["text"]) for r in graph.last_wins(df, "doc_id", "doc_seq").collect()} == {("a", "late"), ("b", None)}
