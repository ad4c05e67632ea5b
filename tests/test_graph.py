import pytest
from pyspark.sql import functions as F

from litgraph.config import Config
from litgraph.operators import citations, graph, layout
from litgraph.operators.expansion import expand_pmids, link_table

REC = "pmid string, doc_seq long, title string, year int, journal string, citation_count long, authors array<string>, refs array<string>, cited_by array<string>"


def links(spark, rows):
    return spark.createDataFrame(rows, "id string, other string")


def test_bfs(spark):
    table = links(spark, [("1", "2"), ("1", "3"), ("2", "4"), ("3", "4"), ("3", "5"), ("4", "1"), ("2", None), (None, "9"), ("2", " ")])
    seeds = spark.createDataFrame([("1", 0), ("1", 4), (None, 1)], "id string, ord long")
    found = lambda rounds, cap=None: [r["id"] for r in graph.bfs(seeds, table, rounds, cap).orderBy("round", "ord", "id").collect()]
    assert found(0) == ["1"] and found(1) == ["1", "2", "3"] and found(2) == found(9) == ["1", "2", "3", "4", "5"]
    assert found(2, 3) == ["1", "2", "3"] and found(1, 2) == ["1", "2"] and found(9, 100) == ["1", "2", "3", "4", "5"]


def test_link_kinds(spark):
    rows = [("PMID:1", "2", "references", "icite"), ("1", "3", "cited_by", "icite"), ("1", "4", "references", "ncbi"), (None, "5", "references", "ncbi")]
    table = spark.createDataFrame(rows, "pmid string, other string, link string, source string")
    seeds = spark.createDataFrame([("1", 0)], "id string, ord long")
    ids = lambda **k: {r["id"] for r in expand_pmids(seeds, table, 1, max_records=None, **k).collect()} - {"1"}
    assert ids() == {"2", "3", "4"} and ids(link="references") == {"2", "4"} and ids(source="icite") == {"2", "3"}
    with pytest.raises(ValueError):
        link_table(table, link="sideways")
    with pytest.raises(ValueError):
        link_table(table, source="elsewhere")


def records(spark, rows):
    return spark.createDataFrame(rows, REC)


THREE = [
    ("1", 0, "One", 2000, "J", 500, ["Alice A", "Bob B"], [], ["2", "3"]),
    ("2", 1, "Two", 2005, "J", 50, ["Carol C", "Alice A"], ["1", "2"], ["3"]),
    ("3", 2, "Three", 2010, "J", 5, ["Dan D"], ["1", "2", "99"], []),
]


def papers(spark, pmids):
    return spark.createDataFrame([(i, f"PMID:{p}", p, "t", "") for i, p in enumerate(pmids)], "doc_seq long, doc_id string, pmid string, title string, journal string")


def test_paper_graph(spark):
    nodes, edges, rounds = citations.paper_graph(papers(spark, "123"), records(spark, THREE))
    got = [(r["pmid"], r["in_corpus_citations"], r["global_citations"]) for r in citations.most_cited(nodes).collect()]
    assert got == [("1", 2, 500), ("2", 1, 50), ("3", 0, 5)] and rounds == 0
    assert {tuple(r) for r in edges.select("citer", "cited").collect()} == {("2", "1"), ("3", "1"), ("3", "2")}
    assert citations.most_cited(nodes, 1).count() == 1


def test_senior_authors(spark):
    nodes, edges, _ = citations.author_graph(papers(spark, "123"), records(spark, THREE))
    assert {r["author"] for r in nodes.collect()} == {"Bob B", "Alice A", "Dan D"} and edges.count() == 3


def test_lab_accumulates(spark):
    rows = [("1", 0, "", 2000, "", 1, ["Mor M"], [], []), ("2", 1, "", 2001, "", 7, ["Lee L"], ["1"], []), ("3", 2, "", 2002, "", 4, ["X", "LEE L", "Lee l"], ["1"], [])]
    fixed = [r[:6] + ([("Lee L" if a == "LEE L" else a) for a in r[6]],) + r[7:] for r in rows]
    nodes, edges, _ = citations.author_graph(papers(spark, "123"), records(spark, fixed))
    lee = next(r for r in nodes.collect() if r["author"] == "Lee L")
    assert lee["papers"] == 2 and lee["global_citations"] == 11
    assert [tuple(r) for r in edges.select("citer", "cited", "weight").collect()] == [("Lee L", "Mor M", 2)]
    assert citations.author_graph(papers(spark, "123"), records(spark, fixed), Config(min_author_degree=2))[0].count() == 0


def test_k_core(spark):
    edges = spark.createDataFrame([("5", "6"), ("6", "7")], "citer string, cited string")
    nodes = spark.createDataFrame([("5",), ("6",), ("7",)], "node string")
    assert graph.k_core(nodes, edges, 2)[0].count() == 0
    assert graph.k_core(nodes, edges, 0)[2] == 0
    mutual = spark.createDataFrame([("a", "b"), ("b", "a")], "citer string, cited string")
    assert graph.k_core(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), mutual, 2)[0].count() == 2
    left, kept, _ = graph.k_core(spark.createDataFrame([(str(i),) for i in range(30)], "node string"), spark.createDataFrame([(str(i), str(j)) for i in range(30) for j in range(i) if (i * j) % 7 == 3], "citer string, cited string"), 3)
    degree = {r["node"]: r["degree"] for r in graph.degree(kept).collect()}
    assert all(degree[r["node"]] >= 3 for r in left.collect())


def test_author_names(spark):
    df = spark.createDataFrame([(["A  B", "a b", None, " ", "C", "A B"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(citations.unique_names(F.col("x"))).collect()] == [["A B", "C"], []]


def test_shells(spark):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(8)] + [("n0", "far"), ("far", "further")], "a string, b string")
    nodes = spark.createDataFrame([("hub",), ("far",), ("further",)] + [(f"n{i}",) for i in range(8)], "node string")
    at = {r["node"]: (r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2) ** 0.5 for r in layout.shells(nodes, edges).collect()}
    assert at["hub"] == 0 and abs(at["n0"] - at["far"]) < 1e-9 and at["far"] < at["n1"] and abs(at["further"] - 1) < 1e-9
    alone = layout.shells(spark.createDataFrame([("x",)], "node string"), edges.limit(0)).collect()
    assert [(r["node"], r["x"], r["degree"]) for r in alone] == [("x", 0.0, 0)]
