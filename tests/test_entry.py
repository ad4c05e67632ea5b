import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from litgraph import queries

CHECKED = ["p1_id_values", "doc_content", "term_mentions", "rank_terms", "trim_graph", "abc_candidates", "citation_ranking", "author_ranking", "kcore_papers", "bfs_capped", "rel_terms_rocchio", "rel_embed", "eval_summary", "shell_layout", "cache_ttl"]


def cell(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(queries.SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark, sf_dir):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_core_stands_alone():
    root = os.path.dirname(os.path.abspath(queries.__file__))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"import llm|\.llm", open(os.path.join(folder, f)).read()), f
