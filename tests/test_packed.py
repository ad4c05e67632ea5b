import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litgraph.operators.packed import ids, names, packed_values


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), ("  ", []), ("[]", []),
        ("10000001;10000002", ["10000001", "10000002"]),
        ("PMID: 10000001|PMID: 10000001", ["10000001", "10000001"]),
        ("10000001,,10000002 ; pmid:10000003\t", ["10000001", "10000002", "10000003"]),
        ('["10000001", "10000002"]', ["10000001", "10000002"]),
        ("'10000001','10000002'", ["10000001", "10000002"]),
    ],
)
def test_ids(text, want):
    assert ids(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), (" ", []), ("[]", []),
        ("A. Smith; Jones,  Mary; ", ["A. Smith", "Jones, Mary"]),
        ("Ann Smith, Bo Jones and Cy Hill", ["Ann Smith", "Bo Jones", "Cy Hill"]),
        ("Smith, A. B., Jones, C., & Hill, D.", ["Smith, A. B.", "Jones, C.", "Hill, D."]),
        ("Smith, Ann and Jones, B.", ["Smith, Ann", "Jones, B."]),
        ('Al Smith, "Jones, Mary", Bo Hill', ["Al Smith", "Jones, Mary", "Bo Hill"]),
        ('"Smith, A.","Jones, B."', ["Smith, A.", "Jones, B."]),
        ('[{"fullName": "Smith, A."}, {"name": "Bj\\u00f6rn \\"Bo\\" Hill"}]', ["Smith, A.", 'Björn "Bo" Hill']),
        ('Robert "Bob" Hill | C O\'Neil', ['Robert "Bob" Hill', "C O'Neil"]),
        ("Smith, Ann", ["Smith, Ann"]),
        ("Ann Smith,", ["Ann Smith"]),
        ("O'Neil Ann\r\nB Hill", ["O'Neil Ann", "B Hill"]),
    ],
)
def test_names(text, want):
    assert names(text) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", categories=("L", "P")), min_size=1).filter(lambda s: s.strip() and s.lower() != "null"), max_size=6))
def test_json_round_trip(values):
    clean = [" ".join(v.split()) for v in values]
    for ascii_only in (True, False):
        assert names(json.dumps(clean, ensure_ascii=ascii_only)) == clean


def test_rows_with_ordinals(spark):
    df = spark.createDataFrame([(1, "A B; C D", "1, 2", None, "x"), (2, None, "", "[]", "y"), (3, "E F", "7 7", "8", "z")], "rec_id long, authors string, refs string, cited_by string, pos string")
    got = sorted(map(tuple, packed_values(df).collect()))
    assert got == [(1, "authors", 1, "A B"), (1, "authors", 2, "C D"), (1, "refs", 1, "1"), (1, "refs", 2, "2"), (3, "authors", 1, "E F"), (3, "cited_by", 1, "8"), (3, "refs", 1, "7"), (3, "refs", 2, "7")]
    assert packed_values(df.limit(0)).count() == 0


def test_long_field():
    assert ids(",".join(["10000001"] * 50_000)) == ["10000001"] * 50_000


def test_long_fields_take_linear_time():
    import time

    start = time.perf_counter()
    names("; ".join(["'tHooft, G.", "O'Hara, K"] * 20_000))
    names("'" * 60_000)
    ids(" " * 100_000 + "'" * 20_000)
    assert time.perf_counter() - start < 20
