import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsense.operators import cells


def grid(spark, tables):
    return cells.to_cells(spark.createDataFrame(tables, "table_id string, data array<array<string>>"))


def rows(df):
    return {r.table_id: r.data for r in cells.to_rows(df).collect()}


RAGGED = [["Name", "Soundtrack", "Actors", "Character"], ["A", "x", "b"], [" ", "", "  "], ["C", None, "d", "e"], []]


def test_clean(spark):
    got = rows(cells.clean(grid(spark, [("t", RAGGED), ("u", [["", "a"], ["", "b"]])])))
    assert got == {"t": [["Name", "Soundtrack", "Actors", "Character"], ["A", "x", "b", ""], ["C", "", "d", "e"]], "u": [["a"], ["b"]]}


def test_blank_column_is_not_an_empty_one(spark):
    assert rows(cells.drop_empty_columns(grid(spark, [("t", [[" ", "a", ""]])]))) == {"t": [[" ", "a"]]}


def test_cleaning_twice_is_cleaning_once(spark):
    once = cells.clean(grid(spark, [("t", RAGGED)]))
    assert rows(cells.clean(once)) == rows(once)


def test_transposing_twice_is_nothing(spark):
    t = grid(spark, [("t", [["a", "b"], ["c", "d"], ["e", "f"]])])
    assert rows(cells.transpose(cells.transpose(t))) == rows(t)
    assert rows(cells.transpose(t))["t"] == [["a", "c", "e"], ["b", "d", "f"]]


@pytest.mark.parametrize("broken,right", [("cafÃ©", "café"), ("plain", "plain"), ("a\\u00e9b", "aéb"), ("né", "né"), ("日本", "日本"), ("back\\slash\\", "back\\slash\\")])
def test_repair(spark, broken, right):
    assert rows(cells.repair(grid(spark, [("t", [[broken]])])))["t"] == [[right]]


def test_sample(spark):
    t = grid(spark, [("long", [[str(k)] for k in range(1000)]), ("short", [["x"]] * 400)])
    got = rows(cells.sample(t))
    assert len(got["short"]) == 400 and len(got["long"]) == 400
    kept = [int(v[0]) for v in got["long"]]
    assert kept[:10] == list(range(10)) and kept == sorted(kept)
    assert rows(cells.sample(t)) == got
    assert rows(cells.sample(t, seed=1))["long"] != got["long"]


def test_empty(spark):
    assert cells.clean(grid(spark, [])).collect() == [] and cells.clean(grid(spark, [("t", [[""]])])).collect() == []


def test_many_tables_do_not_mix(spark):
    t = [(f"t{k}", [[str(k), ""], ["", str(k)]]) for k in range(30)]
    assert rows(cells.clean(grid(spark, t))) == {k: v for k, v in t}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", " ", "a", "bc"]), max_size=4), max_size=5))
def test_padding_makes_rectangles(spark, data):
    got = rows(cells.pad(grid(spark, [("t", data)])))
    wide = max((len(r) for r in data), default=0)
    assert got == ({"t": [r + [""] * (wide - len(r)) for r in data if r]} if wide else {})
