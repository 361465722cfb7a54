import pytest

from gridsense.functions import typing
from gridsense.operators import cells, columns
from gridsense.plans import views

CASES = {
    "2-3": ["RANGE"], "(2-3)": ["RANGE"], "[1,5)": ["RANGE"], "1–2": ["RANGE"], "12": ["CARDINAL"], "-3.5": ["CARDINAL"], "1½": ["CARDINAL"], "1,5": ["CARDINAL"],
    "999": ["CARDINAL"], "1000": ["DATE", "CARDINAL"], "2022": ["DATE", "CARDINAL"], "2023": ["CARDINAL"], "12%": ["PERCENT"], "3.5 %": ["PERCENT"],
    "192.168.0.1": ["IP ADDRESS"], "256.1.1.1": ["UNKNOWN"], "2001:db8:0:0:0:0:0:1": ["IPv6 ADDRESS"], "fe80::1": ["IPv6 ADDRESS"], "1::2::3": ["UNKNOWN"], "TRUE": ["BOOLEAN"], " no ": ["BOOLEAN"],
    "+44 20 7946 0958": ["PHONE NUMBER"], "020 7946": ["UNKNOWN"], "2 m/s": ["SPEED"], "3 km": ["DISTANCE"], "$5": ["MONEY"], "5 h": ["DURATION"], "some words 3 km in a long text": ["UNKNOWN"], "Paris": ["GPE"], "x" * 71: ["UNKNOWN"], "a@b.org": ["UNKNOWN"],
}


def test_values(spark):
    values = spark.createDataFrame([(v,) for v in [*CASES, "", "---", "é", "Paris"]], "value string")
    names = spark.createDataFrame([("paris", "GPE")], "name string, label string")
    got = {r.value: r.labels for r in typing.type_values(values, views.units(spark), typing.gazetteer(names)).collect()}
    assert got == CASES


@pytest.mark.parametrize("value,kind", [("Paris 12", "String_Normal"), ("A1234", "String_Number"), ("NATO", "String_Uppercase"), ("Q" * 120, "String_Normal")])
def test_string_kinds(spark, value, kind):
    got = typing.type_values(spark.createDataFrame([(value,)], "value string")).first()
    assert got.dtypes == [kind]


def test_settling_cells_with_several_types():
    assert columns.settle([["DATE", "CARDINAL"], ["CARDINAL"], ["CARDINAL"]]) == {"CARDINAL": 3}
    assert columns.settle([["CARDINAL", "DATE"], ["CARDINAL", "DATE"]]) == {"DATE": 2}
    assert columns.settle([[], []]) == {} and columns.settle([]) == {}


@pytest.mark.parametrize("values,yes", [(["1", "2", "3"], True), (["1", "1", "2"], True), (["5", "6", "x", "9", "10"], True), (["1", "3"], False), (["x"] * 5, False), (["0", "7", "8"], True), (["3", "2"], False)])
def test_index_columns(values, yes):
    assert columns._index(values) is yes


CITY = [["city", "country"], ["Paris", "France"], ["Berlin", "Germany"], ["Madrid", "Spain"], ["Springfield", "Italy"]]


def test_a_known_table(spark):
    """A small published example: orientation .1, header .09, key column 0 with .03."""
    names = [(n, "GPE") for n in ("Paris", "Berlin", "Madrid", "France", "Germany", "Spain", "Italy")]
    t = cells.to_cells(spark.createDataFrame([("t", CITY)], "table_id string, data array<array<string>>"))
    got = columns.preprocess(t, recogniser=typing.gazetteer(spark.createDataFrame(names, "name string, label string")))
    assert tuple(got["orientation"].first()) == ("t", "HORIZONTAL", 0.1)
    assert tuple(got["header"].first()) == ("t", True, 0.09)
    assert tuple(got["key"].first()) == ("t", 0, 0.03)
    types = {(r.col_idx, r["rank"]): (r.label, r.score) for r in got["column_types"].collect()}
    assert types == {(0, 0): ("GPE", 0.75), (0, 1): ("UNKNOWN", 0.25), (1, 0): ("GPE", 1.0)}


def test_orientation_of_a_table_and_its_transpose(spark):
    data = [["name", "age", "when", "ok"]] + [[f"person {chr(97 + k)}", str(k * 3 + 24), f"{k}%", "yes"] for k in range(6)]
    t = cells.to_cells(spark.createDataFrame([("h", data), ("v", [list(x) for x in zip(*data, strict=True)])], "table_id string, data array<array<string>>"))
    got = columns.preprocess(t)
    assert {r.table_id: r.orientation for r in got["orientation"].collect()} == {"h": "HORIZONTAL", "v": "VERTICAL"}
    back = {r.table_id: r.data for r in cells.to_rows(got["cells"]).collect()}
    assert back["h"] == back["v"] == data


def test_no_header_when_the_first_row_looks_like_the_rest(spark):
    t = cells.to_cells(spark.createDataFrame([("t", [["12%", "a"], ["13%", "b"], ["14%", "c"]])], "table_id string, data array<array<string>>"))
    assert columns.preprocess(t)["header"].first().has_header is False
