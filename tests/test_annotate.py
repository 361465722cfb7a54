"""A small world: people with countries and birth years; tables with noise; what the annotation must find."""

import pytest

from gridsense.functions import typing
from gridsense.operators import annotate, cells, columns, graph, lookup
from gridsense.plans import views

PEOPLE = [("Q1", "Ada Lindqvist", "Q11", "1901"), ("Q2", "Bruno Castell", "Q12", "1915"), ("Q3", "Clara Osterman", "Q11", "1922"), ("Q4", "Dmitri Valkov", "Q13", "1933"), ("Q5", "Elena Marchetti", "Q12", "1947")]
LANDS = [("Q11", "Norrland"), ("Q12", "Estravia"), ("Q13", "Kalmora")]
TWIN = ("Q9", "Ada Lindqvist", "Q13", "1850")  # a namesake


def world(spark):
    rows = [(q, "P27", False, land, "NORMAL", 0) for q, _, land, _ in [*PEOPLE, TWIN]] + [(q, "P569", False, y, "DateTime-Year", 1) for q, *_, y in [*PEOPLE, TWIN]]
    rows += [(q, "P31", False, "T1", "NORMAL", 2) for q, *_ in [*PEOPLE, TWIN]] + [(q, "P31", False, "T2", "NORMAL", 2) for q, _ in LANDS] + [("T1", "P279", False, "T0", "NORMAL", 0), ("T2", "P279", False, "T0", "NORMAL", 0)]
    edges = graph.mirrored(spark.createDataFrame(rows, "subject string, pid string, backward boolean, object string, tag string, ord int"))
    dump = [(q, 1.0, [n], None, None) for q, n, *_ in PEOPLE] + [(TWIN[0], 90.0, [TWIN[1]], None, None)] + [(q, 5.0, [n], None, None) for q, n in LANDS]
    return edges, lookup.label_documents(spark.createDataFrame(dump, "ID string, page_rank double, labels array<string>, main_aliases array<string>, sub_aliases array<string>"))


def run(spark, tables):
    edges, index = world(spark)
    t = cells.to_cells(spark.createDataFrame(tables, "table_id string, data array<array<string>>"))
    body = t.where("row_idx > 0")
    kinds = annotate.classify_columns(body, columns.column_types(t, typing.type_values(t), "labels", 3))
    ranked = lookup.lookup(annotate.mentions(body, kinds), index, 20)
    types = graph.types_by_level(ranked, edges)
    out = annotate.annotate(body, kinds, ranked, edges, types, graph.supertypes(edges), graph.type_neighbours(types, edges))
    return {k: {tuple(r[:-2]) if k == "cpa" else tuple(r): r for r in df.collect()} for k, df in out.items()}


LAND = dict(LANDS)
TABLE = [["name", "land", "born"]] + [[n, LAND[land], y] for _, n, land, y in PEOPLE]


def found(got, table):
    return {(r.row_idx, r.col_idx): r.entity for r in got["cea"].values() if r.table_id == table and r["rank"] == 1}


@pytest.fixture(scope="module")
def result(spark):
    noisy = [TABLE[0], *[[n.replace("a", "", 1), land, y] for n, land, y in TABLE[1:]]]
    shuffled = [TABLE[0], *reversed(TABLE[1:])]
    return run(spark, [("t", TABLE), ("noisy", noisy), ("copy", TABLE), ("rev", shuffled)])


@pytest.mark.parametrize("table", ["t", "noisy", "copy"])
def test_cells_find_their_entities(result, table):
    got = found(result, table)
    assert got == {**{(k + 1, 0): p[0] for k, p in enumerate(PEOPLE)}, **{(k + 1, 1): p[2] for k, p in enumerate(PEOPLE)}}


def test_relations_and_types(result):
    rel = {(r.table_id, r.head, r["tail"]): r.path for r in result["cpa"].values() if r["rank"] == 1}
    assert rel["t", 0, 1] == "P27" and rel["t", 0, 2] == "P569"
    kinds = {(r.table_id, r.col_idx): r.type for r in result["cta"].values() if r["rank"] == 1}
    assert kinds["t", 0] == "T1" and kinds["t", 1] == "T2"


def test_order_of_rows_and_other_tables_change_nothing(result):
    a, b = found(result, "t"), found(result, "rev")
    assert {(6 - r, c): e for (r, c), e in b.items()} == a
    score = lambda t: sorted((r.row_idx, r.col_idx, r.entity, round(r.score, 9)) for r in result["cea"].values() if r.table_id == t)
    assert score("t") == score("copy")


def test_unrelated_and_demoted_columns(spark):
    kinds = spark.createDataFrame([("t", 0, "entity"), ("t", 1, "entity"), ("t", 2, "text")], "table_id string, col_idx int, kind string")
    rel = spark.createDataFrame([("t", 0, 2, 1, 0.4), ("t", 1, 2, 1, 0.9)], "table_id string, head int, tail int, rank int, coverage double")
    assert [tuple(r) for r in annotate.unrelated_pairs(kinds, rel).collect()] == [("t", 0, 2)]
    body = spark.createDataFrame([("t", r, c, f"v{c}") for r in range(4) for c in range(3)], "table_id string, row_idx int, col_idx int, value string")
    answered = spark.createDataFrame([("v0",)], "mention string")
    assert {r.col_idx: r.kind for r in annotate.demote(body, kinds, answered).collect()} == {0: "entity", 1: "text", 2: "text"}


def test_quantities_match_in_base_units(spark):
    e = spark.createDataFrame([("Q1", "P2048", False, "1.85", "Quantity-metre", 0), ("Q1", "P2067", False, "80", "Quantity-kilogram", 1)], "subject string, pid string, backward boolean, object string, tag string, ord int")
    cand = spark.createDataFrame([("t", 1, 0, "Q1", 1, 1.0, 8)], "table_id string, row_idx int, col_idx int, entity string, rank int, sim double, len int")
    body = spark.createDataFrame([("t", 1, 1, "0.00185 km"), ("t", 1, 2, "80,000 g"), ("t", 1, 3, "3 m")], "table_id string, row_idx int, col_idx int, value string")
    kinds = spark.createDataFrame([("t", 0, "entity")] + [("t", k, "with_unit") for k in (1, 2, 3)], "table_id string, col_idx int, kind string")
    got = {r.ctx_col: r.pid for r in annotate.literal_matches(cand, body, kinds, e, views.units(spark)).collect()}
    assert got == {1: "P2048", 2: "P2067"}
