import pytest
from pyspark.sql import functions as F

from gridsense.operators import graph, lookup


def index(spark, rows):
    return lookup.label_documents(spark.createDataFrame(rows, "ID string, page_rank double, labels array<string>, main_aliases array<string>, sub_aliases array<string>"))


DUMP = [("Q1", 50.0, ["Manchester United F.C."], ["MUFC", "Manchester United"], ["Man Utd", "MUFC"]), ("Q2", 9.0, ["Manchester City F.C."], ["MCFC"], None), ("Q3", 2.0, ["Belgium"], None, ["Kingdom of Belgium"]), ("Q4", 1.0, ["Belgian Blue"], [], [])]


def test_each_label_is_in_its_best_tier_only(spark):
    got = {(r.entity, r.label): r.origin for r in index(spark, DUMP).collect()}
    assert got["Q1", "MUFC"] == "MAIN_ALIAS" and got["Q1", "Man Utd"] == "SUB_ALIAS" and got["Q3", "Belgium"] == "LABEL" and len(got) == 9


def ranked(spark, *names, top_k=None):
    mentions = spark.createDataFrame([(n,) for n in names], "mention string")
    return {(r.mention, r["rank"]): r for r in lookup.lookup(mentions, index(spark, DUMP), top_k).collect()}


def test_lookup(spark):
    got = ranked(spark, "MUFC", "belgum", "Manchester Unitd", "zzz", " ", '"Belgium"')
    assert got["mufc", 1].entity == "Q1" and got["belgum", 1].entity == "Q3" and got["manchester unitd", 1].entity == "Q1" and got["belgium", 1].entity == "Q3"
    assert not any(m == "zzz" for m, _ in got) and all(0 < r.score <= 1 for r in got.values())
    assert max(k for _, k in ranked(spark, "manchester", top_k=1)) == 1


def test_response_has_a_row_for_each_mention(spark):
    mentions = spark.createDataFrame([("MUFC",), ("",), ("zzz",)], "mention string")
    got = {r.label: (r.entities, r.error) for r in lookup.response(lookup.lookup(mentions, index(spark, DUMP)), mentions).collect()}
    assert got["MUFC"][0][0].entity == "Q1" and got[""][1] and got["zzz"] == (None, None)


def test_deletion_keys_find_what_edit_distance_finds(spark):
    words = ["house", "mouse", "hose", "houses", "horse", "ab", "abc", "universe", "univrse", "unverse", "nuiverse", "x"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r.m_token, r.token) for r in lookup.token_matches(df.withColumnRenamed("token", "m_token"), df).collect()}
    pairs = df.select(F.col("token").alias("a")).crossJoin(df.select(F.col("token").alias("b"))).where(F.levenshtein("a", "b") <= lookup.edits(F.col("a"))).collect()
    assert got == {(r.a, r.b) for r in pairs}


def test_segments_find_what_edit_distance_finds(spark):
    words = ["new york", "newyork", "new yorks", "mew york", "nw yrk", "a", "ab", "abc", "abd", "manchester united", "manchestr unitd", "united manchester"]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = {(r.mention, r.text) for r in lookup.whole_matches(df.withColumnRenamed("text", "mention"), df).collect()}
    pairs = df.select(F.col("text").alias("a")).crossJoin(df.select(F.col("text").alias("b"))).where(F.levenshtein("a", "b") <= lookup.edits(F.col("a"))).collect()
    assert got == {(r.a, r.b) for r in pairs}


def test_a_label_without_its_blank_is_found(spark):
    found = index(spark, [("Q5", 1.0, ["New York"], None, None)])
    assert lookup.lookup(spark.createDataFrame([("Newyork",)], "mention string"), found).first().entity == "Q5"


def test_frequent_tokens_are_keys_beside_rarer_ones(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT", 3)
    found = index(spark, [(f"S{k}", 0.0, [f"Supplier {k * 1111:04}"], None, None) for k in range(1, 9)])
    hits = lookup.hits(spark.createDataFrame([("supplier 3333",), ("supplier 9876",)], "mention string"), found).join(found, "label_id").collect()
    got = {(r.mention, r.entity): r.bm25 for r in hits}
    assert set(got) == {(m, f"S{k}") for m in ("supplier 3333", "supplier 9876") for k in range(1, 9)}
    # each hit has the share of the common token; only the equal label has more
    assert len({round(v, 9) for (m, e), v in got.items() if (m, e) != ("supplier 3333", "S3")}) == 1 and got["supplier 3333", "S3"] > got["supplier 3333", "S4"]


def test_no_hit_is_cut_unless_asked(spark):
    rows = [(f"S{k}", 0.0, [f"supplier {k}"], None, None) for k in range(10_020)]
    mention = spark.createDataFrame([("supplier 77",)], "mention string")
    found = index(spark, rows)
    assert lookup.hits(mention, found).count() == 10_020
    assert lookup.hits(mention, found, lookup.LookupConfig(max_hits=10_000)).count() == 10_000


def test_long_labels_find_what_edit_distance_finds(spark):
    base = "the very long name of a company"
    words = [base[:k] for k in (20, 21, 22, 23, 24, 25, 26, 27, 28)] + [base, base[1:], base[2:], base.replace("very", "vary"), base[:9] + base[10:24], base + "ies", "x" + base[:24], "xy" + base[:24]]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    found = lookup.whole_matches(df.withColumnRenamed("text", "mention"), df).collect()
    pairs = df.select(F.col("text").alias("a")).crossJoin(df.select(F.col("text").alias("b"))).where(F.levenshtein("a", "b") <= lookup.edits(F.col("a"))).collect()
    assert {(r.mention, r.text) for r in found} == {(r.a, r.b) for r in pairs} and len(found) == len(pairs)


def _plain(mentions, index, c):
    """Ranks from pairs that are all joined, rated and kept as rows."""
    form = lookup.forms(index)
    found = lookup.form_hits(mentions, form, c).join(index.select(lookup.form_id(), "entity", "pr"), "form_id")
    return lookup.score(found, c)


NAMES = [(f"S{k}", float(k % 3), [f"Supplier {k * 37 % 100:03} {'north' if k % 4 else 'south'}"], [f"sup {k % 5}"], ["supplier"] if k % 7 else []) for k in range(60)] + [("N1", 4.0, ["North"], None, ["north"]), ("N2", 0.0, ["Newyork"], [], None)]
ASKED = [("supplier 037 north",), ("suplier 074 south",), ("north",), ("new york",), ("sup 3",), ("zzz",)]


@pytest.mark.parametrize(("part", "top_k"), [(1 << 17, 3), (40, None)])
def test_cells_rank_as_rows_do(spark, monkeypatch, part, top_k):
    monkeypatch.setattr(lookup, "PART", part)
    monkeypatch.setattr(lookup.meet, "HITS", 50)
    found, mentions = index(spark, NAMES), spark.createDataFrame(ASKED, "mention string")
    rows = lambda df: sorted((r.mention, r.entity, r.label, r.origin, round(r.ratio, 9), r.partial, round(r.score, 8), r["rank"]) for r in df.collect())
    plain = _plain(mentions, found, lookup.LookupConfig())
    got = rows(lookup.lookup(mentions, found, top_k))
    assert got == rows(plain.where(F.col("rank") <= top_k) if top_k else plain) and len({r[0] for r in got}) == 5


@pytest.mark.parametrize("part", [40, 1 << 17])
def test_hits_are_not_shuffled(spark, monkeypatch, part):
    """Hits are as many as mentions times labels of a word; what is dealt out are mentions, postings and labels."""
    monkeypatch.setattr(lookup, "PART", part)
    found, mentions = index(spark, NAMES + [(f"copy{k}", *NAMES[0][1:]) for k in range(5)]), spark.createDataFrame(ASKED, "mention string")
    got = lookup.hits(mentions, found)
    plain = lookup.form_hits(mentions, lookup.forms(found), lookup.LookupConfig()).join(found.select(lookup.form_id(), "label_id", "entity", "pr"), "form_id")
    rows = lambda df: sorted((r.mention, r.label_id, r.entity, r.label, r.origin, r.pr, round(r.bm25, 9)) for r in df.collect())
    assert rows(got) == rows(plain)
    above = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above and "Sort" not in above


def test_capped_hits_are_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(lookup, "PART", 40)
    found, mentions = index(spark, NAMES), spark.createDataFrame(ASKED, "mention string")
    every = lookup.hits(mentions, found).collect()
    want = [x for (m,) in ASKED for x in sorted((m, -round(r.bm25, 9), r.entity, r.label, r.origin) for r in every if r.mention == m)[:4]]
    got = lookup.hits(mentions, found, lookup.LookupConfig(max_hits=4)).collect()
    assert sorted((r.mention, -round(r.bm25, 9), r.entity, r.label, r.origin) for r in got) == sorted(want)


def test_pairs_do_not_leave_their_cell(spark):
    """Only what may be ranked is given on, however many labels share a word."""
    found = index(spark, [(f"S{k}", 0.0, [f"supplier {k:04}"], None, None) for k in range(2000)])
    mentions = spark.createDataFrame([(f"supplier {k * 50:04}",) for k in range(20)], "mention string")
    shared, _ = lookup.classes(found)
    cells, parts = lookup._cells(mentions, lookup.forms(found), lookup.LookupConfig(), shared)
    left = cells.mapInArrow(lookup.meet.rated(lookup.LookupConfig(), 0.75, 3, parts == 1), "mention string, key long, label string, origin string, ratio double, partial boolean, bm25 double, pr double, score double")
    assert left.count() < 20 * 60


@pytest.mark.parametrize("part", [40, 1 << 17])
def test_counts_of_candidates_need_no_list_of_them(spark, monkeypatch, part):
    monkeypatch.setattr(lookup, "PART", part)
    found = index(spark, NAMES + [(f"copy{k}", *NAMES[0][1:]) for k in range(5)])
    mentions = spark.createDataFrame(ASKED, "mention string")
    listed = lookup.lookup(mentions, found)
    counts = lookup.candidate_counts(mentions, found)
    assert {r.mention: r.n for r in counts.collect()} == {r.mention: r["count"] for r in listed.groupBy("mention").count().collect()}
    assert lookup.average_candidates(counts).collect() == lookup.average_candidates(listed).collect()


EDGES = [("A", "P1", False, "B", "NORMAL", 0), ("C", "P2", False, "H", "NORMAL", 0), ("D", "P3", False, "H", "PREFERRED", 0), ("E", "P361", False, "H", "NORMAL", 0), ("H", "P361", False, "F", "NORMAL", 0), ("A", "P585", False, "1994", "DateTime-Year", 0), ("T1", "P279", False, "T2", "NORMAL", 0), ("T2", "P279", False, "T3", "NORMAL", 0), ("A", "P31", False, "T1", "NORMAL", 0), ("B", "P31", False, "T1", "NORMAL", 0), ("B", "P106", False, "T2", "NORMAL", 0)]


def edges(spark):
    return graph.mirrored(spark.createDataFrame(EDGES, "subject string, pid string, backward boolean, object string, tag string, ord int"))


def test_paths(spark):
    e = edges(spark)
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("E", "F"), ("C", "F"), ("A", "H")], "head string, tail string")
    got = {(r.head, r.tail, r.path): r for r in graph.paths(pairs, e, graph.degrees(e)).collect()}
    assert got["A", "B", "P1"].prox == 1.0 and got["B", "A", "(-)P1"].best == 1.0
    pop = 1 / (2 + __import__("math").log10(2 + 4))
    assert abs(got["C", "D", "P2::(-)P3"].prox - pop / 1.75) < 1e-12
    assert got["E", "F", "P361"].prox == 1.0 and abs(got["C", "F", "P2::P361"].prox - pop) < 1e-12
    assert not any(h == "A" and t == "H" for h, t, _ in got)


def test_degrees_of_known_nodes_do_not_read_the_graph(spark):
    e = edges(spark)
    nodes = lambda *names: spark.createDataFrame([(n,) for n in names], "entity string")
    every = {r.entity: r.num_edges for r in graph.degrees(e).collect()}
    own = graph.subgraph(e, nodes("A", "H"))
    got = graph.degrees_of(nodes("A", "H"), None, own, nodes("A", "H"))  # no graph is given
    assert {r.entity: r.num_edges for r in got.collect()} == {n: every[n] for n in "AH"}
    got = graph.degrees_of(nodes("A", "C", "H", "none"), e, own, nodes("A", "H"))
    assert {r.entity: r.num_edges for r in got.collect()} == {n: every[n] for n in "ACH"}
    pairs = spark.createDataFrame([("C", "D"), ("E", "F"), ("C", "F"), ("A", "B")], "head string, tail string")
    rows = lambda d: sorted(map(tuple, graph.paths(pairs, e, d).collect()))
    assert rows(graph.degrees(e)) == rows(lambda n: graph.degrees_of(n, e, own, nodes("A", "H")))


def test_types(spark):
    got = {(r.entity, r.type): r.level for r in graph.types_by_level(spark.createDataFrame([("A",), ("B",)], "entity string"), edges(spark)).collect()}
    assert got == {("A", "T1"): 1, ("A", "T2"): 2, ("A", "T3"): 3, ("B", "T2"): 1, ("B", "T3"): 2}


def test_labels_and_rewriting(spark):
    nodes = spark.createDataFrame([("A", ["a", "b"]), ("B", [])], "entity string, labels array<string>")
    got = {r.entity: r.label for r in graph.label_of(spark.createDataFrame([("A",), ("B",), ("Z",)], "entity string"), nodes).collect()}
    assert got == {"A": "a", "B": "No English Label", "Z": ""}
    names = F.create_map(F.lit("P1"), F.lit("one"), F.lit("P17"), F.lit("country"))
    assert spark.range(1).select(graph.rewrite(F.lit("P17::(-)P1"), names)).first()[0] == "country::(-)one"
