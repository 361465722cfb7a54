import random
import re

import numpy as np
import pytest

from gridsense.llm import neardup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(lower)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, len(sets[i]), low[root(i)], low[root(i)] == k) for i, (k, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 6, 30, 120]))] for _ in range(25)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k + 10, rng.choice([" ", "\n", " \t "]).join(words).upper() if k % 9 == 0 else " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "é " * 400), (7, "x " * 30_000)]


@pytest.mark.parametrize("width,num,den", [(3, 85, 100), (5, 80, 100)])
def test_brute_force(spark, width, num, den):
    rows = corpus(width)
    docs = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, "doc_id", "text", width, (num, den)).collect())
    assert got == brute(rows, width, num, den)


def test_large_groups_are_cut_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 3_000)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):  # a chain: each text changes a little more of the one before
        if k % 3 == 0:
            words[rng.randrange(60)] = f"new{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, "doc_id", "text", 3, (85, 100)).collect())
    assert got == brute(rows, 3, 85, 100)


def test_pairs_within_a_crowd(spark):
    """Texts that share half of their words fill common regions; of pairs of 0.85 and more among them none is lost."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(70)]
    rows, k = [], 0
    while k < 1200:
        words = common + [f"w{rng.randrange(10**6)}" for _ in range(12)]
        rows.append((k, " ".join(words)))
        if k % 5 == 0:
            words[70 + rng.randrange(12)] = f"x{k}"
            rows.append((k + 1, " ".join(words)))
            k += 1
        k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, "doc_id", "text", 3, (85, 100)).collect())
    want = brute(rows, 3, 85, 100)
    assert sum(not r[3] for r in want) >= 190 and got == want


def test_keys(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in neardup.near_duplicates(docs, "doc_id", "text", 3).collect())
    assert got == [(0, None, True), (0, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert neardup.near_duplicates(docs.limit(0), "doc_id", "text").collect() == []


def test_one_key_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (5, a.replace("a59", "x")), (7, b.replace("b59", "y")), (9, "other words entirely here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, "doc_id", "text", 3, (85, 100)).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (7, 1), (9, 9)]


def test_candidates_of_short_and_crowded_regions():
    region = np.array([1, 1, 2] + [3] * 200)
    path = np.zeros((203, neardup.LONG), np.uint8)
    i, j = neardup.candidates(region, path)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert (0, 1) in pairs and all(region[a] == region[b] and a < b for a, b in pairs)
    assert all((k, k + 1) in pairs for k in range(3, 202))
    assert len(neardup.candidates(np.array([7]), path[:1])[0]) == 0


def test_sql_twin(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in neardup.op3_lsh_forest(spark, sf).collect()) == sorted(con.sql(neardup.SQL).fetchall())
