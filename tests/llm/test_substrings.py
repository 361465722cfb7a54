import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridsense.llm import substrings


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(60))[: rng.choice([length - 1, length, length + 1, 2 * length, 300])] for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.choice([0, 1, 2])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((k, "".join(parts)))
    return rows + [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 200), (104, rows[0][1]), (104, rows[0][1]), (None, passages[3]), (105, "y" * (length - 1))]


@pytest.mark.parametrize("length", [32, 50, 101, 200])
def test_brute_force(spark, length, tmp_path):
    rows = corpus(length, length)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, blob int").repartition(3).write.parquet(path)
    got = sorted((tuple(r) for r in substrings.repeated_strings(spark.read.parquet(path), "doc_id", "text", length).collect()), key=str)
    assert got == brute(rows, length)


@pytest.mark.parametrize("length", [50, 200])
def test_hot_anchors_by_brute_force(spark, length, tmp_path, monkeypatch):
    """Every anchor of more than two contexts is hot; passages of all texts are just shorter than a window, or longer."""
    monkeypatch.setattr(substrings, "HOT_LEAST", 2)
    monkeypatch.setattr(substrings, "HOT_SHARE", 10**9)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    near, whole = text(200)[: length * 4 // 5], text(200)[: length * 3 // 2]
    ends = [text(20) for _ in range(3)]
    rows = [(k, text(20) + near + rng.choice([text(20), *ends]) + (whole if k % 3 == 0 else "") + text(20)) for k in range(150)]
    rows += [(k, whole + whole + near + near) for k in (200, 201)] + [(202, whole[:length] + text(30))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    assert len(substrings.hot_anchors(docs.select("text"), length, 4)) > 0
    got = sorted((tuple(r) for r in substrings.repeated_strings(docs, "doc_id", "text", length).collect()), key=str)
    assert got == brute(rows, length)


def test_chunks_and_batches_change_nothing(spark, tmp_path, monkeypatch):
    rows = corpus(9, 50)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    one = substrings.anchors

    for chunk, batch in ((500, 40), (100_000, 10**6)):
        monkeypatch.setattr(substrings, "SUFFIX_BATCH", batch)
        texts = [(t or "").encode() for _, t in rows]
        pieces, at = [], 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size + len(texts[at]) <= chunk):
                part.append(texts[at])
                size += len(texts[at])
                at += 1
            pieces.append(part)
        found = set()
        for part in pieces:
            off = np.concatenate([[0], np.cumsum([len(b) for b in part])]).astype(np.int64)
            raw = np.frombuffer(b"".join(part), np.uint8)
            for x in one(raw, off, 50):
                found.add(bytes(raw[x["lo"] : x["lo"] + x["n"] - 1 + 50]))
        if chunk == 500:
            first = found
    assert first == found


def test_family_finds_repeats_over_all_levels():
    rng = np.random.default_rng(4)
    head, mark = rng.integers(0, 40, 900).astype(np.uint64), rng.integers(0, 30, 900).astype(np.uint64)
    family, hit = substrings.Family(), np.zeros(900, bool)
    for lo in range(0, 900, 37):
        part = slice(lo, lo + 37)
        for refs in family.add(substrings.Level(head[part], mark[part], mark[part] % np.uint64(3), np.arange(900)[part])):
            hit[refs] = True
    seen = Counter(zip(head.tolist(), mark.tolist(), strict=True))
    assert hit.tolist() == [seen[h, m] > 1 for h, m in zip(head.tolist(), mark.tolist(), strict=True)]
    assert len(family.levels) < 8  # levels grow geometrically


def test_rest_is_text(spark, tmp_path):
    shared = "ééé ñandú çà " * 30
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a" + shared + "é one"), (2, "bé" + shared + "two"), (3, "alone é")], "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.kept for r in substrings.repeated_strings(spark.read.parquet(path), "doc_id", "text", 200, texts=True).collect()}
    assert got[3] == "alone é" and "�" not in "".join(got.values()) and got[1].startswith("a") and got[1].endswith(" one")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert substrings.repeated_strings(spark.read.parquet(path), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        substrings.repeated_strings(spark.read.parquet(path), "doc_id", "text", 8)


def test_sql_twin(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in substrings.op5_suffix_family(spark, sf).collect()) == sorted(con.sql(substrings.SQL).fetchall())
