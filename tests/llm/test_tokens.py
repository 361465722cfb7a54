import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsense.llm import packing, tokenfile, tokens

PATH = tokens.default_path()


def coded(texts):
    out = []
    for i, j, ids, off in tokens.encoded(pa.array(texts, pa.string()), PATH):
        out += [ids[off[k] : off[k + 1]].tolist() for k in range(j - i)]
    return out


def library(texts):
    return [x.tolist() for x in tokens.encoder(PATH).library([t or "" for t in texts])]


ODD = ["a   b  \n\n c d  ", "'s 'T don't ’s", "   ", "　 a", "\x1c a b", "É é ß ½ ² 3 44", "<|endoftext|> x", "", "a\r\n\r\n b\t\tc \t", "x × y÷", " a", "b ", "\n", "12ab!!?? \n\n z", None, "word " * 5000]


def test_ids_are_the_librarys():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "1", "é", "!", "'", ".", "ab", "Ñ", "\r", "--", "日"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert coded(texts) == library(texts)


def test_a_full_table_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 8)
    monkeypatch.setattr(tokens, "POOL", 50)
    monkeypatch.setattr(tokens, "_encoders", {})
    texts = [f"alpha beta{k} gamma delta{k % 7}" for k in range(300)]
    assert coded(texts) == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_coding_round_trip(rows):
    out = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.array([v for r in rows for v in r], np.uint32)
    control, _, data, _ = tokenfile.code(flat, out)
    assert tokenfile.decode(control, data, np.diff(out)).tolist() == flat.tolist()


def test_files(spark, monkeypatch):
    rows = [(5, "five five"), (1, None), (3, ""), (None, "no key"), (5, "five five"), (2, "two\n" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    blocks, order = tokenfile.write(docs, "doc_id", "body", block_ids=64)
    got = sorted((r.start, r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read(blocks, order).collect())
    assert [k for _, k, _ in got] == [None, 1, 2, 3, 5, 5]
    expected = {k: ids + [2] for (k, _), ids in zip(rows, library([t for _, t in rows]), strict=True)}
    start = 0
    for s, k, ids in got:
        assert (s, ids) == (start, expected[k])
        start += len(ids)


def test_no_files_of_an_empty_table(spark):
    blocks, order = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert tokenfile.read(blocks, order).collect() == []


def test_frequent_ids_are_short(spark):
    docs = spark.createDataFrame([(k, "the the the the rare%d" % k) for k in range(20)], "doc_id long, text string")
    _, order = tokenfile.write(docs, "doc_id", "text", PATH)
    assert library([" the"])[0][0] == order[0]


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(spark, size):
    rows = [(k, "word " * (k * 7 % 400)) for k in range(120)] + [(1000, None), (None, "x"), (7, "word " * 49), (2000, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, "doc_id", "text", size).collect()
    ids = [x + [2] for x in library([t for _, t in rows])]
    assert sum(r.length for r in got) == sum(map(len, ids))
    by_key = {k: x for (k, _), x in zip(rows, ids, strict=True)}
    sequences = {}
    for r in got:
        piece = np.array(by_key[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length <= size and zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert r.length == size or r.piece == 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    least = -(-sum(map(len, ids)) // size)
    assert len(sequences) <= least * 1.1 + 2
    assert packing.pack(docs.limit(0), "doc_id", "text").collect() == []


def test_plan_uses_the_histogram_up():
    rng = random.Random(3)
    hist = {x: rng.randint(0, 300) for x in range(1, 1024)}
    plan = packing.plan(hist, 1024)
    used = {}
    for pattern, n in plan:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == {x: n for x, n in hist.items() if n}
    total = sum(x * n for x, n in hist.items())
    assert sum(n for _, n in plan) <= -(-total // 1024) * 1.01 + 1
