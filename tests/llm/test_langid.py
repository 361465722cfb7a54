import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridsense.llm import langid
from gridsense.llm.arrowtext import buffers

ROWS = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, "and this is the house", "en"), (5, "das ist das haus und", "de")]


def test_ngrams_are_those_of_plain_python():
    texts = ["Ab  cé", "", "123 !!", "x"]
    raw, off, _ = buffers(pa.array(texts))
    grams, letter = langid.ngrams(raw, off)
    assert letter.tolist() == [True, False, False, True]
    for order, (_, row) in zip(langid.ORDERS, grams, strict=True):
        plain = ["".join(c if c.isalpha() else " " for c in t.lower()) for t in texts]
        for r, t in enumerate(plain):
            squeezed = "".join(c for i, c in enumerate(t) if c != " " or (i and t[i - 1] != " "))
            assert (row == r).sum() == max(0, len(squeezed) - order + 1)


def test_scores_are_naive_bayes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = langid.train(docs, "doc_id", "text", "lang")

    def grams(t):
        raw, off, _ = buffers(pa.array([t]))
        return [b for g, _ in langid.ngrams(raw, off)[0] for b in g.tolist()]

    seen = {k: Counter(b for _, t, lang in ROWS if lang == k for b in grams(t)) for k in ("de", "en", "fr")}
    prior = Counter(lang for *_, lang in ROWS)
    for text in ("the house", "katze hund", "le", "zzz"):
        logs = {k: math.log(prior[k] / 5) + sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b in grams(text)) for k, c in seen.items()}
        best = max(logs, key=logs.get)
        p = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        raw, off, _ = buffers(pa.array([text]))
        got, score = model.score(raw, off)
        assert model.langs[got[0]] == best and abs(score[0] - p) < 1e-9


def test_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !", None), (None, "the dog", "en"), (4, "the " * 50_000, "en")], "doc_id long, text string, lang_pred string")
    model = langid.train(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, "text", model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == got[4][0] == "en"
    assert {r.lang_pred for r in langid.predict(docs, "text", None).collect()} == {"und"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty, "doc_id", "text", "lang") is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    accuracy = {r.held_out: r.a for r in out.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).collect()}
    assert accuracy[True] > 0.98 and accuracy[False] > 0.98


def test_broken_bytes():
    raw = np.frombuffer(b"ab\xff\xfecd", np.uint8)
    points, bounds = langid.characters(raw, np.array([0, 3, 6]))
    assert bounds[-1] == len(points) == 6
