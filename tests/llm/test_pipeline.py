import corpus_pipeline
from gridsense.llm import queries

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0 and sizes[4] <= sizes[3]
    before, after = kept["minhash near-dedup"], kept["suffix-array dedup"]
    assert sum(len(t) for t in after.values()) < sum(len(t) for t in before.values())
    assert {r.doc_id for r in docs.collect()} == set(kept["benchmark decontamination"])


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_different_texts_under_one_key_stay(spark, tmp_path):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in "abc")
    rows = [(1, a, "s2"), (1, b, "s"), (1, a, "s1"), (2, a + "more", "s"), (3, c, "s"), (3, c, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(tuple(r) for r in corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect())
    assert got == [(1, a, "s1"), (1, b, "s"), (3, c, "s")]


def test_clashing_columns(spark, tmp_path):
    rows = [(k, f"text {k} " * 30, "en", "s", k, k, k) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row long, _of long, _gone long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted((r.doc_id, r._row, r._of, r._gone) for r in out.collect()) == [(k, k, k, k) for k in range(6)]


def test_odd_rows(spark, tmp_path):
    rows = [(None, "null key " * 30, "en", None, 5), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "same words here " * 20, "en", "s", 1), (3, "same words here " * 20, "en", "s", 1), (4, "same words here " * 20, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    deduped = corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in deduped) == [0, 1, 2, 3]
    assert corpus_pipeline.suffix_array_dedup(spark, docs, SF).count() == 6
    assert corpus_pipeline.benchmark_decontamination(spark, docs, SF).count() == 6
    empty = docs.limit(0)
    empty.write.parquet(str(tmp_path / "e"))
    empty = spark.read.parquet(str(tmp_path / "e"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
