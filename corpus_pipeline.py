"""A corpus from raw documents to packed token sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.llm import decontaminate, neardup, packing, quality, scratch, substrings

KEY, TEXT = "doc_id", "text"


def _free(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until `docs` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in `gone`; rows with a null key stay."""
    name = _free(docs, "_gone")
    return docs.join(gone.select(F.col(KEY).alias(name)).distinct(), F.col(KEY) == F.col(name), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (all rows of a key of which any text is rejected)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality.classify(docs, labels, KEY, TEXT, "source").where("not kept"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest key. Of rows that share a key, each different text
    stays once, with the least of its other columns."""
    found = scratch.table(neardup.near_duplicates(docs, KEY, TEXT), "groups")
    out = _without(docs, found.where("not kept"))
    twice = found.where(f"{KEY} is not null").groupBy(KEY).count().where("count > 1").select(KEY)
    if twice.limit(1).count():
        others = [c for c in docs.columns if c not in (KEY, TEXT)]
        again = out.join(twice, KEY, "left_semi").groupBy(KEY, TEXT).agg(F.min(F.struct(*others, F.lit(0))).alias(least := _free(docs, "_least")))
        again = again.select(*[F.col(c) if c in (KEY, TEXT) else F.col(least)[c].alias(c) for c in docs.columns])
        out = out.join(twice, KEY, "left_anti").select(*docs.columns).unionByName(again)
    return out


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start anywhere else go, whole characters at a time; every document stays."""
    row, of, kept = _free(docs, "_row"), _free(docs, "_of"), _free(docs, "_kept")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rest = substrings.repeated_strings(numbered, row, TEXT, 200, texts=True)
    rest = rest.select(F.col(row).alias(of), F.col("kept").alias(kept))
    joined = numbered.drop(TEXT, "n_chars").join(rest, F.col(row) == F.col(of))
    new = {TEXT: F.col(kept), "n_chars": F.length(kept).cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, KEY, TEXT, benchmark).where("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, KEY, TEXT)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, the latent search, or the tokenizer; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; what a stage wrote on its way goes when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch.tables()
        out = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.sweep(spark, before, out)
        scratch.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
