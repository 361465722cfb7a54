"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered, everything else becomes one space, and the n-grams of 1 to 3 characters of a row are hashed
into `buckets`. Training counts are summed by Spark over a bounded sample of labelled rows; the matrix of
log-probabilities (languages x buckets) goes to the tasks with the function, and a batch is scored by gathering
matrix rows for its n-grams and summing them by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, slices, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE = 8_000  # training rows of a language, chosen by a hash of the key
MAX_LANGUAGES = 1_000  # bounds the matrix; more is an error, not a cut
STEP = 300_000  # bytes of text at once

_tables: list[np.ndarray] = []


def _tables_of_characters() -> np.ndarray:
    """By code point: the lowered letter, or a space."""
    if not _tables:
        out = np.full(0x110000, 32, np.uint32)
        for i in (*range(0xD800), *range(0xE000, 0x110000)):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 rows; invalid bytes become U+FFFD."""
    whole = raw.tobytes()
    try:
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return points, leads[offsets]
    except UnicodeDecodeError:
        parts = [np.frombuffer(whole[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the (bucket, row) of its n-grams in order of rows; and whether each row has a letter."""
    points, bounds = characters(raw, offsets)
    rows = len(bounds) - 1
    low = _tables_of_characters()[points]
    row = np.repeat(np.arange(rows), np.diff(bounds))
    letter = np.bincount(row[low != 32], minlength=rows) > 0
    keep = low != 32
    keep[1:] |= (low[:-1] != 32) & (row[1:] == row[:-1])  # one space after letters
    low, row = low[keep], row[keep]
    out = []
    h = low.astype(np.uint32)
    for order in ORDERS:
        n = max(0, len(low) - order + 1)
        if order > 1:
            h = h[:n] * np.uint32(0x01000193) + low[order - 1 :] * np.uint32(0x9E3779B1)
        x = h[:n] * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        same = row[:n] == row[order - 1 :] if n else np.zeros(0, bool)
        out.append(((x[same] & np.uint32(BUCKETS - 1)).astype(np.int64), row[:n][same]))
    return out, letter


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        raw, offsets, _ = buffers(batch.column(1))
        for i, j in slices(offsets, STEP):
            grams, _ = ngrams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            here = langs[i:j]
            for lang in set(here):
                mine = here == lang
                for bucket, row in grams:
                    seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    seen[lang] += np.bincount(bucket[mine[row]], minlength=BUCKETS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language or -1, its posterior) of each row."""
        rows = len(offsets) - 1
        total = np.tile(self.prior, (rows, 1))
        grams, letter = ngrams(raw, offsets)
        for bucket, row in grams:
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[first]] += np.add.reduceat(self.matrix[bucket], first, axis=0)
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(letter, best, -1), np.where(letter, p, 0.0)


def train(docs: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> Model | None:
    """Fit on at most about `sample` rows of each language; the class prior counts all labelled rows."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("u"))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col("lang"))
    chosen = docs.where(F.pmod("u", F.lit(1_000_003)) < share * 1_000_003)
    counts = chosen.select("lang", "text").mapInArrow(tidy(_counts), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    if counts.num_rows:
        n[counts["bucket"].to_numpy(), [at[k] for k in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    n += 0.5
    total = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(n / n.sum(axis=0)), np.log(total / total.sum()))


def predict(docs: DataFrame, text: str, model: Model | None) -> DataFrame:
    """`docs` with lang_pred and score. Null texts and texts without a letter: `und`, 0.

    Empty tables give no rows; without training rows every text is `und`. Repeated rows are scored alike.
    `lang_pred` and `score` replace columns of those names.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*[c for c in keep if c != text]).schema
    fields = [c for c in keep if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.langs if model else []), "und"], object)
        for batch in batches:
            raw, offsets, _ = buffers(batch.column(len(fields)))
            best, p = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
            if model:
                for i, j in slices(offsets, STEP):
                    best[i:j], p[i:j] = model.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(p)], [*fields, "lang_pred", "score"])

    out = schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*fields, text).mapInArrow(tidy(run), out)


def remainder(key: Column) -> Column:
    """crc32 of the key's text modulo 4; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id")) == 2
    model = train(docs.where(~held), "doc_id", "text", "lang")
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), "text", model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
