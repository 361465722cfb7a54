"""Token files: frequency-ranked ids in byte-aligned variable-length coding with control bytes of their own.

A token's rank by corpus frequency (ties: smaller id first) is written in 1 to 4 little-endian bytes. Four 2-bit
lengths (minus one) make a control byte; controls and data are kept apart, and a document's codes begin at a control
byte. Files are Parquet containers whose rows are blocks of about `block_ids` ids in ascending key order:

    bucket int, block int       place in the order; a bucket is a range of keys
    start long                  ids of the bucket before the block
    ids long                    ids in the block
    keys binary                 int64 key of each document (null_keys: bytes, 1 where null)
    counts binary               uint32 ids of each document
    control binary, data binary

Decoding looks a control byte up in a table of 256 x 4 lengths and gathers the bytes with numpy.

Texts are tokenized once: their plain ids are written, counted for the ranks, and read again to be coded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import buffers, slices, tidy
from .tokens import _spread, default_path, encoded, encoder

END = 2
LENGTHS = np.stack([((np.arange(256) >> (2 * k)) & 3) + 1 for k in range(4)], axis=1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def with_end(ids: np.ndarray, out: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Append `end` to each row's ids."""
    return np.insert(ids, out[1:], end).astype(np.uint32), out + np.arange(len(out))


def code(values: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, control offsets, data, data offsets) of rows of values."""
    values = values.astype("<u4")
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    n = np.diff(out)
    c_off = np.concatenate([[0], np.cumsum(-(-n // 4))])
    lanes = np.zeros(c_off[-1] * 4, np.uint8)
    lanes[_spread(c_off[:-1] * 4, n)] = extra
    lanes = lanes.reshape(-1, 4)
    control = lanes[:, 0] | lanes[:, 1] << 2 | lanes[:, 2] << 4 | lanes[:, 3] << 6
    top = int(extra.max(initial=0)) + 1
    data = values.view(np.uint8).reshape(-1, 4)[:, :top][np.arange(top) <= extra[:, None]]
    d_off = np.concatenate([[0], np.cumsum(extra.astype(np.int64) + 1)])[out]
    return control, c_off, data, d_off


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of rows of `counts` values."""
    counts = counts.astype(np.int64)
    blocks = -(-counts // 4)
    size = LENGTHS[control].reshape(-1)[_spread((np.cumsum(blocks) - blocks) * 4, counts)]
    off = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    value = data[off].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        value |= data[off + k].astype(np.uint32) << np.uint32(8 * k)
    return value & MASKS[size]


def _tokenize(path: str):
    """Plain ids of texts, in 16 bits where the vocabulary fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _width(path)
        size = np.dtype(kind).itemsize
        for batch in batches:
            for i, j, ids, out in encoded(batch.column(2), path):
                ids, out = with_end(ids, out)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(out.astype(np.int64) * size), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), cells.cast(pa.binary())], ["bucket", "key", "ids"])

    return run


def _width(path: str) -> str:
    lib = encoder(path).lib
    top = max(END, *lib.get_vocab().values()) if lib.get_vocab_size() else END
    return "<u2" if top < 1 << 16 else "<u4"


def _rows(column: pa.Array, kind: str, step: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of slices of a column of plain ids."""
    raw, offsets, _ = buffers(column)
    size = np.dtype(kind).itemsize
    for i, j in slices(offsets, step * size):
        yield i, j, raw[offsets[i] : offsets[j]].view(kind), (offsets[i : j + 1] - offsets[i]) // size


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(END + 1, np.int64)
        for batch in batches:
            for _, _, ids, _ in _rows(batch.column(0), kind):
                more = np.bincount(ids, minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])

    return run


def frequency_order(plain: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling corpus frequency, over all documents. Its size is the vocabulary's, whatever the corpus."""
    rows = plain.select("ids").mapInArrow(tidy(_counts(kind)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([r["id"] for r in rows], np.uint32)


def _encode(kind: str, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for batch in batches:
            for i, j, ids, out in _rows(batch.column(2), kind):
                control, c_off, data, d_off = code(rank[ids], out)
                control, data = control.tobytes(), data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(out), pa.int64()),
                        pa.array([control[a:b] for a, b in zip(c_off, c_off[1:], strict=False)], pa.binary()),
                        pa.array([data[a:b] for a, b in zip(d_off, d_off[1:], strict=False)], pa.binary()),
                    ], ["bucket", "key", "n", "control", "data"],
                )

    return run


BLOCK = "bucket int, block int, start long, ids long, keys binary, null_keys binary, counts binary, control binary, data binary"


def _blocks(block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, start, rows, held = None, 0, 0, [], 0

        def flush():
            nonlocal block, start, rows, held
            keys = np.array([k or 0 for k, *_ in rows], "<i8").tobytes()
            none = bytes(k is None for k, *_ in rows)
            counts = np.array([r[1] for r in rows], "<u4").tobytes()
            values = [at, block, start, held, keys, none, counts, b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])
            block, start, rows, held = block + 1, start + held, [], 0
            return out

        for batch in batches:
            for bucket, key, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if rows:
                        yield flush()
                    at, block, start = bucket, 0, 0
                rows.append((key, n, control, data))
                held += n
                if held >= block_ids:
                    yield flush()
        if rows:
            yield flush()

    return run


def write(docs: DataFrame, key: str, text: str, path: str | None = None, block_ids: int = 1 << 18) -> tuple[DataFrame, np.ndarray]:
    """Write token files in ascending key order; (the block table as read from the files, ids by rank).

    Null texts are empty (the end id alone); null keys come first; repeated rows are documents of their own;
    documents with one key stand in any order. An empty table gives an empty block table.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark, 3000)
    path = path or default_path()
    buckets = 4 * scratch.partitions(spark)
    cuts = docs.select(F.percentile_approx(F.col(key), [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
    # bounds are part of the plan, so that sorting the key ranges needs no sampling run over the texts
    bounds = sorted(set(cuts))
    bucket = F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col(key)))) if bounds else F.lit(0)
    named = docs.select(bucket.cast("int").alias("bucket"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    plain = scratch.table(named.mapInArrow(tidy(_tokenize(path)), "bucket int, key long, ids binary"), "ids")
    kind = _width(path)
    order = frequency_order(plain, kind)
    coded = plain.mapInArrow(tidy(_encode(kind, order)), "bucket int, key long, n long, control binary, data binary")
    blocks = coded.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(tidy(_blocks(block_ids)), BLOCK)
    written = scratch.table(blocks, "tokens")
    scratch.drop(plain)
    return written, order


def read(blocks: DataFrame, order: np.ndarray) -> DataFrame:
    """(key, start, n_tokens, ids binary little-endian uint32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, start, counts, ids in _decoded(batches, order):
            ends = np.concatenate([[0], np.cumsum(counts)])
            raw = ids.tobytes()
            cells = [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([key, pa.array(start + ends[:-1]), pa.array(counts, pa.int64()), pa.array(cells, pa.binary())], ["key", "start", "n_tokens", "ids"])

    return _placed(blocks).mapInArrow(tidy(run), "key long, start long, n_tokens long, ids binary")


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with the ids of all blocks before them. There are a few buckets a partition, so their sums are small."""
    sums = blocks.groupBy("bucket").agg(F.sum("ids").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    return blocks.join(before, "bucket").select((F.col("before") + F.col("start")).alias("start"), "keys", "null_keys", "counts", "control", "data")


def _decoded(batches, order):
    for batch in batches:
        for start, keys, none, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.frombuffer(counts, "<u4").astype(np.int64)
            ids = order[decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts)]
            yield pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(none, np.uint8) > 0), start, counts, ids


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blocks, order = write(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, start, counts, ids in _decoded(batches, order):
            ends = np.concatenate([[0], np.cumsum(counts)])
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([key, pa.array(start + ends[:-1]), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(blocks).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
