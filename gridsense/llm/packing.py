"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths (as many rows as the sequence length) reaches the driver. There, patterns of few
lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down to what the histogram holds, and the residual histogram is packed by best fit, many equal
lengths at a time. The plan maps ranges of ranks within a length to sequences and offsets.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import tidy
from .tokenfile import with_end
from .tokens import default_path, encoded


def patterns(hist: dict[int, int], size: int, common: int = 96) -> list[tuple[int, ...]]:
    """Patterns of up to four documents that fill `size` or leave little: exact pairs; triples with one or two of
    the most frequent lengths; multiples of a length with the best filler; every length with its closest partner."""
    have = sorted((x for x, n in hist.items() if n), reverse=True)
    present = np.zeros(size + 1, bool)
    present[have] = True
    below = np.maximum.accumulate(np.where(present, np.arange(size + 1), 0))  # the longest present length up to x
    top = [x for x, _ in Counter(hist).most_common(common)]
    found: set[tuple[int, ...]] = set()
    for a in have:
        b = int(below[size - a])
        if b:
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in top:
            if a + b < size and (c := int(below[size - a - b])):
                if size - a - b - c <= 2:
                    found.add(tuple(sorted((a, b, c), reverse=True)))
        for k in (2, 3):
            if k * a < size and (c := int(below[size - k * a])):
                found.add(tuple(sorted((a,) * k + (c,), reverse=True)))
    return sorted(found)


def nnls(pats: list[tuple[int, ...]], hist: dict[int, int], size: int, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, by accelerated projected gradients on the sparse A."""
    if not pats:
        return np.zeros(0)
    rows = np.concatenate([np.array(p) for p in pats])
    cols = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    h = np.zeros(size + 1)
    for x, n in hist.items():
        h[x] = n
    up = lambda x: np.bincount(rows, x[cols], size + 1)
    down = lambda r: np.bincount(cols, r[rows], len(pats))
    v = np.ones(len(pats))
    for _ in range(30):
        v = down(up(v))
        v /= np.linalg.norm(v)
    step = 1 / max(1e-9, float(np.linalg.norm(down(up(v)))) * 1.05)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * down(up(y) - h))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x


def best_fit(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram, equal bins and equal lengths at a time: (pattern, repeats)."""
    bins: dict[int, list[list]] = {}  # by room left: [pattern, repeats]
    for x in sorted((k for k, n in hist.items() if n), reverse=True):
        left = hist[x]
        while left:
            room = min((r for r in bins if r >= x), default=None)
            if room is None:
                room, group = size, [(), left]
            else:
                group = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            fit = room // x  # the tightest bin takes as many as fit before the next one does
            full = min(group[1], left // fit)
            one = 1 if full < group[1] and left > full * fit else 0
            rest = left - full * fit if one else 0
            if full:
                bins.setdefault(room - fit * x, []).append([group[0] + (x,) * fit, full])
            if one:
                bins.setdefault(room - rest * x, []).append([group[0] + (x,) * rest, 1])
            if group[0] and group[1] - full - one:
                bins.setdefault(room, []).append([group[0], group[1] - full - one])
            left -= full * fit + rest
    merged: Counter = Counter()
    for groups in bins.values():
        for p, n in groups:
            merged[p] += n
    return sorted(merged.items(), reverse=True)


def plan(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly.

    The fit may leave long lengths without their short partners, so several shares of the fitted counts are tried
    and the plan with the fewest sequences is taken."""
    have = {x: n for x, n in hist.items() if n}
    pats = patterns(have, size)
    fit = nnls(pats, have, size)
    order = np.argsort(-fit, kind="stable")
    plans = []
    for share in (1.0, 0.9, 0.75, 0.5, 0.25, 0.1, 0.03):
        left, out = dict(have), []
        for j in order:
            if fit[j] * share < 1:
                break
            need = Counter(pats[j])
            n = min(int(fit[j] * share), *(left[x] // k for x, k in need.items()))
            if n > 0:
                out.append((pats[j], n))
                for x, k in need.items():
                    left[x] -= n * k
        plans.append(out + best_fit({x: n for x, n in left.items() if n}, size))
    return min(plans, key=lambda p: sum(n for _, n in p))


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for i, j, ids, out in encoded(batch.column(1), path):
                ids, out = with_end(ids, out)
                n = np.diff(out)
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * size  # the first piece takes what full pieces leave
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
                length = np.where(piece == 0, first[doc], size)
                view = memoryview(ids.astype("<u4").tobytes())
                lo = (out[:-1][doc] + start).tolist()
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(lo, length.tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                run_of = length[by]
                begin = np.searchsorted(run_of, run_of)
                local = np.empty(len(doc), np.int64)
                local[by] = np.arange(len(doc)) - begin + seen[run_of]
                seen += np.bincount(length, minlength=size + 1)
                keys = batch.column(0).slice(i, j - i).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(x, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))), pa.array(np.full(len(doc), part, np.int32)), pa.array(local)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
                )

    return run


def pack(docs: DataFrame, key: str, text: str, size: int = 1024, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty (the end id alone). Documents of more than `size` ids are cut; full pieces are sequences of
    their own (odd ids), others are packed (even ids). Repeated rows are documents of their own, null keys stay
    null, an empty table gives no rows. Pieces of one length are exchangeable, so their order says nothing else.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_pieces(path or default_path(), size)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")
    made = scratch.table(made, "pieces")
    short = made.where(F.col("length") < size)
    counts = short.groupBy("length", "part").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    given: dict[int, list[dict]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, n in plan(hist, size):
        offset = 0
        for x in pattern:
            given.setdefault(x, []).append({"lo": taken[x], "hi": taken[x] + n, "q": sequence - taken[x], "o": offset})
            taken[x] += n
            offset += x
        sequence += n
    rows = json.dumps([{"length": x, "plan": p} for x, p in sorted(given.items())])
    kind = "array<struct<length: bigint, plan: array<struct<lo: bigint, hi: bigint, q: bigint, o: bigint>>>>"
    slots = spark.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("x")).select("x.*")
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = short.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    # at most size - 1 lengths, with a range for each use in the plan
    mine = F.filter("plan", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.join(F.broadcast(slots), "length").withColumn("at", mine)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = placed.select(*columns, (2 * (F.col("at.q") + F.col("rank"))).alias("sequence_id"), F.col("at.o").alias("offset"))
    # (part, local) numbers the full pieces, whose parts hold fewer than 2**40 of them
    whole = made.where(F.col("length") == size).select(*columns, (2 * (F.col("part").cast("long") * (1 << 40) + F.col("local")) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def op6_pattern_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, "doc_id", "text")
