"""Removal of byte strings of a given length that start anywhere else, by a family of suffix arrays.

Every window of `length` bytes has an anchor: of the half-length strings inside it the one with the smallest hash
(the leftmost of equals). An anchor depends on the window's bytes alone, so equal windows have equal anchors, and only
about one position in fifty is an anchor. The windows of one anchor are consecutive; their bytes are its context.

1. Each chunk of texts sends its anchors (hash of the anchor, hash of the context, place), one for each distinct
   pair, to the task that owns the anchor. Contexts found twice settle all their windows as repeated. An anchor with
   several contexts leaves open which windows of those are shared.
2. The bytes of such contexts are sent on, by the anchor and half of what surrounds it, so that a string which very
   many texts share is spread by its surroundings: a window holds half of them on the left, or else on the right.
   Anchors of very many contexts would still be too much for one owner or one place. They are counted beforehand, have
   no owner, and send windows instead, by the windows' own fingerprints; windows that a chunk has twice are settled.
3. There, batches of contexts or windows get suffix arrays (the starts of windows, sorted by their first eight bytes and
   a fingerprint of all of them; equal are those that agree in both and in a second fingerprint, 192 bits in all). A
   batch's array is merge-scanned against the arrays of all levels, equal neighbours are repeated windows, and levels
   of like size are merged, so a suffix is merged a logarithmic number of times.
4. Settled and found windows come back to their texts as intervals, and the rest is kept.

Texts travel as compressed chunks. A chunk's number is its place in the scan, so the input must be a table that two
scans read alike (checked by a checksum); write other inputs to a table first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import U, buffers, mix, prefix_hash, second_hash, slices, span_hash, tidy
from .tokens import _spread

CHUNK = 1_000_000
ANCHOR = np.dtype([("a", "<u8"), ("c", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("q", "<u2"), ("twice", "u1")])
SPAN = np.dtype([("lo", "<u4"), ("hi", "<u4")])
SHIP = np.dtype([("lo", "<u4"), ("n", "<u2"), ("q", "<u2"), ("single", "u1")])
PIECE = np.dtype([("chunk", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("bytes", "<u2"), ("single", "u1")])
ENTRY = np.dtype([("head", "<u8"), ("mark", "<u8"), ("other", "<u8"), ("lo", "<u4"), ("single", "u1")])
SUFFIX_BATCH = 300_000  # windows of a new suffix array
SHIPPED = 100_000  # windows of hot anchors that are handled at once
HOT_SHARE = 8  # an anchor with more contexts than this part of a bucket's share is hot: there are few such anchors
HOT_LEAST = 1000  # but none with fewer contexts


def _number(count: int) -> int:
    return (TaskContext.get().partitionId() << 24) + count


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """The anchors of a chunk: a, c, lo (first window), n (windows), q (the anchor's place after lo)."""
    half = length // 2
    width = length - half + 1
    n = len(raw)
    if n < length:
        return np.zeros(0, ANCHOR)
    h = prefix_hash(raw)
    g = mix((h[half:] - h[:-half]) * _inverse(len(h) - half))
    bits = max(22, int(n).bit_length())
    place = U((1 << bits) - 1)
    key = (g & ~place) | np.arange(len(g), dtype=U)
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low
    # low[p] is of the window p; windows over two texts are none
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    valid = np.flatnonzero(np.arange(len(low)) + length <= row_end)
    if not len(valid):
        return np.zeros(0, ANCHOR)
    q = (low[valid] & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    out = np.zeros(len(first), ANCHOR)
    lo, q = valid[first], q[first]
    count = np.diff(np.append(first, len(valid)))
    out["a"], out["lo"], out["n"], out["q"] = g[q], lo, count, q - lo
    out["c"] = span_hash(h, lo, lo + count - 1 + length) + (q - lo).astype(U)
    return out


def _inverse(n: int) -> np.ndarray:
    from .arrowtext import INVERSE, powers

    return powers(INVERSE, n)


def _by(values: np.ndarray, bucket: np.ndarray):
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    have, start = np.unique(bucket[order], return_index=True)
    return [(int(b), values[order[i:j]]) for b, i, j in zip(have, start, np.append(start[1:], len(order)), strict=True)]


ROW = "kind int, bucket long, chunk long, crc long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])


def _chunks(column: pa.Array):
    raw, offsets, _ = buffers(column)
    for i, j in slices(offsets, CHUNK):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _scan(length: int, buckets: int, hot: np.ndarray):
    """kind 0: anchors for their owner; kind 1: spans of windows that are repeated within the chunk; kind 3: contexts of
    hot anchors, which have no owner and go to their chunk to be shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for _, _, raw, offsets in _chunks(batch.column(0)):
                chunk, crc = _number(count), zlib.crc32(raw)
                count += 1
                found = anchors(raw, offsets, length)
                _, first, back, size = _pairs(found)
                found["twice"] = size[back] > 1
                rows = []
                own = found[found["twice"] > 0]
                if len(own):
                    rows.append((1, chunk, chunk, crc, _spans(own, length).tobytes()))
                sent = found[np.sort(first)]
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, sent["a"]), len(hot) - 1)] == sent["a"]
                    if is_hot.any():
                        ship = np.zeros(int(is_hot.sum()), SHIP)
                        for k in ("lo", "n", "q"):
                            ship[k] = sent[k][is_hot]
                        ship["single"] = sent["twice"][is_hot] == 0
                        rows.append((3, chunk, chunk, crc, ship.tobytes()))
                    sent = sent[~is_hot]
                rows += [(0, b, chunk, crc, x.tobytes()) for b, x in _by(sent, sent["a"] % U(buckets))]
                yield _rows(rows)

    return run


def _pairs(found: np.ndarray):
    """(None, first index, inverse, counts) of distinct (a, c)."""
    order = np.lexsort((found["lo"], found["c"], found["a"]))
    a, c = found["a"][order], found["c"][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return None, order[start], back, np.diff(np.append(start, len(order)))


def _spans(found: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(found), SPAN)
    out["lo"] = found["lo"]
    out["hi"] = found["lo"] + found["n"].astype(np.uint32) - 1 + length
    return out


def _grouped(batches: Iterator[pa.RecordBatch]):
    """(bucket, list of (kind, chunk, crc, blob)) of rows that are sorted by bucket."""
    at, rows = None, []
    for batch in batches:
        for kind, bucket, chunk, crc, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if bucket != at:
                if rows:
                    yield at, rows
                at, rows = bucket, []
            rows.append((kind, chunk, crc, blob))
    if rows:
        yield at, rows


def _repeated(length: int):
    """(a, n): anchors of which a task has several contexts, with their number; a null anchor has the number of all."""

    def summed(parts):
        a = np.concatenate([x for x, _ in parts])
        have, inv = np.unique(a, return_inverse=True)
        return have, np.bincount(inv, np.concatenate([n for _, n in parts]), len(have)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for _, _, raw, offsets in _chunks(batch.column(0)):
                found = anchors(raw, offsets, length)
                a = found["a"][_pairs(found)[1]]
                total += len(a)
                held.append((a, np.ones(len(a), np.int64)))
            if sum(len(a) for a, _ in held) > 1_000_000:
                held = [summed(held)]
                # what is rare so far may still come often, but then it is not rare in the rest
                if len(held[0][0]) > 500_000:
                    often = held[0][1] > 1
                    held = [(held[0][0][often], held[0][1][often])]
        a, n = summed(held) if held else (np.zeros(0, U), np.zeros(0, np.int64))
        often = n > 1
        none = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a[often].view(np.int64)), none]), pa.array(np.append(n[often], total))], ["a", "n"])

    return run


def hot_anchors(texts: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Anchors with too many contexts for one owner; at most HOT_SHARE times `buckets`. Texts are hashed once more for
    it, as writing all anchors would take more memory and disk than that takes time."""
    sums = scratch.table(texts.mapInArrow(tidy(_repeated(length)), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")), "repeated")
    total = sums.where("a is null").first()
    least = max(HOT_LEAST, (total["n"] if total else 0) // (HOT_SHARE * buckets))
    rows = sums.where((F.col("n") > least) & F.col("a").isNotNull()).select("a").collect()
    scratch.drop(sums)
    return np.sort(np.array([r["a"] for r in rows], np.int64).view(U))


def _own(length: int):
    """Of an owner's anchors, for each chunk: kind 1, spans of contexts found twice; kind 2, contexts to ship."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            parts = [np.frombuffer(blob, ANCHOR) for _, _, _, blob in rows]
            found = np.concatenate(parts)
            of = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
            _, first, back, size = _pairs(found)
            twice = (size > 1) | (np.bincount(back, found["twice"], len(size)) > 0)
            head = found["a"][first]  # sorted by a
            several = np.zeros(len(first), bool)
            several[1:] |= head[1:] == head[:-1]
            several[:-1] |= head[:-1] == head[1:]
            # a context found twice settles its rows; its first row stands for it where others must be compared
            ship = several[back] & (~twice[back] | (np.arange(len(found)) == first[back]))
            settled = twice[back] & (found["twice"] == 0)
            out = []
            for mask, kind in ((settled, 1), (ship, 2)):
                at = np.flatnonzero(mask)
                some = found[at]
                if kind == 1:
                    blob = _spans(some, length)
                else:
                    blob = np.zeros(len(some), SHIP)
                    for k in ("lo", "n", "q"):
                        blob[k] = some[k]
                    blob["single"] = ~twice[back[at]]
                for r, x in _by(blob, of[at]):
                    out.append((kind, rows[r][1], rows[r][1], rows[r][2], x.tobytes()))
                    if len(out) >= 2000:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    return run


def _texts(extra: int):
    """kind 0: the compressed chunk, for the task that owns it (bucket: its number), with `extra` further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for i, j, raw, offsets in _chunks(batch.column(0)):
                chunk, crc = _number(count), zlib.crc32(raw)
                count += 1
                ids = batch.column(1)[i:j] if extra else pa.nulls(j - i, pa.int64())
                none = np.asarray(ids.is_null()).astype(np.uint8)
                head = np.array([j - i, len(raw)], "<i8").tobytes() + offsets.astype("<i8").tobytes() + np.asarray(ids.fill_null(0), "<i8").tobytes() + none.tobytes()
                yield _rows([(0, chunk, chunk, crc, head + codec.compress(raw, asbytes=True))])

    return run


def _unpack(blob: bytes):
    """(raw, offsets, ids, is null) of a packed chunk."""
    rows, size = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    offsets = np.frombuffer(blob, "<i8", rows + 1, 16)
    ids = np.frombuffer(blob, "<i8", rows, 16 + 8 * (rows + 1))
    at = 16 + 8 * (rows + 1) + 8 * rows
    none = np.frombuffer(blob, np.uint8, rows, at) > 0
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[at + rows :], decompressed_size=size), np.uint8) if size else np.zeros(0, np.uint8)
    return raw, offsets, ids, none


def _with_text(batches: Iterator[pa.RecordBatch]):
    """(chunk, raw, offsets, ids, is null, other rows) of every chunk."""
    for chunk, rows in _grouped(batches):
        text = [(crc, blob) for kind, _, crc, blob in rows if kind == 0]
        others = [(kind, blob) for kind, _, crc, blob in rows if kind > 0]
        if len(text) != 1 or any(crc != text[0][0] for _, _, crc, _ in rows):
            raise RuntimeError("two scans of the input differ; write it to a table first")
        yield chunk, text[0][0], *_unpack(text[0][1]), others


def _ship(length: int, buckets: int):
    """Contexts' bytes for the task that owns their anchor and half of what surrounds it (the kind is the number of
    contexts); windows of hot anchors for the task that owns their fingerprint (minus the number of windows); spans of
    windows that a chunk has twice (0)."""
    half = length // 2
    quarter = (length - half) // 2

    def parts(x: np.ndarray) -> Iterator[np.ndarray]:
        """Contexts of a bounded number of windows together."""
        many = np.cumsum(x["n"].astype(np.int64)) // SHIPPED
        for k in np.unique(many):
            yield x[many == k]

    def windows(raw: np.ndarray, x: np.ndarray, chunk: int, crc: int) -> Iterator[tuple]:
        n = x["n"].astype(np.int64)
        start = _spread(x["lo"].astype(np.int64), n)
        single = np.repeat(x["single"], n) > 0
        mark, other = span_hash(prefix_hash(raw), start, start + length), second_hash(raw, start, start + length)
        order = np.lexsort((~single, other, mark))  # of equal ones a single comes first
        new = np.concatenate([[True], (mark[order][1:] != mark[order][:-1]) | (other[order][1:] != other[order][:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        several = np.repeat(size > 1, size)
        settled = order[several & single[order]]
        if len(settled):
            span = np.zeros(len(settled), SPAN)
            span["lo"], span["hi"] = start[settled], start[settled] + length
            yield 0, chunk, chunk, crc, span.tobytes()
        at = order[first]
        entry = np.zeros(len(at), ENTRY)
        place = start[at]
        for k in range(8):
            entry["head"] |= raw[place + k].astype(U) << U(56 - 8 * k)
        entry["mark"], entry["other"], entry["lo"], entry["single"] = mark[at], other[at], place, single[at] & (size == 1)
        for bucket, e in _by(entry, entry["mark"] % U(buckets)):
            yield -len(e), bucket, chunk, crc, e.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, crc, raw, _, _, _, others in _with_text(batches):
            asked = [np.frombuffer(blob, SHIP) for kind, blob in others if kind == 2]
            hot = [np.frombuffer(blob, SHIP) for kind, blob in others if kind == 3]
            for x in parts(np.concatenate(hot)) if hot else ():
                yield _rows(list(windows(raw, x, chunk, crc)))
            if not asked:
                continue
            x = np.concatenate(asked)
            lo, n = x["lo"].astype(np.int64), x["n"].astype(np.int64)
            q = lo + x["q"]
            h = prefix_hash(raw)
            out = []
            for side in (0, 1):
                # windows that start at least `quarter` before the anchor, or the others
                a = lo if side == 0 else np.maximum(lo, q - quarter + 1)
                b = np.minimum(lo + n - 1, q - quarter) if side == 0 else lo + n - 1
                use = np.flatnonzero(a <= b)
                if not len(use):
                    continue
                a, b, at = a[use], b[use], q[use]
                key = span_hash(h, at, at + half) + (span_hash(h, at - quarter, at) if side == 0 else span_hash(h, at + half, at + half + (length - half - quarter) + 1))
                piece = np.zeros(len(use), PIECE)
                piece["chunk"], piece["lo"], piece["n"], piece["single"] = chunk, a, b - a + 1, x["single"][use]
                piece["bytes"] = b - a + length
                for bucket, k in _by(np.arange(len(use)), mix(key + U(side)) % U(buckets)):
                    data = raw[_spread(a[k], piece["bytes"][k].astype(np.int64))]
                    out.append((len(k), bucket, chunk, crc, piece[k].tobytes() + data.tobytes()))
            yield _rows(out)

    return run


class Level:
    """A suffix array: windows sorted by their first eight bytes, then by fingerprints. `ref` numbers the windows."""

    def __init__(self, head: np.ndarray, mark: np.ndarray, other: np.ndarray, ref: np.ndarray, ordered: bool = False):
        if not ordered:
            by = np.lexsort((other, mark, head))
            head, mark, other, ref = head[by], mark[by], other[by], ref[by]
        self.head, self.mark, self.other, self.ref = head, mark, other, ref

    def __len__(self) -> int:
        return len(self.ref)

    def repeats(self) -> np.ndarray:
        """Refs with an equal neighbour."""
        same = (self.head[1:] == self.head[:-1]) & (self.mark[1:] == self.mark[:-1]) & (self.other[1:] == self.other[:-1])
        hit = np.zeros(len(self), bool)
        hit[1:] |= same
        hit[:-1] |= same
        return self.ref[hit]

    def merged(self, other: Level) -> Level:
        """The linear merge of two arrays (a stable sort of two runs is one)."""
        head, mark, second, ref = (np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("head", "mark", "other", "ref"))
        by = np.argsort(head, kind="stable")
        head, mark, second, ref = head[by], mark[by], second[by], ref[by]
        # within equal heads, order by fingerprint
        tie = np.concatenate([[False], head[1:] == head[:-1]])
        if tie.any():
            group = np.cumsum(~tie)
            inside = np.flatnonzero(tie | np.append(tie[1:], False))
            order = inside[np.lexsort((second[inside], mark[inside], group[inside]))]
            mark[inside], second[inside], ref[inside] = mark[order], second[order], ref[order]
        return Level(head, mark, second, ref, True)


class Family:
    """Levels of suffix arrays of geometrically falling sizes."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, new: Level) -> list[np.ndarray]:
        """Take in a batch's array; refs of windows, old or new, now known to be repeated."""
        found = [new.repeats()]
        for level in self.levels:
            # merge-scan: where each new suffix would stand in the level; heads first, then fingerprints among equals
            lo = np.searchsorted(level.head, new.head, "left")
            hi = np.searchsorted(level.head, new.head, "right")
            at = np.flatnonzero(hi > lo)
            many = hi[at] - lo[at]
            i = np.repeat(at, many)
            j = np.repeat(lo[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            if len(i) > 4 * (len(new) + len(level)):  # heads that very many share: merge instead of pairing
                found.append(level.merged(new).repeats())
                continue
            hit = (new.mark[i] == level.mark[j]) & (new.other[i] == level.other[j])
            found += [new.ref[i[hit]], level.ref[j[hit]]]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self.levels.pop().merged(new)
        self.levels.append(new)
        return found


def _match(length: int):
    """Windows of shipped contexts that are repeated, as spans for their chunks."""

    def windows(pieces: np.ndarray, data: np.ndarray, base: int) -> Level:
        n = pieces["n"].astype(np.int64)
        size = pieces["bytes"].astype(np.int64)
        begin = np.cumsum(size) - size
        start = _spread(begin, n)
        h = prefix_hash(data)
        head = np.zeros(len(data), U)
        for k in range(8):
            head[: len(data) - k] |= data[k:].astype(U) << U(56 - 8 * k)
        return Level(head[start], span_hash(h, start, start + length), second_hash(data, start, start + length), base + np.arange(len(start)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            family, kept, hits, base = Family(), [], [], 0
            crcs: dict[int, int] = {}
            batch: list[tuple[np.ndarray, np.ndarray]] = []
            loose: list[tuple[int, np.ndarray]] = []
            held = 0

            def add(pieces: np.ndarray, level: Level) -> None:
                nonlocal base
                kept.append(pieces)
                base += len(level)
                hits.extend(family.add(level))

            def take() -> None:
                nonlocal batch, held, loose
                if batch:
                    pieces = np.concatenate([p for p, _ in batch])
                    add(pieces, windows(pieces, np.concatenate([d for _, d in batch]), base))
                if loose:
                    entry = np.concatenate([e for _, e in loose])
                    pieces = np.zeros(len(entry), PIECE)
                    pieces["chunk"] = np.repeat([c for c, _ in loose], [len(e) for _, e in loose])
                    pieces["lo"], pieces["n"], pieces["single"] = entry["lo"], 1, entry["single"]
                    add(pieces, Level(entry["head"], entry["mark"], entry["other"], base + np.arange(len(entry))))
                batch, loose, held = [], [], 0

            for count, chunk, crc, blob in rows:
                if count == 0:  # settled already
                    yield _rows([(1, chunk, chunk, crc, blob)])
                    continue
                crcs[chunk] = crc
                if count < 0:
                    loose.append((chunk, np.frombuffer(blob, ENTRY)))
                    held -= count
                else:
                    pieces = np.frombuffer(blob, PIECE, count)
                    batch.append((pieces, np.frombuffer(blob, np.uint8, offset=count * PIECE.itemsize)))
                    held += int(pieces["n"].sum())
                if held >= SUFFIX_BATCH:
                    take()
            if held:
                take()
            if not kept:
                continue
            pieces = np.concatenate(kept)
            hit = np.zeros(base, bool)
            for refs in hits:
                hit[refs] = True
            n = pieces["n"].astype(np.int64)
            of = np.repeat(np.arange(len(pieces)), n)
            at = np.flatnonzero(hit & (pieces["single"][of] > 0))
            place = at - (np.cumsum(n) - n)[of[at]] + pieces["lo"][of[at]]
            # consecutive windows of a piece make one span
            new = np.concatenate([[True], (of[at[1:]] != of[at[:-1]]) | (place[1:] != place[:-1] + 1)]) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            span = np.zeros(len(first), SPAN)
            if len(first):
                span["lo"], span["hi"] = place[first], place[last] + length
            chunk = pieces["chunk"][of[at[first]]] if len(first) else np.zeros(0, np.int64)
            yield _rows([(1, c, c, crcs[c], x.tobytes()) for c, x in _by(span, chunk)])

    return run


def _finish(texts: bool):
    """Results of every row: what the spans cover goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, raw, offsets, ids, none, others in _with_text(batches):
            edge = np.zeros(len(raw) + 1, np.int32)
            for kind, blob in others:
                if kind == 1:
                    span = np.frombuffer(blob, SPAN)
                    np.add.at(edge, span["lo"], 1)
                    np.add.at(edge, span["hi"], -1)
            gone = np.cumsum(edge[:-1]) > 0
            if texts:  # only whole characters go, so that what is left is text
                lead = np.flatnonzero((raw & 0xC0) != 0x80)
                size = np.diff(np.append(lead, len(raw)))
                if len(lead) and lead[0] == 0:
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), size)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[offsets[1:]] - total[offsets[:-1]]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(raw)]
            begins[inner] = gone[inner]
            total = np.concatenate([[0], np.cumsum(begins)])
            spans = total[offsets[1:]] - total[offsets[:-1]]
            rest = raw[~gone].tobytes()
            kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
            cells = [rest[a:b] for a, b in zip(kept, kept[1:], strict=False)]
            last = pa.array([c.decode(errors="replace") for c in cells], pa.string()) if texts else pa.array([hashlib.sha256(c).hexdigest() for c in cells], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=none), *(pa.array(x.astype(np.int64)) for x in (np.diff(offsets), removed, spans)), last],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def repeated_strings(docs: DataFrame, key: str, text: str, length: int = 200, texts: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for every row: bytes of strings of `length` bytes that start anywhere
    else, in the same text or another, are removed; `kept` is the SHA-256 of the rest or, with `texts`, the rest
    itself, where only whole characters are removed.

    Null texts are empty; texts shorter than `length` stay as they are; repeated rows are texts of their own and so
    remove each other; null keys stay null; an empty table gives no rows. `docs` must be a scan of a table.
    """
    if length < 32:
        raise ValueError("length must be at least 32")
    spark = docs.sparkSession
    scratch.small_batches(spark)
    buckets = 2 * scratch.partitions(spark)
    slim = docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("id"))
    hot = hot_anchors(slim.select("text"), length, buckets)
    found = slim.select("text").mapInArrow(tidy(_scan(length, buckets, hot)), ROW)
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "kind")
    # anchors go to their owners; spans settled within a chunk pass through with them, so texts are hashed once
    owned = scratch.table(by_bucket(found).mapInArrow(tidy(_split(length)), ROW), "settled")
    packed = slim.mapInArrow(tidy(_texts(1)), ROW)
    asked = owned.where("kind in (2, 3)")
    shipped = by_bucket(packed.unionByName(asked)).mapInArrow(tidy(_ship(length, buckets)), ROW)
    matched = scratch.table(shipped.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(_match(length)), ROW), "matched")
    spans = owned.where("kind = 1").unionByName(matched)
    out = by_bucket(packed.unionByName(spans)).mapInArrow(tidy(_finish(texts)), "id long, n_bytes long, n_removed long, n_spans long, kept string")
    return out.withColumnRenamed("id", key)


def _split(length: int):
    own = _own(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def anchors_only():
            for batch in batches:
                kind = batch.column(0).to_numpy()
                if (kind != 0).any():
                    through.append(batch.filter(pa.array(kind != 0)))
                yield batch.filter(pa.array(kind == 0))

        through: list[pa.RecordBatch] = []
        for out in own(anchors_only()):
            yield from through
            through.clear()
            yield out
        yield from through

    return run


def op5_suffix_family(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_strings(docs, "doc_id", "text", 200).withColumnRenamed("kept", "kept_sha256")


#: The same by brute force: every window of 200 bytes, in hexadecimal digits.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS byte, CASE WHEN 2 * (i + 200) <= length(h) THEN hash(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) END AS k FROM (SELECT r, h, unnest(range(length(h) // 2)) AS i FROM d)),
t AS (SELECT k FROM p WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, i, byte, coalesce(i - max(CASE WHEN t.k IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i) < 200, false) AS gone FROM p LEFT JOIN t ON p.k = t.k),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM c),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS rest FROM e GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
