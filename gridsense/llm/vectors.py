"""Cosine links between vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of few dimensions. Two vectors of
cosine >= c are at squared distance <= 2 - 2c, so in at least one block their squared distance is within the block's
share of that, its share of the dimensions. Each block is joined by range over all its coordinates: a tree of cells,
cut at medians of a bounded sample, gives every vector one home cell, and the vector visits the lower-numbered cells
within the block's radius as a guest. A cell with many vectors is dealt into chunks of bounded size, each of which
meets the cell's other vectors as a stream. Within a task a second tree over the chunk leaves few pairs to compare.

Rotated coordinates are rounded to a grid of 2**-14, and budgets are widened by what rounding can add. Distances in a
block are then exact whole numbers wherever they are computed, so a pair that several blocks propose counts in the
first of them and in no other, and nothing has to be made distinct. Candidates are verified by cosine in double
precision. Tasks return sums of links and spanning forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components

BLOCK_DIMS = 8
GRID = 1 << 14  # coordinates fit 16 bits
CHUNK = 16384  # vectors of a cell that a task holds
LEAF = 128  # vectors of a chunk that are compared at once
BATCH = 8192  # vectors that meet a chunk at once
SAMPLE = 20_000  # vectors of one length that the cells are cut by; no result depends on it
PAIRS = 200_000  # candidates that are verified at once


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=64)
def layout(dim: int, cosine: float) -> tuple[tuple[slice, float], ...]:
    """(dimensions, squared-distance budget in grid steps) of each block."""
    n = max(1, dim // BLOCK_DIMS)
    cuts = [dim * i // n for i in range(n + 1)]
    # two rounded coordinates are at most one step further apart than the exact ones
    budget = lambda k: float(np.ceil((np.sqrt((2 - 2 * cosine) * k / dim + 1e-12) * GRID + np.sqrt(k)) ** 2))
    return tuple((slice(a, b), budget(b - a)) for a, b in zip(cuts, cuts[1:], strict=False))


class Cells:
    """A binary tree of boxes over points; leaves are numbered from left to right."""

    def __init__(self, points: np.ndarray, leaf: float, spread: float, tight: bool):
        """Boxes of over `leaf` points are cut at the median where points spread most, if their deviation there is over
        `spread`. A `tight` box ends at its points; else boxes fill the space, so that any vector has one."""
        points = points.astype(np.float32)
        k = points.shape[1]
        self.low, self.high, self.child, self.axis, self.cut, self.span, self.order = [], [], [], [], [], [], []
        at = 0
        stack = [(np.arange(len(points)), np.full(k, -np.inf, np.float32), np.full(k, np.inf, np.float32), None)]
        while stack:
            rows, low, high, parent = stack.pop()
            mine = points[rows]
            node = len(self.child)
            if parent is not None:
                self.child[parent].append(node)
            self.low.append(mine.min(axis=0) if tight and len(rows) else low)
            self.high.append(mine.max(axis=0) if tight and len(rows) else high)
            self.child.append([])
            axis, cut, left = -1, 0.0, None
            if len(rows) > leaf:
                wide = mine.std(axis=0)
                axis = int(np.argmax(wide))
                cut = np.median(mine[:, axis])
                left = mine[:, axis] < cut
                if wide[axis] <= spread or not left.any():
                    axis = -1
            self.axis.append(axis)
            self.cut.append(cut)
            self.span.append((at, at + len(rows)) if axis < 0 else None)
            if axis < 0:
                self.order.append(rows)
                at += len(rows)
                continue
            below, above = high.copy(), low.copy()
            below[axis], above[axis] = cut, cut
            stack += [(rows[~left], above, high, node), (rows[left], low, below, node)]
        self.leaves = [node for node, span in enumerate(self.span) if span]
        self.number = {node: i for i, node in enumerate(self.leaves)}
        self.order = np.concatenate(self.order)

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf number of each point."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if self.axis[node] < 0:
                out[rows] = self.number[node]
            else:
                left = points[rows, self.axis[node]] < self.cut[node]
                stack += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out

    def within(self, points: np.ndarray, budget: float) -> Iterator[tuple[int, np.ndarray]]:
        """(node of a leaf, rows of the points whose squared distance to its box is within the budget)."""
        points = points.astype(np.float32)
        budget *= 1 + 1e-5  # single precision
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            mine = points[rows]
            gap = np.maximum(self.low[node] - mine, mine - self.high[node])
            np.maximum(gap, 0, out=gap)
            rows = rows[np.einsum("ij,ij->i", gap, gap) <= budget]
            if len(rows) == 0:
                continue
            if self.axis[node] < 0:
                yield node, rows
            else:
                stack += [(c, rows) for c in self.child[node]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that connect what the links a-b connect."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _vectors(column, dim: int) -> np.ndarray:
    """Vectors of one length, in single precision where that loses nothing, else in double."""
    offsets, data = _bytes(column)
    size = np.diff(offsets)
    out = np.empty((len(size), dim))
    for width, kind in ((4, "<f4"), (8, "<f8")):
        at = np.flatnonzero(size == width * dim)
        if len(at):
            out[at] = data[offsets[at][:, None] + np.arange(width * dim)].view(kind)
    return out


def _grid(column, dim: int) -> np.ndarray:
    offsets, data = _bytes(column)
    return data[offsets[0] : offsets[-1]].view("<i2").reshape(-1, dim).astype(np.float64)


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, and their rotated coordinates on the grid."""
    for batch in batches:
        dims = batch.column(3).to_numpy()
        lists = batch.column(2)
        values, ends = np.asarray(lists.flatten(), np.float64), np.concatenate([[0], np.cumsum(dims)])
        raw: list = [None] * len(dims)
        grid: list = [None] * len(dims)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = values[ends[at][:, None] + np.arange(dim)]
            single = x.astype("<f4")
            short = (single == x).all(axis=1)
            y = np.rint(_unit(x) @ rotation(dim) * GRID).astype("<i2")
            for k, row in enumerate(at.tolist()):
                raw[row] = single[k] if short[k] else x[k]
                grid[row] = y[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(3), _binary(raw), _binary(grid)], ["id", "m", "v", "dim", "vec", "grid"])


def _cells(sample: list, counts: dict[int, int], cosine: float) -> dict[int, list[tuple[Cells, list[int]]]]:
    """For each length, the cells of each block and the number of chunks of each cell."""
    out = {}
    for dim, n in counts.items():
        y = np.array([np.frombuffer(r["grid"], "<i2") for r in sample if r["dim"] == dim], np.float64).reshape(-1, dim)
        share = max(1, n) / max(1, len(y))
        out[dim] = []
        for d, budget in layout(dim, cosine):
            # a cell much narrower than the radius would only send its vectors to all cells around it
            cells = Cells(y[:, d], max(16, CHUNK / share), np.sqrt(budget) / 3, False)
            sizes = np.bincount(cells.homes(y[:, d]), minlength=len(cells.leaves))
            out[dim].append((cells, [max(1, int(np.ceil(1.1 * share * s / CHUNK))) for s in sizes]))
    return out


def _deal(cells: dict[int, list[tuple[Cells, list[int]]]], cosine: float):
    """A home row for each vector and block; guest rows for the chunks of its cell and of lower cells in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            nodes = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                y = _grid(batch.column(4).take(pa.array(at)), dim)
                parts = []  # rows of the batch, block, cell, chunk, kind
                for block, (d, budget) in enumerate(layout(dim, cosine)):
                    tree, chunks = cells[dim][block]
                    chunks = np.array(chunks)
                    home = tree.homes(y[:, d])
                    parts.append((at, np.full(len(at), block), home, (nodes[at] * 2654435761 >> 7) % chunks[home], np.zeros(len(at), np.int64)))
                    for node, near in tree.within(y[:, d], budget):
                        number = tree.number[node]
                        near = near[home[near] >= number]
                        kind = np.where(home[near] == number, 1, 2)
                        parts += [(at[near], np.full(len(near), block), np.full(len(near), number), np.full(len(near), c), kind) for c in range(chunks[number])]
                rows, *keys = (np.concatenate(x) for x in zip(*parts, strict=True))
                # rows of one vector side by side: what is shuffled then compresses well
                order = np.argsort(rows, kind="stable")
                for k in range(0, len(rows), 10_000):
                    some = order[k : k + 10_000]
                    taken = batch.take(pa.array(rows[some]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x[some].astype(np.int32)) for x in keys)], ["node", "dim", "m", "vec", "grid", "block", "cell", "chunk", "kind"])

    return run


class _Chunk:
    """The vectors at home in one chunk of a cell, and what they were found linked with."""

    def __init__(self, key: tuple, cosine: float):
        self.dim, self.block = key[0], key[1]
        self.cosine, self.layout = cosine, layout(key[0], cosine)
        self.parts: list[tuple] = []
        self.tree = None
        self.found: list[tuple] = []

    def rows(self, batch) -> tuple:
        return batch.column(0).to_numpy(), batch.column(2).to_numpy(), _unit(_vectors(batch.column(3), self.dim)), _grid(batch.column(4), self.dim)

    def add(self, batch) -> None:
        self.parts.append(self.rows(batch))

    def plant(self) -> None:
        node, m, x, y = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        d, _ = self.layout[self.block]
        self.tree = Cells(y[:, d], LEAF, 0.0, True)
        order = self.tree.order
        self.node, self.m, self.x, self.y = node[order], m[order], x[order], y[order]
        self.low = (self.y[:, d] / GRID).astype(np.float32)
        self.square = (self.low * self.low).sum(axis=1)

    def meet(self, batch, same: bool) -> None:
        if self.tree is None:
            if not self.parts:
                return
            self.plant()
        node, m, x, y = self.rows(batch)
        d, budget = self.layout[self.block]
        low = (y[:, d] / GRID).astype(np.float32)
        square = (low * low).sum(axis=1)
        held, size = [], 0
        for leaf, rows in self.tree.within(y[:, d], budget):
            a, b = self.tree.span[leaf]
            near = self.low[a:b] @ low[rows].T
            near *= -2
            near += self.square[a:b, None]
            near += square[rows]
            i, j = np.nonzero(near <= budget / GRID**2 + 1e-5)
            held.append((i + a, rows[j]))
            size += len(i)
            if size > PAIRS:
                self.verify(held, node, m, x, y, same)
                held, size = [], 0
        self.verify(held, node, m, x, y, same)

    def verify(self, held: list[tuple], node, m, x, y, same: bool) -> None:
        if not held:
            return
        i, j = (np.concatenate(p) for p in zip(*held, strict=True))
        if same:
            pick = self.node[i] < node[j]
            i, j = i[pick], j[pick]
        # this block must propose the pair, and no block before it
        for block in [self.block, *range(self.block)]:
            d, budget = self.layout[block]
            gap = self.y[i, d] - y[j, d]
            pick = (np.einsum("ij,ij->i", gap, gap) <= budget) == (block == self.block)
            i, j = i[pick], j[pick]
        hit = np.einsum("ij,ij->i", self.x[i], x[j]) >= self.cosine
        i, j = i[hit], j[hit]
        if len(i):
            self.found.append((self.node[i], node[j], self.m[i], m[j]))

    def close(self) -> Iterator[pa.RecordBatch]:
        """Sums and spanning forest of what was found since the last call."""
        if not self.found:
            return
        a, b, ma, mb = (np.concatenate(p) for p in zip(*self.found, strict=True))
        self.found = []
        nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        sums = np.bincount(inv, np.concatenate([mb, ma])).astype(np.int64)
        u, v = forest(a, b)
        none = np.concatenate([np.ones(len(nodes), bool), np.zeros(len(u), bool)])
        to = np.concatenate([np.full(len(nodes), -1), v]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, u])), pa.array(to, mask=none), pa.array(np.concatenate([sums, np.zeros(len(u), np.int64)]))], ["a", "b", "n"])


def _join(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, key, waiting, kind = None, None, [], 0

        def settle():
            """Give the chunk the rows that wait for it."""
            if waiting:
                rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting.clear()
                for batch in rows:
                    chunk.meet(batch, kind == 1)
                if sum(len(f[0]) for f in chunk.found) > 2 * PAIRS:
                    yield from chunk.close()

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (1, 5, 6, 7, 8)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                *now, what = keys[lo].tolist()
                if tuple(now) != key or what != kind:
                    yield from settle()
                if tuple(now) != key:
                    if chunk is not None:
                        yield from chunk.close()
                    key = tuple(now)
                    chunk = _Chunk(key, cosine)
                kind = what
                if kind == 0:
                    chunk.add(batch.slice(lo, hi - lo))
                else:
                    waiting.append(batch.slice(lo, hi - lo))
                    if sum(b.num_rows for b in waiting) >= BATCH:
                        yield from settle()
        if chunk is not None:
            yield from settle()
            yield from chunk.close()

    return run


def link(vectors: DataFrame, key: str, vector: str, cosine: float) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; `cosine` must be positive.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other, and rows with a null key. Equal vectors link (cosine 1) and are joined as one
    with their number. Repeated rows, and several vectors under one key, count as vectors of their own with one id: each
    gives one row. An empty table gives no rows. Vectors are supposed to have few different lengths.
    """
    spark = vectors.sparkSession
    double = F.col(vector).cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(double, lambda x: x != 0)
    # a squared norm that under- or overflows is brought back by the largest component
    top = F.array_max(F.transform(double, lambda x: F.abs(x)))
    scaled = F.when((top > 1e100) | (top < 1e-100), F.transform(double, lambda x: x / top)).otherwise(double)
    # -0.0 and 0.0 are one
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(finite, F.transform(scaled, lambda x: x + F.lit(0.0))).alias("v"))
    good = rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    reps = good.select("id", "m", "v", F.size("v").alias("dim")).mapInArrow(_rotate, "id long, m long, v array<double>, dim int, vec binary, grid binary")
    reps = scratch.table(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        counts = {1: 0}
    every = F.create_map(*chain.from_iterable((F.lit(d), F.lit(max(1, n))) for d, n in counts.items()))
    sample = reps.where(F.pmod(F.xxhash64("node"), every[F.col("dim")]) < SAMPLE).select("dim", "grid").collect()
    cells = _cells(sample, counts, cosine)
    dealt = reps.select("node", "dim", "m", "vec", "grid").mapInArrow(_deal(cells, cosine), "node long, dim int, m long, vec binary, grid binary, block int, cell int, chunk int, kind int")
    keys = ["dim", "block", "cell", "chunk"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_join(cosine), "a long, b long, n long")
    found = scratch.table(found, "links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null"), "a", "b").select(F.col("id").alias("p"), "component")
    info = reps.select("node", "id", "m").join(sums, F.col("node") == sums["a"], "left").join(parts, F.col("node") == F.col("p"), "left")
    info = info.select("node", "id", "m", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    info = scratch.table(info, "linked")
    least = info.groupBy("component").agg(F.min("id").alias("component_id"))
    info = info.join(least, "component").select("node", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id")
    # every row finds its representative by its vector; a group of equal vectors repeats one small row
    of = rows.where("v is not null and id is not null").join(reps.select("v", "node"), "v").select("id", "node").join(info, "node").select("id", "n_links", "component_id")
    alone = rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = of.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_pigeonhole_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.95)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(p.component_id, e.vec_id) AS component_id,
       coalesce(p.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN part p ON e.vec_id = p.a LEFT JOIN deg d ON e.vec_id = d.a
"""
