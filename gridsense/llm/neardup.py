"""Near-duplicate groups by MinHash and an LSH forest, with links confirmed on full shingle sets.

1. Every text becomes its set of word shingles: its size, a 128-bit hash of the set, a MinHash signature.
2. Rows with one set become one representative (the smallest key); only those go on.
3. Each tree of the forest sorts representatives by its own order of signature values. Rows that share the first
   `DEPTH` values are a region; where a region is crowded, deeper prefixes are taken until few rows share one. Rows
   of a (sub)region are candidates of each other, and so are the nearest rows in sorted order, whose common prefix is
   longest. Candidates whose sketches agree make loose groups; a task returns a spanning forest of them.
4. Texts of loose groups are read again and the exact links of each group are found on full sets: a search from row to
   row that compares each row only with those not reached yet. A loose group that is too large for a task is cut
   into chunks: each chunk meets a pivot chunk; rows that this leaves outside the group's main component (few, if the
   group is one cluster) then meet every chunk, in blocks. So every pair that could join two components is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import U, buffers, mix, shingles, slices, word_hashes, tidy
from .components import components
from .vectors import forest

VALUES = 128  # MinHash values
DEPTH = 4  # values that rows of a region share
LONG = 16  # values of a tree's order
CROWDED = 48  # rows of a (sub)region that are all compared
NEAR = 6  # neighbours in sorted order that are compared anyway
HELD = 8192  # rows of a region that a task holds
STEP = 500_000
GROUP_BYTES = 48 << 20  # of shingles of a loose group that one task resolves
CHUNK_BYTES = 12 << 20

_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
_PAIRS = np.array([sum(((x >> (2 * k)) & 3) == 0 for k in range(4)) for x in range(256)], np.uint8)


def trees(ratio: float, miss: float = 1e-5) -> int:
    """Trees after which a pair of just that similarity is in no common region with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - ratio**DEPTH))


def orders(count: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(VALUES)[:LONG] for _ in range(count)])


def agreement(ratio: float) -> int:
    """Values of two bits that must agree: five standard deviations below what the similarity gives."""
    p = 0.25 + 0.75 * ratio
    return int(VALUES * p - 5 * math.sqrt(VALUES * p * (1 - p)))


def sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets) of rows."""
    h, row, _, _ = word_hashes(raw, offsets)
    s, at = shingles(h, row, width, len(offsets) - 1)
    bounds = np.searchsorted(at, np.arange(len(offsets)))
    parts = [np.unique(s[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return (np.concatenate(parts) if parts else s), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(s: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(rows, VALUES) of 32 bits; rows without shingles have all ones."""
    sig = np.full((len(out) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(out))
    starts = out[:-1][full]
    for k in range(VALUES if len(full) else 0):
        sig[full, k] = np.minimum.reduceat((s * _MULTIPLY[k]) >> U(32), starts).astype(np.uint32)
    return sig


def _prepare(width: int, count: int):
    order = orders(count)[:, :DEPTH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = buffers(batch.column(1))
            for i, j in slices(offsets, STEP):
                s, out = sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(out)
                sums = np.zeros((2, j - i), U)
                full = np.flatnonzero(n)
                if len(full):
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(s + U(0x632BE59BD9B4E019 * (k + 1) & 0xFFFFFFFFFFFFFFFF)), out[:-1][full])
                sig = signatures(s, out)
                keys = np.zeros((j - i, count), U)
                for t in range(count):
                    h = np.full(j - i, t + 1, U)
                    for k in order[t]:
                        h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, k])
                    keys[:, t] = h
                low = sig.astype(np.uint8)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(x.view(np.int64), mask=none) for x in sums), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())],
                    ["id", "n", "h1", "h2", "sig", "keys"],
                )

    return run


def _grow(count: int):
    """A row for each tree: its region, its order of values, a sketch of two bits a value."""
    order = orders(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(rows, VALUES)
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(rows, count)
            two = (sig & 3).reshape(rows, -1, 4)
            sketch = [x.tobytes() for x in (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6)]
            for t in range(count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, t]), pa.array([x.tobytes() for x in sig[:, order[t]]], pa.binary()), batch.column(0), batch.column(1), pa.array(sketch, pa.binary())],
                    ["region", "path", "id", "n", "sketch"],
                )

    return run


def candidates(region: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of rows sorted by region and path: all of a (sub)region of at most CROWDED rows, at the
    least depth that gives such, and NEAR neighbours in the order of a crowded region."""
    n = len(region)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    same = region[1:] == region[:-1]
    lcp = np.where(same, DEPTH, 0)
    alike = path[1:] == path[:-1]
    deep = np.cumprod(alike[:, DEPTH:], axis=1).sum(axis=1)
    lcp = np.where(same, DEPTH + deep, 0)
    open_ = np.ones(n, bool)
    for depth in range(DEPTH, LONG + 1):
        start = np.flatnonzero(np.concatenate([[True], lcp < depth]))
        size = np.diff(np.append(start, n))
        small = (size > 1) & (size <= CROWDED)
        member = np.repeat(small, size) & open_
        place = np.arange(n) - np.repeat(start, size)
        left = np.repeat(size, size) - place - 1
        at = np.flatnonzero(member & (left > 0))
        if len(at):
            c = left[at]
            i = np.repeat(at, c)
            j = i + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + 1
            pairs.append((i, j))
        crowded = np.repeat(size > CROWDED, size)
        if depth == DEPTH:
            for d in range(1, NEAR + 1):
                m = max(0, n - d)
                at = np.flatnonzero(crowded[:m] & (region[:m] == region[d : d + m]))
                pairs.append((at, at + d))
        open_ &= crowded
        if not open_.any():
            break
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs])


def _neighbours(ratio: float):
    least = agreement(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare(rows):
            region, path, ids, n, sketch = (np.concatenate(x) for x in zip(*rows, strict=True))
            i, j = candidates(region, path)
            a, b = [], []
            for k in range(0, len(i), 500_000):
                u, v = i[k : k + 500_000], j[k : k + 500_000]
                near = (np.minimum(n[u], n[v]) >= ratio * np.maximum(n[u], n[v])) & (ids[u] != ids[v])
                u, v = u[near], v[near]
                near = _PAIRS[sketch[u] ^ sketch[v]].sum(axis=1) >= least
                a.append(ids[u[near]])
                b.append(ids[v[near]])
            if not a or not sum(map(len, a)):
                return None
            x, y = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        size = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = (
                batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(rows, LONG),
                batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(rows, -1),
            )
            held.append(new)
            size += rows
            if size >= HELD:
                # go on from the start of the last region, or from the last rows of one that is larger than this
                all_ = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                begin = int(np.searchsorted(all_[0], all_[0][-1]))
                if begin == 0:
                    if (out := compare([all_])) is not None:
                        yield out
                    held = [tuple(x[-CROWDED:] for x in all_)]
                else:
                    if (out := compare([tuple(x[:begin] for x in all_)])) is not None:
                        yield out
                    held = [tuple(x[begin:] for x in all_)]
                size = len(held[0][0])
        if held and (out := compare(held)) is not None:
            yield out

    return run


def resolve(ids: np.ndarray, s: np.ndarray, out: np.ndarray, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of rows in components of two and more, by exact links between sets."""
    n = np.diff(out)
    values, s = np.unique(s, return_inverse=True)
    num, den = ratio
    # a set of its own comes once: sorting by size lets a row be compared with the sizes that can link
    by = np.argsort(n, kind="stable")
    rest = by
    label = np.full(len(ids), -1)
    mark = np.zeros(len(values), bool)
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue, members = [root], [root]
        while queue and len(rest):
            u = queue.pop()
            m = n[u]
            lo, hi = np.searchsorted(n[rest], [-(-num * m // den), den * m // num + 1])
            some = rest[lo:hi]
            if not len(some):
                continue
            mine = s[out[u] : out[u + 1]]
            mark[mine] = True
            size = n[some]
            ends = np.cumsum(size)
            spread = np.repeat(out[some] - (ends - size), size) + np.arange(ends[-1])
            both = np.add.reduceat(mark[s[spread]].astype(np.int64), ends - size)
            mark[mine] = False
            hit = den * both >= num * (m + size - both)
            if hit.any():
                found = some[hit]
                queue += found.tolist()
                members += found.tolist()
                keep = np.ones(len(rest), bool)
                keep[lo:hi] = ~hit
                rest = rest[keep]
        if len(members) > 1:
            label[members] = ids[members].min()
    got = label >= 0
    return ids[got], label[got]


GROUP = "label long, chunk int, id long, h1 long, h2 long, text string"


def _groups(batches: Iterator[pa.RecordBatch], width: int):
    """(label, chunk, ids, shingles, offsets) of each group of rows that come together; a row's set must have the
    128-bit hash it is known by, so that another text under the same id is passed over."""
    key, ids, parts = None, [], []
    taken: set[int] = set()  # hashes of the sets that the last id already has here

    def done():
        return key[0], key[1], np.array(ids), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    for batch in batches:
        raw, offsets, _ = buffers(batch.column(5))
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        id_, h1 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, j in slices(offsets, STEP):
            s, out = sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            for k in range(i, j):
                if keys[k] != key:
                    if ids:
                        yield done()
                    key, ids, parts = keys[k], [], []
                mine = s[out[k - i] : out[k - i + 1]]
                if not ids or ids[-1] != id_[k]:
                    taken.clear()
                if len(mine) and h1[k] not in taken and int(mix(mine + U(0x632BE59BD9B4E019)).sum(dtype=U).view(np.int64)) == h1[k]:
                    taken.add(h1[k])
                    ids.append(id_[k])
                    parts.append(mine)
    if ids:
        yield done()


def _star(found) -> pa.RecordBatch | None:
    a, b = found
    moved = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[moved]), pa.array(b[moved])], ["a", "b"]) if moved.any() else None


def _resolve_groups(width: int, ratio: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, s, out in _groups(batches, width):
            if (star := _star(resolve(ids, s, out, ratio))) is not None:
                yield star

    return run


BLOB = "label long, chunk int, ids binary, sets binary, ends binary"


def _blobs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, chunk, ids, s, out in _groups(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([chunk], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, s, out))], ["label", "chunk", "ids", "sets", "ends"])

    return run


def _unblob(ids, s, ends):
    return np.frombuffer(ids, np.int64), np.frombuffer(s, np.uint64), np.frombuffer(ends, np.int64)


def _meet(ratio: tuple[int, int]):
    """Exact components of two blobs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (_unblob(*(batch.column(c)[k].as_py() for c in cs)) for cs in ((0, 1, 2), (3, 4, 5)))
                new = ~np.isin(b[0], a[0])  # a row of both is taken once
                size = np.diff(b[2])
                ids = np.concatenate([a[0], b[0][new]])
                s = np.concatenate([a[1], b[1][np.repeat(new, size)]])
                out = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a[2]), size[new]]))]).astype(np.int64)
                if (star := _star(resolve(ids, s, out, ratio))) is not None:
                    yield star

    return run


def _large(rows: DataFrame, width: int, ratio: tuple[int, int]) -> DataFrame:
    """Exact components of loose groups that are cut into chunks."""
    chunks = rows.repartition("label", "chunk").sortWithinPartitions("label", "chunk", "id").mapInArrow(tidy(_blobs(width)), BLOB)
    chunks = scratch.table(chunks, "chunks")
    other = lambda df: df.select("label", *(F.col(c).alias(f"{c}_2") for c in ("ids", "sets", "ends")))
    meet = lambda df: chunks.join(df, "label").select("ids", "sets", "ends", "ids_2", "sets_2", "ends_2").repartition(scratch.partitions(rows.sparkSession)).mapInArrow(tidy(_meet(ratio)), "a long, b long")
    # the pivot chunk is one bounded row a group
    first = scratch.table(meet(other(chunks.where("chunk = 0"))), "links")
    found = components(first, "a", "b")
    named = rows.select("label", "id", "chunk", "h1", "h2", "text").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = named.groupBy("label", "component").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = named.join(main, "label").where("component != main").select("label", "chunk", "id", "h1", "h2", "text")
    blocks = outside.repartition("label", "chunk").sortWithinPartitions("label", "chunk", "id").mapInArrow(tidy(_blobs(width)), BLOB)
    second = meet(other(scratch.table(blocks, "outside")))
    return components(first.unionByName(second), "a", "b").where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, key: str, text: str, width: int = 5, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; links are pairs with den * common >= num * union.

    Null texts and texts without words have no shingles, link with nothing, and are kept. Rows with equal sets are
    linked. Repeated rows and rows that share a key are one document to the groups, a row each in the result; with a
    null key a row is kept and its component is null. An empty table gives no rows.
    """
    scratch.small_batches(docs.sparkSession)
    share = ratio[0] / ratio[1]
    count = trees(share)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = scratch.table(slim.mapInArrow(tidy(_prepare(width, count)), "id long, n long, h1 long, h2 long, sig binary, keys binary"), "signatures")
    # written, so that joins on it shuffle both sides and the planner can split a set that very many rows have
    reps = scratch.table(rows.where("h1 is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "sets")
    grown = rows.where("h1 is not null and id is not null").join(reps, ["h1", "h2"]).where("id = rep").select("id", "n", "sig", "keys")
    forest_rows = grown.mapInArrow(tidy(_grow(count)), "region long, path binary, id long, n long, sketch binary")
    parts = 2 * scratch.partitions(docs.sparkSession)
    near = forest_rows.repartitionByRange(parts, "region", "path", "id").sortWithinPartitions("region", "path", "id").mapInArrow(tidy(_neighbours(share)), "a long, b long")
    loose = components(scratch.table(near, "loose"), "a", "b").withColumnRenamed("component", "label")
    loose = loose.join(rows.where("h1 is not null").select("id", "n", "h1", "h2").join(reps, ["h1", "h2"]).where("id = rep").select("id", "n", "h1", "h2").distinct(), "id")
    weight = loose.groupBy("label").agg((F.sum("n") * 8).alias("bytes"))
    dealt = loose.join(weight, "label").select("id", "label", "h1", "h2", F.when(F.col("bytes") <= GROUP_BYTES, -1).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("bytes") / CHUNK_BYTES))).cast("int").alias("chunk"))
    dealt = scratch.table(dealt, "dealt")
    # `dealt` grows with the corpus, so it is never broadcast
    texts = slim.join(dealt.hint("merge"), "id").select("label", "chunk", "id", "h1", "h2", "text")
    small = texts.where("chunk = -1").repartition("label").sortWithinPartitions("label", "id").mapInArrow(tidy(_resolve_groups(width, ratio)), "a long, b long")
    links = small
    if dealt.where("chunk >= 0").limit(1).count():
        links = small.unionByName(_large(scratch.table(texts.where("chunk >= 0"), "large"), width, ratio))
    links = scratch.table(links, "stars")
    # two ids of one row's key may name different sets: then their components are one
    final = components(links.unionByName(_same_key(rows, reps)), "a", "b")
    out = rows.select("id", "n", "h1", "h2").join(reps, ["h1", "h2"], "left").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")).withColumn("kept", F.col("kept") | F.col(key).isNull()).withColumn("component_id", F.when(F.col(key).isNotNull(), F.col("component_id")))


def _same_key(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the representatives of different sets under one key."""
    twice = rows.where("h1 is not null and id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    of = rows.join(twice, "id", "left_semi").join(reps, ["h1", "h2"]).groupBy("id").agg(F.collect_set("rep").alias("r")).where(F.size("r") > 1)
    return of.select(F.explode("r").alias("a"), F.array_min("r").alias("b")).where("a != b")


def op3_lsh_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, "doc_id", "text", 3, (85, 100))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d
), c AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS h, g FROM s),
r AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM c WHERE n > 0 GROUP BY h),
u AS (SELECT rep, n, unnest(g) AS x FROM r),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
k AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, coalesce(k.component, c.doc_id) AS component_id, coalesce(k.component, c.doc_id) = c.doc_id AS kept
FROM c LEFT JOIN r ON c.h = r.h LEFT JOIN k ON k.a = r.rep
"""
