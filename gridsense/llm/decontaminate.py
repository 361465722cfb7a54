"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

The benchmark is the query set, and its words (letters and digits, lowered) are the vocabulary. The corpus is read
once and written as numbers of vocabulary words; all later passes read that. Document frequencies are counted over all
documents. The corpus is cut into passages, and a randomised SVD of their TF-IDF matrix over the vocabulary gives the
latent space: tasks sum the passages' products of two words, which are the entries of A'A, and subspace iteration
multiplies them from tasks. Words that the corpus uses alike are close there, though no passage holds both.

Documents are cut again, into overlapping windows, for each class of item lengths of a size that holds a whole item; a
window is projected and compared with all items by cosine. A space of few dimensions says little of an item of words
that nothing relates, and much other text in a window lowers its cosine, so every item of which the window brings
enough by the exact TF-IDF product is a candidate too. A candidate must have enough words of the item at all, and is
then confirmed: the longest common subsequence of words must cover most of the item, and an item's answer, if it has
one, must stand in the window: all words of a short one, most of a longer one in order. Very frequent words are left
out of the features, but every item keeps its rarest. Larger benchmarks are taken in blocks of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import LOWER, U, buffers, prefix_hash, slices, span_hash, words, tidy

BLOCK_ITEMS = 10_000  # items of a block; what is sent to tasks is bounded by it
RANK = 64  # dimensions of the latent space, and at most a quarter of the features
PASSAGE = 64  # words of a passage
ROUNDS = 3  # products of the subspace iteration
COMMON = 0.05  # share of documents from which a word is too frequent to be a feature
RAREST = 8  # features that an item keeps anyway
COSINE = 0.35
MASS = 0.25  # of an item's squared length that the window must bring
COVER = 0.7  # of an item's words that the subsequence must cover
SHORT = 10  # items of fewer words must be covered whole
ANSWER = 5  # answers of more words need only be covered as items are
CELLS = 2_000_000  # products of windows and items that are held at once
WORDS = 100_000  # words of documents that are handled at once; a longer document is handled alone
PAIRS = 1_000_000  # pairs of words that a task holds before it adds them up
TABLE = 22

_BREAK = np.zeros(256, bool)
for _c in range(128):
    _BREAK[_c] = not chr(_c).isalnum()


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    bare = LOWER[raw]
    bare[_BREAK[raw]] = 32
    start, end, row = words(bare, offsets)
    return span_hash(prefix_hash(bare), start, end), row


def answer(text: str) -> str:
    """What follows `Answer:` or the last question mark; empty if neither is there."""
    m = re.search(r"(?is)\banswer\s*:\s*(.+)$", text) or re.search(r"(?s)\?\s*([^?]+)$", text)
    return m[1] if m else ""


class Items:
    """A block of items: words, answers, and (once document frequencies are known) features and latent vectors."""

    def __init__(self, ids: list, texts: list[str]):
        pairs = []
        for i, t in zip(ids, texts, strict=True):
            w = self._words(t)
            if len(w):
                pairs.append((i, w, self._words(answer(t))))
        self.ids = [p[0] for p in pairs]
        self.words = [p[1] for p in pairs]
        self.answers = [p[2] for p in pairs]
        self.vocabulary = np.unique(np.concatenate(self.words)) if pairs else np.zeros(0, U)
        self.scale = np.array([max(16, 1 << int(len(w) - 1).bit_length()) for w in self.words], np.int64)
        # the subsequence that confirms an item has as many words as this
        self.need = np.array([len(w) if len(w) < SHORT else int(np.ceil(COVER * len(w))) for w in self.words], np.int64)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.number = np.searchsorted(self.vocabulary, np.concatenate(self.words)) if pairs else np.zeros(0, np.int64)

    @staticmethod
    def _words(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return tokens(raw, np.array([0, len(raw)]))[0]

    @property
    def none(self) -> int:
        """The number of words outside the vocabulary."""
        return len(self.vocabulary)

    @property
    def kind(self) -> str:
        return "<u2" if self.none < 1 << 16 else "<u4"

    def lookup(self) -> np.ndarray:
        table = np.zeros(1 << TABLE, bool)
        table[(self.vocabulary >> U(64 - TABLE)).astype(np.int64)] = True
        return table

    def code(self, h: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The number of each word."""
        out = np.full(len(h), self.none, self.kind)
        at = np.flatnonzero(table[(h >> U(64 - TABLE)).astype(np.int64)])
        f = np.minimum(np.searchsorted(self.vocabulary, h[at]), self.none - 1)
        ok = self.vocabulary[f] == h[at]
        out[at[ok]] = f[ok]
        return out

    def weigh(self, df: np.ndarray, documents: int) -> None:
        """Choose features by their document frequencies and weigh them."""
        idf = np.log((1 + documents) / (1 + df)) + 0.1
        use = df <= COMMON * documents
        for w in self.words:
            f = np.searchsorted(self.vocabulary, np.unique(w))
            use[f[np.argsort(-idf[f], kind="stable")[:RAREST]]] = True
        self.features, self.idf = self.vocabulary[use], idf[use]
        self.feature = np.append(np.where(use, np.cumsum(use) - 1, -1), -1)  # by number of the word
        rows = []
        for start, size in zip(self.start, self.size, strict=True):
            mine = self.number[start : start + size]
            mine[:] = mine[np.argsort(-idf[mine], kind="stable")]  # rarest words first
            f = self.feature[mine]
            rows.append(np.unique(f[f >= 0], return_counts=True))
        self.rows = [(f, c * self.idf[f]) for f, c in rows]
        most = np.ones(len(self.features))
        for f, c in rows:
            most[f] = np.maximum(most[f], c)
        self.bound = self.idf**2 * most  # what a hit can add to the product with any item, at most
        self.square = np.array([(v * v).sum() for _, v in self.rows])
        self.postings = {}  # by scale: for each feature the items, by place in their scale, and what a hit adds to the product
        for scale in np.unique(self.scale).tolist():
            mine = [self.rows[k] for k in np.flatnonzero(self.scale == scale)]
            f = np.concatenate([f for f, _ in mine])
            order = np.argsort(f, kind="stable")
            item = np.repeat(np.arange(len(mine)), [len(f) for f, _ in mine])[order]
            adds = (np.concatenate([v for _, v in mine]) * self.idf[f])[order]
            self.postings[scale] = np.searchsorted(f[order], np.arange(len(self.features) + 1)), item, adds

    def product(self, scale: int, windows: int, window: np.ndarray, f: np.ndarray) -> np.ndarray:
        """(windows, items of the scale): the exact TF-IDF product, from hits of features in windows."""
        start, item, adds = self.postings[scale]
        many = int((self.scale == scale).sum())
        n = start[f + 1] - start[f]
        at = np.repeat(start[f] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(window, n) * many + item[at], adds[at], windows * many).reshape(windows, many)

    def project(self, basis: np.ndarray) -> None:
        """Vectors of words, and of items at length 1 (0 if the space has nothing of them)."""
        self.word_vectors = (self.idf[:, None] * basis).astype(np.float32)
        latent = np.stack([basis[f].T @ v for f, v in self.rows])
        norm = np.sqrt((latent**2).sum(axis=1))[:, None]
        self.latent = np.where(norm > 1e-9, latent / np.maximum(norm, 1e-9), 0).astype(np.float32)

    def confirm(self, item: int, window: np.ndarray) -> float:
        """The covered share of the item's words if it suffices and the answer is there, else 0. Bit-parallel LCS."""
        mine, answer = self.words[item], self.answers[item]
        n = len(mine)
        lcs = _common(mine, window)
        if lcs < (n if n < SHORT else COVER * n):
            return 0.0
        if len(answer) > ANSWER:
            if _common(answer, window) < COVER * len(answer):
                return 0.0
        elif not set(answer.tolist()) <= set(window.tolist()):
            return 0.0
        return lcs / n


def _common(mine: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    n = len(mine)
    masks: dict[int, int] = {}
    for k, w in enumerate(mine.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << n) - 1
    v = full
    for w in window.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


CODED = "rid long, words binary"


def _coded(items: Items):
    """Documents as numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = items.lookup(), np.dtype(items.kind).itemsize
        for batch in batches:
            raw, offsets, _ = buffers(batch.column(1))
            for i, j in slices(offsets):
                h, row = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32) * np.int32(width)
                words = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(items.code(h, table))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words], ["rid", "words"])

    return run


def _documents(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, numbers of words, where each document begins and the last ends) of documents of bounded length together."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        raw, offsets, _ = buffers(batch.column(1))
        for i, j in slices(offsets, WORDS * width):
            yield batch.column(0).slice(i, j - i), raw[offsets[i] : offsets[j]].view(kind), (offsets[i : j + 1] - offsets[i]) // width


def _frequencies(items: Items):
    """In how many documents each word of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(items.none, np.int64)
        for _, words, begin in _documents(batches, items.kind):
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            at = words < items.none
            seen = np.unique(row[at] * items.none + words[at])
            n += np.bincount(seen % items.none, minlength=items.none)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["f", "n"])

    return run


def pair_products(passage: np.ndarray, f: np.ndarray, v: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(f * features + g, sum of products) over f <= g, of a sparse matrix sorted by passage and feature."""
    end = np.searchsorted(passage, passage, "right")
    many = end - np.arange(len(passage))
    i = np.repeat(np.arange(len(passage)), many)
    j = i + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    key, inv = np.unique(f[i] * features + f[j], return_inverse=True)
    return key, np.bincount(inv, v[i] * v[j], len(key))


def _products(items: Items):
    """The products of two features, summed over the passages of a task: each passage has length 1."""
    features = len(items.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            key, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(inv, np.concatenate([v for _, v in held]), len(key))

        def pack(key, v):
            return pa.RecordBatch.from_arrays([pa.array(key // features), pa.array(key % features), pa.array(v)], ["f", "g", "v"])

        for _, words, begin in _documents(batches, items.kind):
            f = items.feature[words]
            at = np.flatnonzero(f >= 0)
            size = np.diff(begin)
            count = -(-size // PASSAGE)
            row = np.searchsorted(begin, at, "right") - 1
            passage = (np.cumsum(count) - count)[row] + (at - begin[row]) // PASSAGE
            key, c = np.unique(passage * features + f[at], return_counts=True)
            passage, f = key // features, key % features
            v = c * items.idf[f]
            passage = np.unique(passage, return_inverse=True)[1]
            v /= np.sqrt(np.bincount(passage, v * v))[passage] if len(v) else 1
            held.append(pair_products(passage, f, v, features))
            if sum(len(k) for k, _ in held) > PAIRS:
                held = [added()]
                if len(held[0][0]) > PAIRS // 2:
                    yield pack(*held[0])
                    held = []
        if held:
            yield pack(*added())

    return run


def randomised_svd(products: DataFrame, features: int, rank: int) -> np.ndarray:
    """(features, rank) right singular vectors of a matrix A, from the entries (f, g, v) with f <= g of A'A, by subspace
    iteration from a random start. Only A'A X, of rank + 10 columns, comes to the driver."""
    spark = products.sparkSession
    rank = max(1, min(rank, features))
    many = min(features, rank + 10)
    both = F.when(F.col("f") == F.col("g"), F.array(F.struct("f", "g"))).otherwise(F.array(F.struct("f", "g"), F.struct(F.col("g").alias("f"), F.col("f").alias("g"))))
    both = products.select(F.explode(both).alias("x"), "v").select("x.*", "v")
    table = scratch.table(both.repartition("f").sortWithinPartitions("f"), "products")

    def product(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                f, g, v = (batch.column(k).to_numpy() for k in range(3))
                first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                out = np.add.reduceat(v[:, None] * x[g], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(f[first]), pa.array([r.tobytes() for r in out], pa.binary())], ["f", "v"])

        out = np.zeros((features, x.shape[1]))
        got = table.mapInArrow(run, "f long, v binary").toArrow()
        if got.num_rows:
            np.add.at(out, got["f"].to_numpy(), np.frombuffer(b"".join(got["v"].to_pylist()), "<f8").reshape(got.num_rows, -1))
        return out

    q = np.linalg.qr(np.random.default_rng(3).standard_normal((features, many)))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    scratch.drop(table)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, begin in _documents(batches, items.kind):
            found = _windows(items, words, begin)
            rows = pa.array([r for r, _, _ in found], pa.int64())
            names = pa.array([items.ids[k] for _, k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(rows), names, pa.array([c for _, _, c in found], pa.float64())], ["rid", "item", "cover"])

    return run


def windows(begin: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of windows that hold any item of up to `scale` words whole."""
    step, wide = scale // 2, scale * 3 // 2
    count = np.maximum(1, -(-(np.diff(begin) - (wide - step)) // step))  # the last reaches the document's end
    of = np.repeat(np.arange(len(count)), count)
    lo = begin[of] + (np.arange(len(of)) - (np.cumsum(count) - count)[of]) * step
    return of, lo, np.minimum(lo + wide, begin[of + 1])


def _windows(items: Items, words: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, item, cover) of the confirmed pairs of some documents, one for each pair."""
    f = items.feature[words]
    at = np.flatnonzero(f >= 0)
    if not len(at):
        return []
    f = f[at]
    # sums over any run of words are differences of these
    known = np.concatenate([[0], np.cumsum(words < items.none)])
    mass = np.concatenate([[0], np.cumsum(items.bound[f])])
    vectors = np.zeros((len(at) + 1, items.word_vectors.shape[1]))
    np.cumsum(items.word_vectors[f], axis=0, out=vectors[1:])
    place = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))])
    names = np.append(items.vocabulary, U(0))
    best: dict[tuple[int, int], float] = {}
    for scale in np.unique(items.scale).tolist():
        mine = np.flatnonzero(items.scale == scale)
        of, lo, hi = windows(begin, scale)
        a, b = place[lo], place[hi]
        some = np.flatnonzero((b > a) & (known[hi] - known[lo] >= items.need[mine].min()))
        of, lo, hi, a, b = of[some], lo[some], hi[some], a[some], b[some]
        heavy = mass[b] - mass[a] >= MASS * items.square[mine].min() * (1 - 1e-9)
        many = max(1, CELLS // len(mine))
        for k in range(0, len(of), many):
            part = slice(k, k + many)
            w = (vectors[b[part]] - vectors[a[part]]).astype(np.float32)
            size = np.sqrt(np.einsum("ij,ij->i", w, w))
            near = w @ items.latent[mine].T >= COSINE * np.maximum(size, 1e-6)[:, None]
            exact = np.flatnonzero(heavy[part])
            if len(exact):
                n = (b[part] - a[part])[exact]
                index = _runs(a[part][exact], n)
                near[exact] |= items.product(scale, len(n), np.repeat(np.arange(len(n)), n), f[index]) >= MASS * items.square[mine]
            x, y = np.nonzero(near)
            x += k
            for x_, m in zip(*_enough(items, words, lo, hi, x, mine[y]), strict=True):
                r = int(of[x_])
                if best.get((r, m), 0.0) < 1.0:
                    cover = items.confirm(m, names[words[lo[x_] : hi[x_]]])
                    if cover:
                        best[r, m] = max(best.get((r, m), 0.0), cover)
    return [(r, m, c) for (r, m), c in best.items()]


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _enough(items: Items, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, m: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the pairs of a window and an item (in order of windows), those with as many of the item's words in the window
    as its subsequence needs; the subsequence has no more words than that."""
    out: tuple[list[int], list[int]] = ([], [])
    some, of = np.unique(x, return_inverse=True)
    many = max(1, 2 * CELLS // (items.none + 1))
    for k in range(0, len(some), many):
        part = some[k : k + many]
        has = np.zeros((len(part), items.none + 1), bool)
        n = hi[part] - lo[part]
        has[np.repeat(np.arange(len(part)), n), words[_runs(lo[part], n)]] = True
        pairs = np.arange(*np.searchsorted(of, [k, k + len(part)]))
        for p in range(0, len(pairs), CELLS // 40):
            pair = pairs[p : p + CELLS // 40]
            # first an item's rarest words, a few more than may be missing; then all, for pairs that this leaves
            few = np.minimum(items.size, items.size - items.need + 3)
            for size in (few, items.size):
                item = m[pair]
                n = size[item]
                hits = has[np.repeat(of[pair] - k, n), items.number[_runs(items.start[item], n)]]
                missing = n - np.add.reduceat(hits.astype(np.int64), np.cumsum(n) - n) if len(n) else n
                pair = pair[missing <= (items.size - items.need)[item]]
            out[0].extend(x[pair].tolist())
            out[1].extend(m[pair].tolist())
    return out


def matches(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, body: str) -> DataFrame:
    """(rid, item, cover): the pairs of a document key and a benchmark item found in its text."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    slim = docs.select(F.col(key).cast("long").alias("rid"), F.lower(text).alias("text"))
    items = benchmark.where(F.col(body).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.lower(body).alias("body"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).orderBy("item", "body").collect()
        block = Items([r["item"] for r in rows], [r["body"] for r in rows])
        if not block.ids:
            continue
        coded = scratch.table(slim.mapInArrow(tidy(_coded(block)), CODED), "words")
        df = np.zeros(block.none)
        for r in coded.mapInArrow(tidy(_frequencies(block)), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
            df[r["f"]] = r["n"]
        block.weigh(df, max(1, coded.count()))
        sums = coded.mapInArrow(tidy(_products(block)), "f long, g long, v double").groupBy("f", "g").agg(F.sum("v").alias("v"))
        features = len(block.features)
        block.project(randomised_svd(sums, features, min(RANK, features // 4)))
        found = coded.mapInArrow(tidy(_search(block)), "rid long, item long, cover double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.range(0).select(F.col("id").alias("rid"), F.col("id").alias("item"), F.lit(0.0).alias("cover"))
    return out


def contaminated(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str = "item_id", body: str = "text") -> DataFrame:
    """(key, contaminated, n_items, item_id, cover) for every row: the items found in it, the smallest id of the best
    covered ones, and its cover.

    Null texts, empty texts, null items and items without words match nothing; with an empty benchmark every row is
    clean; rows that share a key share its items; a null key is never contaminated; an empty table gives no rows.
    """
    found = scratch.table(matches(docs, key, text, benchmark, item, body), "matches").distinct()
    best = found.groupBy("rid").agg(F.count_distinct("item").alias("n_items"), F.max(F.struct("cover", (-F.col("item")).alias("i"))).alias("b"))
    out = docs.select(F.col(key).cast("long").alias("_k")).join(best, F.col("_k") == F.col("rid"), "left")
    return out.select(F.col("_k").alias(key), F.col("rid").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("b.i")).alias("item_id"), F.coalesce("b.cover", F.lit(0.0)).alias("cover"))


def op2_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
