"""Quality classifier: document evidence and site posteriors under a hierarchical empirical Bayes model.

A document's evidence is the log-odds of a logistic model (one for `quality`, one for `toxic`) over statistics of the
whole text and the presence of telling words, fitted on a bounded sample of labelled rows. Sites are two levels, paths
within hosts; their means are sums of the evidence over all documents, grouped by site. Three variances are estimated
by moments: between documents of a path, between paths of a host, and between hosts. A host's mean is the average of
its paths, each weighted by what its variance allows, shrunk toward the global mean; a path's is shrunk toward its
host's. So a site with few documents keeps its parent's rate, and a host of one path counts its documents once.

A document's posterior log-odds is its own evidence plus what its site's rate, taken without this document, differs
from the global one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowtext import LOWER, U, buffers, mix, prefix_hash, slices, span_hash, word_hashes, tidy
from .arrowtext import words as spans

SAMPLE = 4_000  # labelled rows used to fit, chosen by a hash of the key
BITS = 20  # buckets of word hashes
TELLING = 384  # word buckets that a model uses
TARGETS = ("quality", "toxic")
STEP = 500_000

_KINDS = np.zeros((256, 6), np.float32)  # upper, lower, digit, stop or comma, other ASCII sign, past ASCII
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = 1
_KINDS[[44, 46, 59, 58, 39], 3] = 1
for _c in range(33, 127):
    if not _KINDS[_c].any():
        _KINDS[_c, 4] = 1
_KINDS[128:, 5] = 1
N_STATS = 12
_LETTER = (_KINDS[:, 0] + _KINDS[:, 1] + _KINDS[:, 5]) > 0
PREFIXES = (4, 6, 8)  # bytes of a word's beginning


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics by row, bucket, row): the bucket of every word and of its beginnings, repeats included."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    stats = np.zeros((rows, N_STATS))
    kinds = np.zeros((rows, 6))
    full = np.flatnonzero(size)
    if len(full):
        for k in range(6):
            kinds[full, k] = np.add.reduceat(_KINDS[:, k][raw], offsets[full], dtype=np.float64)
    ink = np.maximum(1, kinds.sum(axis=1))
    stats[:, :6] = kinds / ink[:, None]
    h, row, start, end = word_hashes(raw, offsets)
    words = np.bincount(row, minlength=rows)
    many = np.maximum(1, words)
    stats[:, 6] = np.log1p(words)
    stats[:, 7] = np.minimum(30, np.bincount(row, end - start, rows) / many) / 10
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    stats[:, 8] = np.bincount(row[again], minlength=rows) / many
    sign = np.zeros(len(h), bool)
    if len(h):
        sign = _KINDS[raw[end - 1], 4] > 0
    stats[:, 9] = np.bincount(row[sign], minlength=rows) / many
    key = (row.astype(U) << U(BITS)) | (h >> U(64 - BITS))
    key = np.unique(key)
    at = (key >> U(BITS)).astype(np.int64)
    distinct = np.bincount(at, minlength=rows)
    stats[:, 10] = distinct / many
    stats[:, 11] = np.log1p(distinct) / np.maximum(1e-9, np.log1p(many))
    # words without their signs: runs of letters, so that "idiot." and "idiot###" are one word; and their beginnings,
    # so that forms of a word not seen in training are still known
    bare = LOWER[raw]
    bare[~_LETTER[raw]] = 32
    start, end, row = spans(bare, offsets)
    prefix = prefix_hash(bare)
    parts = [(mix(span_hash(prefix, start, end)), row)]
    for k in PREFIXES:
        long = end - start > k
        parts.append((mix(span_hash(prefix, start[long], start[long] + k) + U(k)), row[long]))
    return stats, (np.concatenate([h for h, _ in parts]) >> U(64 - BITS)).astype(np.int64), np.concatenate([r for _, r in parts])


def families(bucket: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(family, weight) of each row: rows with the same two smallest hashes of words are taken for copies, and the
    rows of a family weigh as much as one."""
    low = np.zeros((rows, 2), U)
    have, first = np.unique(row, return_index=True)
    for k in range(2):
        if len(have):
            low[have, k] = np.minimum.reduceat(mix(bucket.astype(U) + U(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)), first)
    _, family, size = np.unique(low, axis=0, return_inverse=True, return_counts=True)
    family = family.reshape(-1)
    return family, 1 / size[family]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on the weighted, ridge-penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (weight * np.maximum(1e-6, p * (1 - p)))) @ x + np.diag(penalty), g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Log-odds of one target from statistics and telling words."""

    def __init__(self, stats: np.ndarray, bucket: np.ndarray, row: np.ndarray, count: np.ndarray, y: np.ndarray):
        self.mean, self.std = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        family, weight = families(bucket, row, len(stats))
        # a word counts once for a family of copies, so that the words of one copied text are not telling
        seen = np.unique(bucket.astype(np.int64) * len(stats) + family[row])
        of = seen % len(stats)
        mean = np.bincount(family, y, len(stats)) / np.maximum(1, np.bincount(family, minlength=len(stats)))
        pos = np.bincount(seen // len(stats), mean[of], 1 << BITS)
        all_ = np.bincount(seen // len(stats), minlength=1 << BITS).astype(float)
        rate = y.mean()
        z = (pos - all_ * rate) ** 2 / np.maximum(1e-9, all_ * rate * (1 - rate))
        z[all_ < 5] = 0
        best = np.argsort(-z, kind="stable")[:TELLING]
        self.words = np.sort(best[z[best] > 20])
        if 0 < rate < 1:
            self.w = _logistic(self._inputs(stats, bucket, row, count), y, weight)
        else:  # one class only: its own log-odds, with half a row of the other
            self.w = np.zeros(N_STATS + len(self.words) + 1)
            self.w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def _places(self) -> np.ndarray:
        if getattr(self, "_table", None) is None:
            self._table = np.full(1 << BITS, -1, np.int16)
            self._table[self.words] = np.arange(len(self.words))
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def _inputs(self, stats, bucket, row, count):
        x = np.zeros((len(stats), N_STATS + len(self.words)))
        x[:, :N_STATS] = np.clip((stats - self.mean) / self.std, -8, 8)
        if len(self.words):
            at = self._places()[bucket]
            hit = np.flatnonzero(at >= 0)
            np.add.at(x, (row[hit], N_STATS + at[hit]), count[hit] if len(count) else 1)
            x[:, N_STATS:] = np.minimum(3, np.log2(1 + x[:, N_STATS:]))
        return x

    def log_odds(self, stats, bucket, row):
        """Of rows whose buckets come with their repeats."""
        return np.clip(self._inputs(stats, bucket, row, ()) @ self.w[:-1] + self.w[-1], -30, 30)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets, _ = buffers(batch.column(0))
        stats, bucket, row = features(raw, offsets)
        key, count = np.unique(row.astype(np.int64) << BITS | bucket, return_counts=True)
        bucket, row = key & ((1 << BITS) - 1), key >> BITS
        ends = np.searchsorted(row, np.arange(len(offsets)))
        b, c = bucket.astype("<u4").tobytes(), np.minimum(255, count).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([x.tobytes() for x in stats.astype("<f8")], pa.binary()), pa.array([b[4 * i : 4 * j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array([c[i:j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())],
            ["quality", "toxic", "stats", "words", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int = SAMPLE) -> dict[str, Model]:
    """Models of the targets that have labels, from at most about `sample` labelled rows (a bounded driver table)."""
    n = max(1, labels.count())
    chosen = labels.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(min(1.0, sample / n) * 1_000_003))).select(F.col(key).alias("_key"), *(F.col(t).cast("int").alias(t) for t in TARGETS))
    chosen = chosen.groupBy("_key").agg(*(F.max(t).alias(t) for t in TARGETS))
    # the sample is bounded by its parameter, so it can be sent to every task
    rows = docs.join(F.broadcast(chosen), docs[key] == chosen["_key"]).select(docs[text].alias("text"), *TARGETS).mapInArrow(tidy(_sampled), "quality int, toxic int, stats binary, words binary, counts binary").toArrow()
    n = rows.num_rows
    if not n:
        return {}
    flat = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind)
    stats, bucket, count = flat("stats", "<f8").reshape(n, N_STATS), flat("words", "<u4"), flat("counts", np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) // 4 for x in rows["words"].to_pylist()])
    out = {}
    for t in TARGETS:
        y = np.array([-1 if v is None else v for v in rows[t].to_pylist()])
        use = y >= 0
        if use.all():
            out[t] = Model(stats, bucket, row, count, (y > 0).astype(float))
        elif use.any():
            new = (np.cumsum(use) - 1).astype(np.int32)
            mine = use[row]
            out[t] = Model(stats[use], bucket[mine], new[row[mine]], count[mine], (y[use] > 0).astype(float))
    return out


def evidence(docs: DataFrame, text: str, models: dict[str, Model]) -> DataFrame:
    """`docs` without its text, with _e_quality and _e_toxic (log-odds; 0 without a model)."""
    fields = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = buffers(batch.column(len(fields)))
            odds = {t: np.zeros(len(offsets) - 1) for t in TARGETS}
            for i, j in slices(offsets, STEP):
                f = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for t, m in models.items():
                    odds[t][i:j] = m.log_odds(*f)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(odds[t]) for t in TARGETS)], [*fields, *(f"_e_{t}" for t in TARGETS)])

    schema = docs.select(*fields).schema
    for t in TARGETS:
        schema = schema.add(f"_e_{t}", "double")
    return docs.select(*fields, text).mapInArrow(tidy(run), schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


class Spread:
    """Variances of one target's evidence: `inner` between documents of a path, `path` between paths of a host, `host`
    between hosts; `mean` of all. By moments, from sums over sites."""

    def __init__(self, n: float, paths: int, hosts: int, sum_: float, squares: float, by_path: float, by_host: float, path_share: float, path_squares: float, host_squares: float):
        """`squares`: of all documents; `by_path`, `by_host`: squared sums of sites over their sizes; `path_share`:
        squared sizes of paths over those of their hosts; `path_squares`, `host_squares`: squared sizes of sites."""
        self.mean = min(1 - 1e-4, max(1e-4, sum_ / n))
        inner = (squares - by_path) / (n - paths) if n > paths else self.mean * (1 - self.mean)
        self.inner = max(1e-6, inner)
        room = n - path_share
        self.path = max(0.0, (by_path - by_host - (paths - hosts) * self.inner) / room) if room > 1e-9 * n else 0.0
        room = n - host_squares / n
        noise = (hosts - 1) * self.inner + self.path * (path_share - path_squares / n)
        self.host = max(0.0, (by_host - sum_ * sum_ / n - noise) / room) if room > 1e-9 * n else 0.0

    def weight(self, n: Column) -> Column:
        """Of a path with n documents in its host's mean."""
        return F.when(n > 0, 1 / (self.path + self.inner / n)).otherwise(0.0)

    def rate(self, n: Column, s: Column, a: Column, w: Column) -> Column:
        """The posterior mean of a path of n documents with sum s, in a host whose paths' weighted means add up to a
        and whose weights to w."""
        host = F.when(w > 0, self.mean + (a / w - self.mean) * (self.host / (self.host + 1 / w))).otherwise(self.mean)
        return F.when(n > 0, host + (s / n - host) * (self.path / (self.path + self.inner / n))).otherwise(host)


def _sites(scored: DataFrame) -> tuple[DataFrame, dict[str, Spread]]:
    """(_host, _path, _n and for each target its sum, and its host's weighted means and weights), one row a site; the
    spreads of the targets. A site's own row is all that a document needs of it."""
    p = {t: _probability(t) for t in TARGETS}
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("_n"), *(F.sum(p[t]).alias(f"_s_{t}") for t in TARGETS), *(F.sum(p[t] * p[t]).alias(f"_q_{t}") for t in TARGETS))
    paths = scratch.table(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n")).alias("n2"), *(F.sum(f"_s_{t}").alias(f"s_{t}") for t in TARGETS))
    of_paths = paths.agg(F.sum("_n").alias("n"), F.count("*").alias("paths"), F.sum(F.col("_n") * F.col("_n").cast("double")).alias("path_squares"), *(F.sum(f"_s_{t}").alias(f"sum_{t}") for t in TARGETS), *(F.sum(f"_q_{t}").alias(f"squares_{t}") for t in TARGETS), *(F.sum(F.pow(f"_s_{t}", F.lit(2.0)) / F.col("_n")).alias(f"by_path_{t}") for t in TARGETS)).first()
    of_hosts = hosts.agg(F.count("*").alias("hosts"), F.sum(F.col("n2") / F.col("n")).alias("path_share"), F.sum(F.col("n") * F.col("n").cast("double")).alias("host_squares"), *(F.sum(F.pow(f"s_{t}", F.lit(2.0)) / F.col("n")).alias(f"by_host_{t}") for t in TARGETS)).first()
    spreads = {}
    for t in TARGETS:
        if of_paths["n"]:
            spreads[t] = Spread(of_paths["n"], of_paths["paths"], of_hosts["hosts"], of_paths[f"sum_{t}"], of_paths[f"squares_{t}"], of_paths[f"by_path_{t}"], of_hosts[f"by_host_{t}"], of_hosts["path_share"], of_paths["path_squares"], of_hosts["host_squares"])
        else:
            spreads[t] = Spread(1, 1, 1, 0.5, 0.25, 0.25, 0.25, 1, 1, 1)
    weigh = {t: spreads[t].weight(F.col("_n")) for t in TARGETS}
    sums = [F.sum(F.col(f"_s_{t}") / F.col("_n") * weigh[t]).alias(f"_a_{t}") for t in TARGETS] + [F.sum(weigh[t]).alias(f"_w_{t}") for t in TARGETS]
    whole = paths.groupBy("_host").agg(*sums)
    return paths.select("_host", "_path", "_n", *(f"_s_{t}" for t in TARGETS)).join(whole, "_host"), spreads


def _probability(t: str) -> Column:
    return 1 / (1 + F.exp(-F.col(f"_e_{t}")))


def _shift(t: str, spread: Spread) -> Column:
    """What the site of a row adds to its log-odds: the site's posterior rate without the row, against the mean."""
    n, s, p = F.col("_n"), F.col(f"_s_{t}"), _probability(t)
    rest, rest_s = n - 1, F.greatest(F.lit(0.0), s - p)
    a = F.col(f"_a_{t}") - s / n * spread.weight(n) + F.when(rest > 0, rest_s / rest * spread.weight(rest)).otherwise(0.0)
    w = F.col(f"_w_{t}") - spread.weight(n) + spread.weight(rest)
    # a host of this row alone: what is left of its weights is rounding
    alone = w < spread.weight(F.lit(1.0)) / 2
    rate = spread.rate(rest, rest_s, F.when(alone, 0.0).otherwise(a), F.when(alone, 0.0).otherwise(w))
    inside = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), rate))
    # a site moves a document by at most two units, so it cannot overrule clear evidence
    return F.greatest(F.lit(-2.0), F.least(F.lit(2.0), _logit(inside) - _logit(F.lit(spread.mean))))


def shifted(scored: DataFrame) -> DataFrame:
    """`scored` with _shift_quality and _shift_toxic."""
    sites, spreads = _sites(scored)
    # a site has one row; written first, so that the planner can split the rows of a host with a third of all documents
    joined = scored.join(scratch.table(sites, "sites"), ["_host", "_path"])
    return joined.select(*scored.columns, *(_shift(t, spreads[t]).alias(f"_shift_{t}") for t in TARGETS))


def classify(docs: DataFrame, labels: DataFrame, key: str, text: str, site: str, sample: int = SAMPLE) -> DataFrame:
    """(key, p_quality, p_toxic, kept) for every row; kept unless p_quality < 0.5 or p_toxic > 0.5.

    `site` is a URL or a name: its host is what precedes the first slash (after any scheme), its path the segment
    after it. A null site is a site of its own. Null and empty texts have the evidence of empty statistics. A target
    without labels has p 0.5 throughout and rejects nothing. Repeated rows are scored alike; an empty table gives
    no rows; a labelled key found twice counts as labelled 1 if any of its labels is.
    """
    scratch.small_batches(docs.sparkSession)
    models = fit(docs, labels, key, text, sample)
    bare = F.regexp_replace(F.coalesce(F.col(site).cast("string"), F.lit("")), "^[a-z]+://", "")
    named = docs.select(F.col(key), F.substring_index(bare, "/", 1).alias("_host"), F.substring_index(F.substring_index(bare, "/", 2), "?", 1).alias("_path"), F.col(text))
    scored = scratch.table(evidence(named, text, models), "evidence")
    joined = shifted(scored)
    p = {t: 1 / (1 + F.exp(-(F.col(f"_e_{t}") + F.col(f"_shift_{t}")))) for t in TARGETS}
    if "quality" not in models:
        p["quality"] = F.lit(0.5)
    if "toxic" not in models:
        p["toxic"] = F.lit(0.5)
    return joined.select(key, p["quality"].alias("p_quality"), p["toxic"].alias("p_toxic"), ((p["quality"] >= 0.5) & (p["toxic"] <= 0.5)).alias("kept"))


def op8_site_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, "doc_id", "text", "source")
