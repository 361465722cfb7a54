"""String similarity: common-subsequence ratios of strings, of sorted tokens and of token sets.

ratio(a, b) = 2 * LCS(a, b) / (len(a) + len(b)); 1 for two empty strings. The LCS of a batch of pairs is taken by
numpy, bit-parallel over the characters of one string of each pair and at once for all pairs; only pairs of two strings
of over 64 characters go through Python one by one. Everything around it is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

BITS = 64
MASKS = 1 << 22  # masks of characters that are held at once
PAIRS = 1 << 18  # pairs, or windows of pairs, that are compared at once
NEAR = 1 << 14  # pairs whose state stays in the cache of a core
TOGETHER = 1 << 17  # pairs of labels that are rated together
U = np.uint64


def lcs_length(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _points(strings: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, 0 where a string has ended; lengths). A NUL character counts as U+110000, which no string has."""
    size = np.array([len(s) for s in strings], np.int64)
    wide = max(1, int(size.max(initial=0)))
    points = np.zeros((len(strings), wide), np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(strings)), size)
    points[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.where(flat == 0, 0x110000, flat)
    return points, size


class _Pairs:
    """Pairs of strings of which the first has at most 64 characters; their characters as bit masks."""

    def __init__(self, a: list[str], b: list[str]):
        left: dict[str, int] = {}
        right: dict[str, int] = {}
        ia = np.array([left.setdefault(s, len(left)) for s in a], np.int64)
        ib = np.array([right.setdefault(s, len(right)) for s in b], np.int64)
        self._read(left, right, ia, ib)

    @classmethod
    def of(cls, left: Collection[str], right: Collection[str], ia: np.ndarray, ib: np.ndarray) -> _Pairs:
        """The pairs left[ia], right[ib]."""
        out = cls.__new__(cls)
        out._read(left, right, ia, ib)
        return out

    def _read(self, left: Collection[str], right: Collection[str], ia: np.ndarray, ib: np.ndarray) -> None:
        self.ia, self.ib = ia, ib
        x, self.na = _points(left)
        y, self.nb = _points(right)
        letters = np.unique(x)
        letters = letters[letters > 0]
        many = len(letters) + 1
        self.table = np.zeros((len(left), many), U)
        rows = np.arange(len(left))
        for k in range(x.shape[1]):
            on = x[:, k] > 0
            self.table[rows[on], np.searchsorted(letters, x[on, k])] |= U(1) << U(k)
        at = np.minimum(np.searchsorted(letters, y), max(0, len(letters) - 1))
        known = (letters[at] == y) if len(letters) else np.zeros(y.shape, bool)
        self.y = np.where(known, at, many - 1)  # the last mask is empty

    def lcs(self, pairs: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Of some pairs; with `start`, of the first string and the window of its length that starts there."""
        ia, ib = self.ia[pairs], self.ib[pairs]
        v = np.full(len(pairs), ~U(0))
        many = self.table.shape[1]
        masks, row = self.table.ravel(), ia * many
        wide = int(self.nb[ib].max(initial=0)) if start is None else int(self.na[ia].max(initial=0))
        turned = np.ascontiguousarray(self.y[:, :wide].T) if start is None else None
        for k in range(wide):
            if start is None:
                letter = turned[k].take(ib)
            else:
                at = start + k
                inside = (at >= 0) & (at < self.nb[ib]) & (k < self.na[ia])
                letter = np.where(inside, self.y[ib, np.clip(at, 0, self.y.shape[1] - 1)], many - 1)
            u = masks.take(row + letter)
            u &= v
            w = v + u
            v -= u
            v |= w
        n = self.na[ia].astype(U)
        full = np.where(n == U(BITS), ~U(0), (U(1) << np.minimum(n, U(BITS - 1))) - U(1))
        return np.bitwise_count(~v & full).astype(np.int64)


    def in_parts(self, name: str, pairs: np.ndarray) -> np.ndarray:
        """`lcs` or `edits` of some pairs, few at a time."""
        f = getattr(self, name)
        return np.concatenate([f(pairs[k : k + NEAR]) for k in range(0, len(pairs), NEAR)]) if len(pairs) else np.zeros(0, np.int64)

    def edits(self, pairs: np.ndarray) -> np.ndarray:
        """Levenshtein distances of some pairs."""
        ia, ib = self.ia[pairs], self.ib[pairs]
        na, nb = self.na[ia], self.nb[ib]
        many = self.table.shape[1]
        masks, row = self.table.ravel(), ia * many
        wide = int(nb.max(initial=0))
        turned = np.ascontiguousarray(self.y[:, :wide].T)
        up, down = np.full(len(pairs), ~U(0)), np.zeros(len(pairs), U)
        last = np.maximum(na - 1, 0).astype(U)
        out = na.copy()
        for k in range(wide):
            same = masks.take(row + turned[k].take(ib))
            across = (((same & up) + up) ^ up) | same
            more, less = down | ~(across | up), up & across
            step = ((more >> last) & U(1)).astype(np.int64) - ((less >> last) & U(1)).astype(np.int64)
            out += np.where(k < nb, step, 0)
            more, less = (more << U(1)) | U(1), less << U(1)
            known = same | down
            up, down = less | ~(known | more), more & known
        return np.where(na == 0, nb, out)


def edit_distances(left: Sequence[str], right: Sequence[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs left[ia], right[ib]."""
    out = np.zeros(len(ia), np.int64)
    long = np.array([len(x) > BITS for x in left], bool)[ia]
    at = np.flatnonzero(~long)
    for k in range(0, len(at), PAIRS):
        some = at[k : k + PAIRS]
        (a, x), (b, y) = _renumbered(ia[some], len(left)), _renumbered(ib[some], len(right))
        out[some] = _Pairs.of([left[i] for i in a], [right[i] for i in b], x, y).in_parts("edits", np.arange(len(some)))
    for k in np.flatnonzero(long):
        out[k] = _edits(left[ia[k]], right[ib[k]])
    return out


def _renumbered(x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different numbers below `many` in x, x by their places)."""
    on = np.zeros(many, bool)
    on[x] = True
    return np.flatnonzero(on), (np.cumsum(on) - 1)[x]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def _parts(a: list[str], b: list[str]):
    """(places, _Pairs) with few masks each, for pairs whose first string is short."""
    size = min(PAIRS, MASKS // 256)
    for k in range(0, len(a), size):
        yield np.arange(k, min(len(a), k + size)), _Pairs(a[k : k + size], b[k : k + size])


def ratios(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    a, b = [x or "" for x in a], [x or "" for x in b]
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    both = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short = np.array([len(x) <= BITS for x, _ in both], bool)
    lcs = np.zeros(len(a))
    at = np.flatnonzero(short)
    for k, pairs in _parts([both[i][0] for i in at], [both[i][1] for i in at]):
        lcs[at[k]] = pairs.lcs(np.arange(len(k)))
    for i in np.flatnonzero(~short):
        lcs[i] = lcs_length(*both[i])
    return np.where(size > 0, 2 * lcs / np.maximum(size, 1), 1.0)


def partial_ratios(a: Sequence[str | None], b: Sequence[str | None], lcs: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """The best ratio of the shorter string with a window of its length (at the edges, shorter) of the longer. Given the
    `lcs` of the pairs, windows are left out that can't reach `least` by it, so only results from there on are exact."""
    both = [(x, y) if len(x) <= len(y) else (y, x) for x, y in ((x or "", y or "") for x, y in zip(a, b, strict=True))]
    out = np.zeros(len(both))
    short = np.array([0 < len(x) <= BITS for x, _ in both], bool)
    at = np.flatnonzero(short)
    for k, pairs in _parts([both[i][0] for i in at], [both[i][1] for i in at]):
        n, m = pairs.na[pairs.ia], pairs.nb[pairs.ib]
        many = n + m - 1
        done = np.cumsum(many)
        lo = 0
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
            some = np.arange(lo, hi)
            first = np.cumsum(many[some]) - many[some]
            of = np.repeat(some, many[some])
            start = 1 - n[of] + np.arange(len(of)) - np.repeat(first, many[some])
            width = np.minimum(start + n[of], m[of]) - np.maximum(start, 0)
            if lcs is None:
                out[at[k[some]]] = np.maximum.reduceat(2 * pairs.lcs(of, start) / (n[of] + width), first)
            else:
                able = np.flatnonzero(2 * np.minimum(width, lcs[at[k]][of]) / (n[of] + width) >= least - 1e-9)
                best = np.zeros(len(of))
                best[able] = 2 * pairs.lcs(of[able], start[able]) / (n[of[able]] + width[able])
                out[at[k[some]]] = np.maximum.reduceat(best, first)
            lo = hi
    for i in np.flatnonzero(~short):
        x, y = both[i]
        n = len(x)
        windows = (y[max(0, s) : s + n] for s in range(1 - n, len(y)))
        out[i] = max(2 * lcs_length(x, w) / (n + len(w)) for w in windows) if n else float(not y)
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ratio of the shorter string with a window of its length (at the edges, shorter) of the longer."""
    return pd.Series(partial_ratios(a.tolist(), b.tolist()), dtype="float64")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    both = [F.array_join(F.array_sort(tokens(x)), " ") for x in (a, b)]
    return ratio(*both)


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the common tokens and the common tokens with either rest; 1 if one set holds the other."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    common = F.array_sort(F.array_intersect(x, y))
    left, right = F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x))
    base = F.array_join(common, " ")
    one, two = F.array_join(F.concat(common, left), " "), F.array_join(F.concat(common, right), " ")
    best = F.when(F.size(common) > 0, F.greatest(ratio(base, one), ratio(base, two), ratio(one, two))).otherwise(ratio(one, two))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    inside = (F.size(common) > 0) & ((F.size(left) == 0) | (F.size(right) == 0))
    return F.when(empty, 0.0).when(inside, 1.0).otherwise(best)


def _words(s: str) -> list[str]:
    return [t for t in re.split(r"[ \t\n\x0b\f\r]+", s) if t]


@lru_cache(1 << 17)
def _forms(s: str) -> tuple[str, str, str, str, str]:
    """In lower case; words in order, of both cases; different words in order, of both cases."""
    low = s.lower()
    a, b = _words(low), _words(s)
    return low, " ".join(sorted(a)), " ".join(sorted(b)), " ".join(sorted(set(a))), " ".join(sorted(set(b)))


def _set_parts(a: str, b: str) -> tuple[float, str, str]:
    """(a known lower bound of the token-set ratio of strings that share words, two strings whose ratio may be larger)."""
    x, y = set(_words(a)), set(_words(b))
    common = x & y
    if len(common) == len(x) or len(common) == len(y):
        return 1.0, "", ""
    base = " ".join(sorted(common))
    one, two = (" ".join([base, *sorted(z - common)]) for z in (x, y))
    # the common tokens begin both strings
    return 2 * len(base) / (len(base) + min(len(one), len(two))), one, two


class _Strings:
    """Strings by number, each once."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def add(self, strings: Sequence[str]) -> np.ndarray:
        return np.array([self.at.setdefault(s, len(self.at)) for s in strings], np.int64)


def _numbered_ratios(left: _Strings, right: _Strings, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """`ratios` of numbered strings."""
    a, b = list(left.at), list(right.at)
    if not len(ia):
        return np.zeros(0)
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.ones(len(ia))
    if na.max() <= BITS and len(a) * 256 <= MASKS:
        pairs = _Pairs.of(a, b, ia, ib)
        size = na[ia] + nb[ib]
        for k in range(0, len(ia), PAIRS):
            some = np.arange(k, min(len(ia), k + PAIRS))
            out[some] = 2 * pairs.in_parts("lcs", some) / np.maximum(size[some], 1)
        out[size == 0] = 1.0
        return out
    return ratios([a[i] for i in ia], [b[i] for i in ib])


def _split(number: _Strings, strings: list[str]) -> list[np.ndarray]:
    """The numbers of the words of each string."""
    words = [s.split(" ") if s else [] for s in strings]
    return np.split(number.add([w for ws in words for w in ws]), np.cumsum([len(ws) for ws in words])[:-1]) if words else []


def _share_words(a: list[str], b: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Whether strings of different words in order (a blank between) have a word in common."""
    number = _Strings()
    x, y = (_split(number, z) for z in (a, b))
    wide = [max(map(len, z), default=0) for z in (x, y)]
    if wide[0] * wide[1] > 64:
        sets = [[frozenset(w.tolist()) for w in z] for z in (x, y)]
        return np.array([not sets[0][i].isdisjoint(sets[1][j]) for i, j in zip(ia.tolist(), ib.tolist(), strict=True)], bool)
    out = np.zeros(len(ia), bool)
    columns = []
    for z, many, none in ((x, wide[0], -1), (y, wide[1], -2)):
        m = np.full((many, len(z)), none, np.int64)
        for i, w in enumerate(z):
            m[: len(w), i] = w
        columns.append(m)
    for p in columns[0]:
        for q in columns[1]:
            out |= p.take(ia) == q.take(ib)
    return out


def label_similarities(mention: Sequence[str], label: Sequence[str], factor: Sequence[float], sure: float) -> tuple[np.ndarray, np.ndarray]:
    """`numbered_similarities` of pairs as they are."""
    own, other = _Strings(), _Strings()
    im, ix = own.add(mention), other.add(label)
    return numbered_similarities(list(own.at), list(other.at), im, ix, factor, sure)


def numbered_similarities(ms: list[str], xs: list[str], im: np.ndarray, ix: np.ndarray, factor: Sequence[float], sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, partial) of the pairs ms[im], xs[ix] of a mention and a label; each string is given once. The ratio is the
    mean of the best two of the character, token sort and (for like lengths) token set ratios, nine tenths in lower case
    and one tenth as they are, times `factor`. `partial` is only looked for where the ratio is below `sure`: most of the
    shorter string in one stretch of the other, or all tokens of one in the other."""
    own, other = _Strings(), _Strings()
    own.add(ms)
    other.add(xs)
    m_forms, x_forms = [_forms(m) for m in ms], [_forms(x) for x in xs]
    # all strings that are compared, numbered: as they are, lower, in order (both cases), different words (both cases)
    of_m = [np.arange(len(ms)), *(own.add([f[k] for f in m_forms]) for k in range(5))]
    of_x = [np.arange(len(xs)), *(other.add([f[k] for f in x_forms]) for k in range(5))]
    raw, low, low_sorted, raw_sorted, low_set, raw_set = ((p[im], q[ix]) for p, q in zip(of_m, of_x, strict=True))
    m_size, x_size = (np.array([len(s) for s in z], np.int64) for z in (ms, xs))
    far = m_size[im] / np.maximum(1, x_size[ix])
    near = (0.5 < far) & (far < 2)
    filled = [(np.array([bool(f[k]) for f in m_forms], bool)[im] & np.array([bool(f[k]) for f in x_forms], bool)[ix]) for k in (3, 4)]
    shared = [near & full & _share_words([f[k] for f in m_forms], [f[k] for f in x_forms], im, ix) for k, full in zip((3, 4), filled, strict=True)]
    # a pair of strings is compared once, also where it has several of the roles
    names = [low, raw, low_sorted, raw_sorted, low_set, raw_set]
    wanted = [np.ones(len(im), bool)] * 4 + [near & full & ~some for full, some in zip(filled, shared, strict=True)]
    value = np.zeros((6, len(im)))
    todo = []
    for k, (a, b) in enumerate(names):
        open_ = wanted[k].copy()
        for j in range(k):
            open_ &= ~(wanted[j] & (names[j][0] == a) & (names[j][1] == b))
        todo.append(np.flatnonzero(open_))
    found = _numbered_ratios(own, other, np.concatenate([names[k][0][at] for k, at in enumerate(todo)]), np.concatenate([names[k][1][at] for k, at in enumerate(todo)]))
    done = 0
    for k, (a, b) in enumerate(names):
        open_ = wanted[k].copy()
        value[k, todo[k]] = found[done : done + len(todo[k])]
        done += len(todo[k])
        open_[todo[k]] = False
        for j in range(k):
            same = open_ & wanted[j] & (names[j][0] == a) & (names[j][1] == b)
            value[k, same] = value[j, same]
            open_ &= ~same
    for k, some in enumerate(shared):
        at = np.flatnonzero(some)
        parts = [_set_parts(*((m.lower(), x.lower()) if k == 0 else (m, x))) for m, x in ((ms[im[i]], xs[ix[i]]) for i in at)]
        if parts:
            known, one, two = zip(*parts, strict=True)
            value[4 + k, at] = np.maximum(known, np.where(np.array(one) == "", 0.0, ratios(one, two)))
    character, by_sort, by_set = (0.9 * value[k] + 0.1 * value[k + 1] for k in (0, 2, 4))
    all_ = np.stack([character, by_sort, by_set])
    ratio_ = (all_.sum(axis=0) - all_.min(axis=0)) / 2 * np.asarray(factor, float)
    partial = near & (by_set > 0.9)
    # a stretch that is over 0.9 alike has at least 0.8 of the shorter string in order
    m_low, x_low = (np.array([len(f[0]) for f in z], float) for z in (m_forms, x_forms))
    short, both = np.minimum(m_low[im], x_low[ix]), m_low[im] + x_low[ix]
    m_blanks, x_blanks = (np.array([s.count(" ") for s in z], np.int64) for z in (ms, xs))
    at = np.flatnonzero(~partial & (ratio_ < sure) & (np.abs(m_blanks[im] - x_blanks[ix]) <= 2) & (value[0] * both / 2 >= 0.8 * short - 1e-9))
    # nothing as it is makes up for a stretch in lower case of less than 8 / 9
    stretch = partial_ratios([m_forms[i][0] for i in im[at]], [x_forms[i][0] for i in ix[at]], np.round(value[0, at] * both[at] / 2), 8 / 9)
    at, stretch = at[stretch >= 8 / 9 - 1e-9], stretch[stretch >= 8 / 9 - 1e-9]
    as_is = stretch.copy()
    cased = np.flatnonzero((raw[0][at] != low[0][at]) | (raw[1][at] != low[1][at]))
    as_is[cased] = partial_ratios([ms[i] for i in im[at[cased]]], [xs[i] for i in ix[at[cased]]])
    partial[at] = 0.9 * stretch + 0.1 * as_is > 0.9
    return ratio_, partial & (ratio_ < sure)


class Bounds:
    """Upper bounds of the ratios of `numbered_similarities`, by the letters that two strings have in common."""

    def __init__(self, ms: list[str], xs: list[str]):
        lows = [[s.lower() for s in z] for z in (ms, xs)]
        words = [[_words(s) for s in z] for z in lows]
        self.size = [np.array([len(s) for s in z], np.int64) for z in lows]
        self.letters = [self._letters(z) for z in lows]
        # words in order have the same letters as the string if it has nothing but them and single blanks
        self.plain = [np.array([" ".join(w) == s for w, s in zip(y, z, strict=True)], bool) for y, z in zip(words, lows, strict=True)]
        self.single = [np.array([len(w) == 1 for w in z], bool) for z in words]

    @staticmethod
    def _letters(strings: list[str]) -> np.ndarray:
        """How many letters of each string are in each of 32 groups of letters."""
        out = np.zeros((len(strings), 32), np.uint16)
        points, size = _points([s[:60000] for s in strings])
        for k in range(points.shape[1]):
            on = np.flatnonzero(size > k)
            out[on, points[on, k] % 32] += 1
        return out

    def of(self, im: np.ndarray, ix: np.ndarray, factor: np.ndarray) -> np.ndarray:
        out = np.ones(len(im))
        for k in range(0, len(im), PAIRS):
            a, b = im[k : k + PAIRS], ix[k : k + PAIRS]
            common = np.minimum(self.letters[0].take(a, 0), self.letters[1].take(b, 0)).sum(axis=1, dtype=np.int64)
            size = self.size[0][a] + self.size[1][b]
            most = np.minimum(1.0, 0.9 * 2 * common / np.maximum(size, 1) + 0.1)
            # of several words the set may be alike
            most = np.where(self.single[0][a] & self.single[1][b], most, (most + 1) / 2)
            out[k : k + PAIRS] = np.where(self.plain[0][a] & self.plain[1][b] & (size < 60000), most, 1.0)
        return out * factor + 1e-9


class Tries:
    """Longest common subsequences of one string with very many: strings of one length that begin alike are gone through
    together, bit-parallel, as nodes of a trie."""

    LEAST = 64  # strings of a length that get a trie

    def __init__(self, xs: list[str]):
        size = np.array([len(x) for x in xs], np.int64)
        self.n, self.nodes, self.tries = len(xs), 0, []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n == 0 or len(rows) < self.LEAST:
                continue
            points = np.frombuffer("".join(xs[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
            by = np.lexsort(points.T[::-1])
            rows, points = rows[by], points[by]
            own, codes = np.unique(points, return_inverse=True)
            codes = codes.reshape(points.shape)
            starts, before, levels = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), []
            starts[0] = True
            for k in range(n):
                starts[1:] |= points[1:, k] != points[:-1, k]
                first = np.flatnonzero(starts)
                levels.append((before[first] if k else np.zeros(len(first), np.int64), codes[first, k]))
                before = np.cumsum(starts) - 1
                self.nodes += len(first)
            self.tries.append((rows, {int(x): i for i, x in enumerate(own)}, levels, before))

    def lcs(self, s: str) -> np.ndarray:
        """Of `s`, of 1 to 64 characters, with each string; -1 where that is not known."""
        out = np.full(self.n, -1, np.int64)
        for rows, codes, levels, last in self.tries:
            masks = np.zeros(len(codes), np.uint64)
            for i, x in enumerate(s):
                if ord(x) in codes:
                    masks[codes[ord(x)]] |= np.uint64(1 << i)
            v = np.full(1, (1 << 64) - 1, np.uint64)
            for parent, code in levels:
                if len(parent) != len(v) or len(v) == 1:
                    v = v[parent]
                u = v & masks[code]
                v = (v + u) | (v - u)
            out[rows] = np.bitwise_count(~v & np.uint64((1 << len(s)) - 1))[last]
        return out


def with_label_similarity(df: DataFrame, sure: float) -> DataFrame:
    """`df`, which has mention, label and factor, with the ratio and partial of `label_similarities`. Rows are taken
    together over Arrow batches, so that a string which many of them hold is read once."""

    def rate(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        m, x = (pc.dictionary_encode(t[c].combine_chunks()) for c in ("mention", "label"))
        m, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (m, x))
        a, b = numbered_similarities(m.dictionary.to_pylist(), x.dictionary.to_pylist(), m.indices.to_numpy().astype(np.int64), x.indices.to_numpy().astype(np.int64), t["factor"].to_numpy(), sure)
        yield from t.append_column("ratio", pa.array(a)).append_column("partial", pa.array(b)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield from rate(held)
                held, rows = [], 0
        if rows:
            yield from rate(held)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("ratio", DoubleType()), StructField("partial", BooleanType())]))


def best_two(a: Column, b: Column, c: Column) -> Column:
    """The mean of the two largest."""
    return (a + b + c - F.least(a, b, c)) / 2


def textual_similarity(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return best_two(ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def normalise_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.replace(c, F.lit('"'), F.lit(""))), r"\s+", " "))
