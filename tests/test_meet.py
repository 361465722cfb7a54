"""Where mentions and labels meet, without a session."""

import numpy as np
import pyarrow as pa

from gridsense.functions import similarity
from gridsense.model import LookupConfig
from gridsense.operators import meet

ROW = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.float64()), ("s", pa.string()), ("o", pa.string())])


def _cell(numbers, asked):
    """Labels `Supplier n` and `n`, of which the first have a common token; the names of a third class hold no number."""
    rows = [(0, meet.FORM, 3 * n + k, None, 1.0, s, o) for n in numbers for k, (s, o) in enumerate(((f"Supplier {n:04}", "LABEL"), (f"{n:04}", "SUB_ALIAS")))]
    rows += [(0, meet.POSTING, -1, 3 * n, 0.1, None, None) for n in numbers] + [(0, meet.POSTING, n, 3 * n + k, 5.0, None, None) for n in numbers for k in (0, 1)]
    rows += [(0, meet.MEMBER, 3 * n + k, n, 0.0, None, None) for n in numbers for k in (0, 1)]
    for m in asked:
        near = [n for n in numbers if sum(x != y for x, y in zip(f"{n:04}", f"{m:04}", strict=True)) <= 1]
        rows += [(0, meet.MENTION, m, None, None, f"supplier {m:04}", None), (0, meet.KEY, m, -1, 1.0, None, None)]
        rows += [(0, meet.KEY, m, n, 1.0 if n == m else 0.75, None, None) for n in near]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


def test_classes_behind_a_common_token_are_rated_only_if_they_may_count(monkeypatch):
    c, pairs = LookupConfig(), []
    plain = meet.numbered_similarities
    monkeypatch.setattr(meet, "numbered_similarities", lambda ms, xs, im, *rest: pairs.append(len(im)) or plain(ms, xs, im, *rest))
    # of the last one no number is near, so all have to be rated
    t = _cell(range(0, 600), [3, 217, 599, 8765])
    rows = lambda: sorted((r["mention"], r["key"], r["label"], r["origin"], r["partial"], round(r["score"], 12)) for b in meet.Cell(t, c).rated(0.75, 5, True) for r in b.to_pylist())
    monkeypatch.setattr(meet, "COMMON", 1 << 40)
    every, rated = rows(), sum(pairs)
    pairs.clear()
    monkeypatch.setattr(meet, "COMMON", 100)
    assert rows() == every and len({r[0] for r in every}) == 4
    assert sum(pairs) < rated / 3


def test_hits_leave_a_cell_as_lists(monkeypatch):
    """Each label of each form with each mention that meets it, however lists and batches are cut."""
    numbers, asked = range(0, 30), [3, 17, 29]
    labels = [(0, meet.NAMED, 3 * n + k, 100 * n + 10 * k + i, None if i == 3 else float(i), f"S{n}-{i}", None) for n in numbers for k in (0, 1) for i in range(1 + n % 5)]
    t = pa.concat_tables([_cell(numbers, asked), pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*labels, strict=True), ROW, strict=True)], schema=ROW)])
    want = {}
    for b in meet.Cell(t, LookupConfig()).hits():
        for r in b.to_pylist():
            want |= {(r["mention"], x[3]): (x[5], x[4], r["bm25"]) for x in labels if x[2] == r["form_id"]}
    monkeypatch.setattr(meet, "PIECE", 2)
    monkeypatch.setattr(meet, "SENT", 5)
    monkeypatch.setattr(meet, "LIST", 40)
    rows = [r for b in meet.Cell(t, LookupConfig()).listed() for r in b.to_pylist()]
    got = [((a["mention"], x["label_id"]), (x["entity"], x["pr"], a["bm25"])) for r in rows for a in r["asked"] for x in r["named"]]
    assert dict(got) == want and len(got) == len(want) and max(len(r["named"]) for r in rows) == 2


def test_tries_find_common_subsequences(monkeypatch):
    monkeypatch.setattr(similarity.Tries, "LEAST", 3)
    r = np.random.default_rng(7)
    xs = ["", *{"".join(r.choice(list("aab0é"), r.integers(1, 8))) for _ in range(200)}]
    for s in ("a", "ab0é", "z", "ba0a" * 16):
        assert [n for n in similarity.Tries(xs).lcs(s).tolist() if n >= 0] == [similarity.lcs_length(s, x) for x, n in zip(xs, similarity.Tries(xs).lcs(s).tolist(), strict=True) if n >= 0]
    assert (similarity.Tries(xs).lcs("a") >= 0).sum() > 150


def test_counts_compare_few_of_the_pairs(monkeypatch):
    """The classes counted are those that are rated and kept; most pairs are decided by bounds."""
    c, pairs = LookupConfig(), []
    plain = meet.numbered_similarities
    monkeypatch.setattr(meet, "numbered_similarities", lambda ms, xs, im, *rest: pairs.append(len(im)) or plain(ms, xs, im, *rest))
    numbers, asked = range(0, 900), [3, 217, 599, 8765]
    rows = _cell(numbers, asked).to_pylist()
    for r in rows:  # one word each, as in names of suppliers; each class is of two entities
        r["s"] = r["s"] and r["s"].replace(" ", "#")
        r["x"] = 2.0 if r["kind"] == meet.MEMBER else r["x"]
    t = pa.Table.from_pylist(rows, schema=ROW)
    kept = [r["mention"] for b in meet.Cell(t, c).rated(0.75, None, True) for r in b.to_pylist()]
    rated = sum(pairs)
    pairs.clear()
    got = {r["mention"]: r["n"] for b in meet.Cell(t, c).counted(0.75) for r in b.to_pylist()}
    assert got == {m: 2 * kept.count(m) for m in kept} and len(got) == 4
    assert sum(pairs) < rated / 3


def test_deletion_keys_of_buckets_lead_to_all_near_texts():
    r = np.random.default_rng(5)
    left, right = ([*{"".join(r.choice(list("abé0"), r.integers(0, 10))) for _ in range(150)}, "x" * 64, "x" * 66] for _ in range(2))
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    distance = np.array([similarity._edits(left[i], right[j]) for i, j in zip(ia, ib, strict=True)])
    assert (similarity.edit_distances(left, right, ia, ib) == distance).all()
    texts = pa.RecordBatch.from_pydict({"side": pa.array([0] * len(left) + [1] * len(right), pa.int32()), "text": left + right})
    keyed = pa.Table.from_batches(list(meet.deletions(5)(iter([texts]))))
    found = set()
    for k in range(5):
        for b in meet.near(iter(keyed.filter(pa.array(keyed["bucket"].to_numpy() == k)).to_batches())):
            found |= {tuple(x.values()) for x in b.to_pylist()}
    most = meet.allowed(np.array([len(left[i]) for i in ia]))
    assert found == {(left[i], right[j], d) for i, j, d, e in zip(ia, ib, distance.tolist(), most, strict=True) if d <= e}


def test_bounds_are_never_below_the_ratio():
    r = np.random.default_rng(6)
    words = ["north", "South", "a b", "0012", "0021", "é", "north  of", " x"]
    ms, xs = ([*{" ".join(r.choice(words, r.integers(1, 4))) for _ in range(60)}] for _ in range(2))
    ms = [*{m.lower() for m in ms}]
    im, ix = (x.ravel() for x in np.meshgrid(np.arange(len(ms)), np.arange(len(xs)), indexing="ij"))
    ratio, _ = similarity.numbered_similarities(ms, xs, im, ix, np.ones(len(im)), 0.75)
    bound = similarity.Bounds(ms, xs).of(im, ix, np.ones(len(im)))
    assert (bound >= ratio).all() and (bound < 0.9).any()
