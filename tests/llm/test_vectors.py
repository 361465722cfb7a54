import numpy as np
import pytest

from gridsense.llm import vectors


def brute(rows, cosine):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[k] = x / np.linalg.norm(x)
    links = {k: [j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] >= cosine] for k in good}
    label = {}
    for k in range(len(rows)):
        if k in label:
            continue
        stack, seen = [k], {k}
        while stack:
            for j in links.get(stack.pop(), []):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        low = min(rows[j][0] for j in seen)
        label.update(dict.fromkeys(seen, low))
    return sorted((rows[k][0], len(links.get(k, [])), label[k], label[k] == rows[k][0]) for k in range(len(rows)))


@pytest.mark.parametrize("dim", [3, 20, 64])
def test_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 20)
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((12, dim))
    rows = [(k, (base[k % 12] + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.3])).tolist()) for k in range(150)]
    rows += [(200, rows[0][1]), (201, [2 * x for x in rows[1][1]]), (202, None), (203, [0.0] * dim), (204, [float("nan")] + [1.0] * (dim - 1)), (205, [None] + [1.0] * (dim - 1)), (206, []), (207, [1.0] * (dim + 1)), (208, [float("inf")] * dim), (209, [1e-200] * dim), (210, [1.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.link(df, "vec_id", "embedding", 0.95).collect())
    assert got == brute(rows, 0.95)


def test_pairs_close_to_the_threshold_count_once(spark):
    rng = np.random.default_rng(5)
    dim, base = 64, rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = []
    for k, b in enumerate(base):
        for j in range(4):
            # cosines of 0.94 to 0.97 with the base: half of the pairs are just below the threshold
            side = rng.standard_normal(dim)
            side -= (side @ b) * b
            side /= np.linalg.norm(side)
            c = rng.uniform(0.94, 0.97)
            rows.append((8 * k + j, (c * b + np.sqrt(1 - c * c) * side).tolist()))
        rows.append((8 * k + 7, b.tolist()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    expected = [int((x[lo : lo + 500] @ x.T >= 0.95)[i].sum()) - 1 for lo in range(0, len(x), 500) for i in range(min(500, len(x) - lo))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.link(df, "vec_id", "embedding", 0.95).collect()}
    assert sum(expected) > 3000 and [got[k] for k, _ in rows] == expected


def test_several_vectors_under_one_key_give_a_row_each(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (5, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.link(df, "vec_id", "embedding", 0.95).collect())
    assert got == brute(rows, 0.95)
    assert [r[0] for r in got] == [5, 5, 5, 7, 9]


def test_many_copies_and_empty(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(300)] + [(1000, [3.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link(df, "vec_id", "embedding", 0.95).collect()}
    assert got[0] == (299, 0, True) and got[299] == (299, 0, False) and got[1000] == (0, 1000, True)
    assert vectors.link(df.limit(0), "vec_id", "embedding", 0.95).collect() == []


def test_forest_connects_what_links_connect():
    a, b = np.array([5, 9, 7, 1]), np.array([9, 7, 3, 2])
    assert sorted(zip(*map(list, vectors.forest(a, b)), strict=True)) == [(2, 1), (5, 3), (7, 3), (9, 3)]
