import random

import numpy as np
from pyspark.sql import functions as F

from gridsense.llm import quality


def made(n=400):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ke", "po", "li", "dor", "vas")]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, bad = k % 7 == 0, k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilestuff.", "Nastyword"]))
        if bad:
            w = [x + "%%%" for x in w]
        docs.append((k, " ".join(w), f"http://host{k % 3}/p{k % 2}/x", "extra"))
        if k < n // 2:
            labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def classify(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r.doc_id: r for r in quality.classify(d, lab, "doc_id", "text", "source").collect()}


def test_unlabelled_rows_are_judged_like_labelled_ones(spark):
    docs, labels = made()
    got = classify(spark, docs, labels)
    wrong = [k for k in range(200, 400) if got[k].kept != (k % 7 != 0 and k % 5 != 0)]
    assert len(got) == 400 and len(wrong) <= 2


def test_corner_cases(spark):
    docs, labels = made(200)
    odd = [(900, None, None, "e"), (901, "", "s", "e"), (None, "lona mike", "", "e"), (902, "lona " * 60_000, "http://host0", "e"), (0, docs[0][1], docs[0][2], "e")]
    got = classify(spark, docs + odd, [*labels, (3, None, None), (None, 1, 0), (0, 0, 1)])
    assert {900, 901, 902, None} <= set(got) and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 and r.kept is not None for r in got.values())
    none = classify(spark, docs[:5], [])
    assert all(r.kept and r.p_quality == 0.5 for r in none.values())
    assert classify(spark, [], labels) == {}


def scores(spark, rows):
    return spark.createDataFrame([(k, h, p, e, -3.0) for k, (h, p, e) in enumerate(rows)], "k long, _host string, _path string, _e_quality double, _e_toxic double")


def test_sparse_sites_shrink_towards_the_rest(spark):
    rows = [(site, "a", e + d) for site, e, n in (("big", 1.0, 20), ("bad", -1.0, 20), ("few", -1.0, 1)) for d in (-2.0, 0.0, 2.0) for _ in range(n)] + [("one", "a", -1.0)]
    shift = {r._host: r.s for r in quality.shifted(scores(spark, rows)).groupBy("_host").agg(F.avg("_shift_quality").alias("s")).collect()}
    # a document alone has no site beside itself
    assert shift["big"] > 0 == shift["one"] > shift["few"] > shift["bad"]


def test_paths_differ_within_their_host(spark):
    rng = random.Random(4)
    rows = [(f"h{h}", f"p{p}", (2.0 if (h + p) % 3 else -2.0) + rng.gauss(0, 0.5)) for h in range(8) for p in range(4) for _ in range(30)]
    rows += [("h0", "new", 0.0), ("h1", "new", 0.0)]
    got = {(r._host, r._path): r._shift_quality for r in quality.shifted(scores(spark, rows)).collect()}
    assert got["h0", "p0"] < -1 < 0.2 < got["h0", "p1"]  # one host, two paths
    assert abs(got["h0", "new"]) < 0.5  # an unknown path has its host's rate


def test_posteriors_by_brute_force(spark):
    """Each document's site rate from the sites as they are without it, in plain Python."""
    rng = random.Random(6)
    rows = []
    for h in range(6):
        base = rng.gauss(0, 1.5)
        for p in range(rng.randrange(1, 5)):
            there = base + rng.gauss(0, 1)
            rows += [(f"h{h}", f"p{p}", there + rng.gauss(0, 1)) for _ in range(rng.choice([1, 2, 7, 40]))]
    rows.append(("lone", "p", 2.0))
    x = [1 / (1 + np.exp(-e)) for _, _, e in rows]
    hosts, paths = {}, {}
    for k, (h, p, _) in enumerate(rows):
        hosts.setdefault(h, []).append(k)
        paths.setdefault((h, p), []).append(k)
    total = lambda ks: sum(x[k] for k in ks)
    n, g = len(rows), sum(x) / len(rows)
    inner = sum((x[k] - total(ks) / len(ks)) ** 2 for ks in paths.values() for k in ks) / (n - len(paths))
    share = sum(len(ks) ** 2 / len(hosts[h]) for (h, _), ks in paths.items())
    apart = sum(len(ks) * (total(ks) / len(ks) - total(hosts[h]) / len(hosts[h])) ** 2 for (h, _), ks in paths.items())
    path = max(0, (apart - (len(paths) - len(hosts)) * inner) / (n - share))
    apart = sum(len(ks) * (total(ks) / len(ks) - g) ** 2 for ks in hosts.values())
    noise = (len(hosts) - 1) * inner + path * (share - sum(len(ks) ** 2 for ks in paths.values()) / n)
    host = max(0, (apart - noise) / (n - sum(len(ks) ** 2 for ks in hosts.values()) / n))
    assert path > 0 and host > 0
    logit = lambda p: np.log(p / (1 - p))
    got = {r.k: r._shift_quality for r in quality.shifted(scores(spark, rows)).collect()}
    for k, (h, p, _) in enumerate(rows):
        means = [(total(rest) / len(rest), 1 / (path + inner / len(rest))) for (h_, _), ks in paths.items() if h_ == h and (rest := [j for j in ks if j != k])]
        rate = g
        if means:
            weight = sum(w for _, w in means)
            rate += (sum(m * w for m, w in means) / weight - g) * host / (host + 1 / weight)
        if rest := [j for j in paths[h, p] if j != k]:
            rate += (total(rest) / len(rest) - rate) * path / (path + inner / len(rest))
        want = logit(min(1 - 1e-4, max(1e-4, rate))) - logit(g)
        assert abs(got[k] - max(-2, min(2, want))) < 1e-6, rows[k]


def test_hot_host(spark):
    rows = [("hot", f"p{k % 2}", 1.0 + k % 2) for k in range(900)] + [(f"h{k}", "p", -1.0) for k in range(100)]
    got = [r._shift_quality for r in quality.shifted(scores(spark, rows)).collect()]
    assert len(got) == 1000 and all(abs(s) <= 2 for s in got)


def test_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op8_site_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = out.agg(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("double"))).alias("clean"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("double"))).alias("junk")).first()
    assert got.clean > 0.97 and got.junk < 0.05


def test_copies_weigh_as_one():
    bucket = np.array([1, 2, 1, 2, 5, 6])
    row = np.array([0, 0, 1, 1, 2, 2])
    family, weight = quality.families(bucket, row, 3)
    assert family[0] == family[1] != family[2] and weight.tolist() == [0.5, 0.5, 1.0]
