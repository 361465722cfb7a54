import random

import numpy as np

from gridsense.llm import decontaminate

ITEMS = [
    (1, "Quixotic marmots gallivant beneath luminous archways while pondering velvet thunderstorms above crimson harbours tonight"),
    (2, "Which gas do plants absorb from the surrounding atmosphere during photosynthesis in bright sunshine? Answer: carbon dioxide"),
    (3, "Épices rares: le marchand d'Ouagadougou échangea safran, cardamome et muscade contre étoffes indigo brodées"),
    (4, None),
    (5, "  "),
]


def filler(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "stone", "walks", "green", "seven", "table", "light", "under"]) for _ in range(n))


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, cover string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r.item_id for r in decontaminate.contaminated(docs, "doc_id", "text", bench).collect() if r.contaminated}


def test_copies_and_paraphrases_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    clean = [filler(rng, 300) for _ in range(40)] + [None, "", "?!", "carbon dioxide is a gas", "velvet thunderstorms"]
    changed = ITEMS[0][1].replace("gallivant", "wander").replace("crimson", "reddish").upper().replace(" ", "  ")
    hot = [
        filler(rng, 500) + " " + ITEMS[0][1] + " " + filler(rng, 500),
        filler(rng, 37) + " " + changed,
        ITEMS[1][1],
        ITEMS[1][1].replace("carbon dioxide", "oxygen maybe"),
        filler(rng, 90) + " " + ITEMS[2][1].upper() + ".",
        filler(rng, 30_000) + " " + ITEMS[0][1],
    ]
    got = found(spark, clean + hot)
    n = len(clean)
    assert got == {n: 1, n + 1: 1, n + 2: 2, n + 4: 3, n + 5: 1}


def test_long_answers_need_not_be_covered_whole(spark):
    ask = "Which harbour did velvet marmots quietly abandon after luminous thunderstorms?"
    passage = [f"passage{k}" for k in range(24)]
    long_ask = " ".join(f"premise{k}" for k in range(30)) + "?"
    items = [(1, f"{ask} {' '.join(passage)}"), (2, f"{long_ask} {' '.join(f'option{k}' for k in range(12))}"), (3, f"{long_ask.replace('premise', 'fact')} Answer: crimson dioxide")]
    one_changed = f"{ask} {' '.join(passage[:9] + ['other'] + passage[10:])}"
    texts = [one_changed, f"{long_ask} {' '.join(f'else{k}' for k in range(12))}", items[2][1], items[2][1].replace("dioxide", "oxide")]
    assert found(spark, texts, items) == {0: 1, 2: 3}


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contaminated(docs, "doc_id", "text", none).collect()] == [False, False]
    assert decontaminate.contaminated(docs.limit(0), "doc_id", "text", spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert found(spark, [ITEMS[0][1], ITEMS[2][1], "nothing here"]) == {0: 1, 1: 3}


def test_verbatim_items_are_found_in_blocks_of_more_items_than_dimensions(spark):
    # the longer items take all dimensions and stand around the shorter ones
    strong = [" ".join(f"strong{k}x{i}" for i in range(12)) for k in range(600)]
    items = list(enumerate(strong + [" ".join(f"weak{k}x{i}" for i in range(5)) for k in range(600)]))
    docs = spark.createDataFrame([(k, f"{strong[k % 599]} {t} {strong[(k + 7) % 599]}") for k, t in items], "doc_id long, text string")
    pairs = decontaminate.matches(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert {k for k, _ in items} - {r.rid for r in pairs.collect() if r.rid == r.item} == set()


def test_every_pair_that_a_subsequence_confirms_is_found(spark):
    """The whole operator against no candidate search at all: each window of each document and each item."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = decontaminate.Items(*zip(*((r.item_id, r.text.lower()) for r in bench.collect()), strict=True))
    want = set()
    for r in docs.collect():
        w = decontaminate.Items._words((r.text or "").lower())
        has = set(w.tolist())
        for m, mine in enumerate(items.words):
            if sum(x in has for x in mine.tolist()) < items.need[m]:
                continue
            _, lo, hi = decontaminate.windows(np.array([0, len(w)]), int(items.scale[m]))
            if any(items.confirm(m, w[a:b]) for a, b in zip(lo, hi, strict=True)):
                want.add((r.doc_id, items.ids[m]))
    got = {(r.rid, r["item"]) for r in decontaminate.matches(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    assert got == want and len(want) >= 5


def test_latent_space_finds_what_shared_words_do_not(spark):
    """The heavy words of an item are replaced by words that the corpus uses in the same company. The words that stay
    are too frequent to weigh, so the TF-IDF product is far below its bound."""
    rng = random.Random(5)
    plain = [f"plain{k}" for k in range(14)]
    heavy, twin = [f"heavy{k}" for k in range(6)], [f"twin{k}" for k in range(6)]
    item = " ".join(plain[:7] + heavy[:3] + plain[7:] + heavy[3:])
    other = " ".join(twin + [f"else{k}" for k in range(12)])
    company = [f"near{k}" for k in range(8)]
    docs = []
    for k in range(400):
        pool = (heavy if k % 2 else twin) if k % 4 < 2 else plain
        docs.append(" ".join(rng.sample(pool, 4 if pool is not plain else 9) + (rng.sample(company, 6) if pool is not plain else []) + [filler(rng, 6)]))
    paraphrase = item.replace("heavy", "twin")
    items = [(1, item), (2, other), (3, " ".join(company + [f"more{k}" for k in range(12)]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([*enumerate(docs), (1000, paraphrase)], "doc_id long, text string")
    pairs = lambda: {(r.rid, r["item"]) for r in decontaminate.matches(df, "doc_id", "text", bench, "item_id", "text").collect()}
    assert (1000, 1) in pairs()
    # without the latent candidates the pair is lost
    block = decontaminate.Items([i for i, _ in items], [t for _, t in items])
    texts = [decontaminate.Items._words(t) for t in [*docs, paraphrase]]
    block.weigh(np.array([sum(v in set(t.tolist()) for t in texts) for v in block.vocabulary.tolist()], float), len(texts))
    f = block.feature[np.searchsorted(block.vocabulary, texts[-1])]
    f = f[f >= 0]
    assert block.product(32, 1, np.zeros(len(f), int), f)[0, 0] < decontaminate.MASS * block.square[0]


def test_svd(spark):
    rng = np.random.default_rng(1)
    dense = (rng.random((12, 30)) < 0.2) * rng.random((12, 30))
    row, f = np.nonzero(dense)
    key, v = decontaminate.pair_products(row, f, dense[row, f], 30)
    products = spark.createDataFrame([(int(k // 30), int(k % 30), float(x)) for k, x in zip(key, v, strict=True)], "f long, g long, v double")
    basis = decontaminate.randomised_svd(products, 30, 12)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-8)
    three = decontaminate.randomised_svd(products, 30, 3)
    exact = np.linalg.svd(dense)[2][:3].T
    assert np.linalg.norm(dense @ three) > 0.99 * np.linalg.norm(dense @ exact)


def test_longest_common_subsequence():
    rng = random.Random(7)
    items = decontaminate.Items([1], ["a b c d e f g h i j k l"])
    for _ in range(50):
        window = [rng.choice("abcdefghijklxyz") for _ in range(25)]
        a, b = "abcdefghijkl", window
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        lcs = table[-1][-1]
        got = items.confirm(0, decontaminate.Items._words(" ".join(window)))
        assert got == (lcs / 12 if lcs >= decontaminate.COVER * 12 else 0.0)
