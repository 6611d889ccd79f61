import random
import re

import numpy as np

from paperloom.llm import jaccard


def brute(rows, percent=80):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    base = [rng.choices(vocab, k=rng.choice([3, 6, 40, 150])) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocab, k=rng.choice([4, 30, 90]))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        sep = rng.choice([" ", "\n", "\t ", "  "])
        rows.append((i, sep.join(w).replace("w1", rng.choice(["w1", "W1"]))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "é x"), (n + 4, "x " * 30000)]


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(5)
        for tile, hot in ((2_000, 200_000), (6, 40)):
            assert {tuple(r) for r in jaccard.components(df, tile=tile, hot=hot).collect()} == brute(rows)


def test_low_region_still_exact(spark):
    rows = corpus(3, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held, jaccard.CUT = jaccard.CUT, int(0.02 * 2**63)
    try:
        assert {tuple(r) for r in jaccard.components(df).collect()} == brute(rows)
    finally:
        jaccard.CUT = held


def test_odd_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(df).collect() == []
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "A b C d e f")]
    got = sorted(map(tuple, jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (9, 2, 3)], key=str)


def test_blocks_are_skipped_and_no_pair_is_lost():
    rng = np.random.default_rng(5)
    n = np.concatenate([rng.integers(100, 105, 400), rng.integers(300, 310, 400)])
    pos = np.concatenate([np.sort(rng.integers(0, 21, 400)), np.sort(rng.integers(0, 61, 400))])
    kept = set(jaccard.block_pairs(n, pos, 80, 16))
    starts = range(0, 800, 16)
    every = {(i, j) for i in starts for j in starts if i <= j}
    by_size = {(i, j) for i, j in every if (i < 400) != (j < 400)}
    assert kept <= every - by_size and len(kept) < 0.95 * len(every - by_size)
    for x in range(800):
        for y in range(x + 1, 800):
            most = min(pos[x], pos[y]) + min(n[x] - pos[x], n[y] - pos[y])
            if 100 * min(n[x], n[y]) >= 80 * max(n[x], n[y]) and most >= jaccard.needed(n[x], n[y], 80):
                assert (x // 16 * 16, y // 16 * 16) in kept


def test_hot_tokens_are_counted_whole(spark):
    rows = [(i, "a common passage of some words that many documents share in full " + " ".join(f"w{i}x{k}" for k in range(9)), i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp long").repartition(4)
    loads = jaccard.profiles(df.drop("comp"), 5, 80)
    often = jaccard.hot_tokens(df, loads, 5, 80, 30)
    assert all((r.df, r.lo, r.hi) == (50, 0, 49) for r in often.collect())
    assert often.count() == jaccard.index(df, 5, 80).groupBy("t").count().where("count > 30").count() > 0
    assert jaccard.hot_tokens(df, loads, 5, 80, 60) is None


def test_hubs_are_dealt_out(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 60 - i % 3])) for i in range(300)] + [(900, "other text here of five words")], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(0, 900), (5, 6), (0, 1)], "a long, b long")
    got = sorted(map(tuple, jaccard.verify(pairs, docs, 5, 80, fan=20).collect()))
    assert got == sorted([(0, i) for i in range(1, 300)] + [(5, 6)])
