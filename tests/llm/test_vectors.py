import numpy as np

from paperloom.llm import ann, neardup_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def odd_rows(rng, n=400, dim=64):
    base = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.standard_normal(dim) * (0.1 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, "x"))
    rows += [(1000, None, 1, "x"), (1001, [0.0] * dim, 1, "x"), (1002, [float("nan")] * dim, 1, "x"), (1003, [None] + [1.0] * (dim - 1), 1, "x")]
    rows += [(1004, rows[5][1], rows[5][2], "x"), (1005, rows[5][1], None, "x"), (1006, [1.0, 0.0, 0.0], 1, "x"), (1007, [1.0, 0.001, 0.0], 1, "x"), (1008, [], 1, "x")]
    return rows


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


def good(r):
    return r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])


def test_search_matches_brute_force(spark):
    rows = odd_rows(np.random.default_rng(1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = ann.search(ann.build_index(df), df.where("vec_id % 50 = 0"), k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = [r for r in rows if good(r)]
    hits = total = 0
    for q in (r for r in usable if r[0] % 50 == 0):
        want = sorted(((-cosine(q[1], r[1]), r[0]) for r in usable if r[0] != q[0] and len(r[1]) == len(q[1])))[:5]
        assert len(got[q[0]]) == len(want)
        hits += len({w[1] for w in want} & {g[0] for g in got[q[0]]})
        total += len(want)
        for (vid, score) in got[q[0]]:
            assert abs(score - cosine(q[1], next(r[1] for r in usable if r[0] == vid))) < 1e-12
    assert set(got) == {r[0] for r in usable if r[0] % 50 == 0}
    assert hits >= 0.99 * total


def test_search_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.search(ann.build_index(df), df).collect() == []


def test_link_matches_brute_force(spark):
    rows = odd_rows(np.random.default_rng(2))
    for tile in (8000, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = {r.vec_id: r for r in neardup_vectors.link(df, threshold=0.98, tile=tile).collect()}
        adj = {r[0]: set() for r in rows}
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if good(a) and good(b) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98:
                    adj[a[0]].add(b[0])
                    adj[b[0]].add(a[0])
        assert sum(map(len, adj.values())) > 50
        for v in adj:
            seen, todo = {v}, [v]
            while todo:
                for w in adj[todo.pop()] - seen:
                    seen.add(w)
                    todo.append(w)
            assert (got[v].n_links, got[v].component_id, got[v].kept) == (len(adj[v]), min(seen), min(seen) == v), v


def test_link_empty(spark):
    assert neardup_vectors.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_meet_fewer_pairs_than_labels_hold(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    reps = neardup_vectors.classes(df).where("ok").selectExpr("vec_id as node", "1L as mult", "label", "size(embedding) as dim", "embedding")
    met = []
    rows = neardup_vectors.tiles(reps, 0.98, 8000).orderBy("tile").toArrow()
    assert rows.num_rows <= 12 * df.count()
    list(neardup_vectors._find(0.98, met)(iter(rows.to_batches())))
    within = sum(r["count"] * (r["count"] - 1) // 2 for r in df.groupBy("label").count().collect())
    assert sum(met) < within


def test_near_pairs_finds_each_pair_once():
    rng = np.random.default_rng(8)
    x = rng.integers(-4000, 4000, (300, 8))
    x[100:200] = x[:100] + rng.integers(-300, 300, (100, 8))
    group, reach = rng.integers(0, 3, 300), np.full(300, 2263)
    group[100:200] = group[:100]
    got = [tuple(sorted(p)) for i, j in neardup_vectors.near_pairs(group, x, reach, np.zeros(300, np.int64), step=50) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and ((x[i] - x[j]) ** 2).sum() <= 2263**2}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 90


def test_link_in_double_precision(spark):
    a, b = [1.0, 0.0], [0.98, (1 - 0.98**2) ** 0.5]
    over = [[1e300, 1e-300], [1e300 * 0.999, 1e298]]
    rows = [(1, a, "x"), (2, b, "x"), (3, [v * 1e-200 for v in b], "x"), (4, over[0], "y"), (5, over[1], "y")]
    got = {r.vec_id: r.n_links for r in neardup_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got[4] == got[5] == 1 and got[2] >= 1


def test_search_blocks_chunks_and_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(70).tolist()) for i in range(900)] + [(None, [1.0] * 70), (7, [1.0] * 70), (2000, [1e300, 1e299]), (2050, [1.0, 0.1000001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 50 = 0")
    index = ann.build_index(df)
    plain = sorted(map(tuple, ann.search(index, asked, eps=50.0).collect()))
    assert sorted(map(tuple, ann.search(index, asked, eps=50.0, held_bytes=70 * 8 * 100, block=4).collect())) == plain
    got = {(q, r): (v, s) for q, r, v, s in plain}
    for q in range(0, 900, 50):
        want = sorted((-cosine(rows[q][1], v), i) for i, v in rows if i is not None and i != q and len(v) == 70)[:5]
        assert [got[q, r + 1][0] for r in range(5)] == [i for _, i in want]
        assert all(abs(got[q, r + 1][1] + s) < 1e-12 for r, (s, _) in enumerate(want))
    assert got[2000, 1][0] == 2050 and abs(got[2000, 1][1] - cosine([1.0, 0.1], [1.0, 0.1000001])) < 1e-12


def test_recall_and_savings_on_embeddings(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.array([r.embedding for r in t.collect()], float), np.array([r.vec_id for r in t.select("vec_id").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in ann.search(ann.build_index(t), t.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = u @ u[q]
        c[q] = -2
        hits += len(found[ids[q]] & set(ids[np.argsort(-c)[:5]].tolist()))
        total += 5
    assert hits / total >= 0.95
    r = x @ ann.rotation(64, 7)
    codes = ann.Codes(ids, np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / 8 / np.linalg.norm(x, axis=1), x)
    met = []
    codes.nearest(ids[:40], x[:40], 5, 1.6, 7, met)
    assert sum(met[1::2]) < 0.3 * sum(met[0::2])
