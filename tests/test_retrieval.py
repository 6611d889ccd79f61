import re

from paperloom.functions import providers as P
from paperloom.operators import retrieval as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ASKED = [(1, None, [1.0, 0.0, 1.0]), (2, "a", [0.0, 1.0, 0.0]), (3, None, [2.0, 1.0, 0.0]), (3, None, [2.0, 1.0, 0.0]), (4, "b", [1.0, 1.0, 1.0]), (5, "none", [1.0, 1.0, 1.0])]


def test_tiles_of_the_store_change_nothing(spark):
    rows = [(i, i, "ab"[i % 2] if i % 7 else None, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    store = spark.createDataFrame(rows, "rowid long, id long, namespace string, vec array<double>")
    queries = spark.createDataFrame(ASKED, "query_no long, namespace string, qvec array<double>")
    for k in (50, 3, None):
        want = sorted(map(tuple, V.search(store, queries, k).collect()))
        for most in (0, 2):
            assert sorted(map(tuple, V.search(store, queries, k, max_queries=most).collect())) == want
    assert V.search(store, queries.limit(0)).count() == 0
    got = [(r.query_no, r.id) for r in V.search(store, queries.where("query_no = 2"), 3).orderBy("rank").collect()]
    best = sorted((-(v[1] / sum(x * x for x in v) ** 0.5), i) for i, _, ns, v in rows if ns == "a")[:3]
    assert got == [(2, i) for _, i in best]


def test_named_queries_meet_by_hash_and_tasks_keep_their_best(spark):
    store = spark.range(40).selectExpr("id AS rowid", "id", "cast(id % 3 AS string) AS namespace", "array(1.0D, cast(id AS double)) AS vec")
    queries = spark.createDataFrame([(1, "1", [1.0, 2.0])], "query_no long, namespace string, qvec array<double>")
    top = plan_of(V.search(store, queries, 5))
    assert "BroadcastNestedLoopJoin" not in top and "BroadcastHashJoin" in top
    final, exchange, partial = top.index(", Final"), top.index("Exchange hashpartitioning(query_no"), top.index(", Partial")
    assert final < exchange < partial and "WindowGroupLimit" in top
    assert "Exchange hashpartitioning" not in plan_of(V.search(store, queries, None))
    many = queries.unionAll(spark.range(100).selectExpr("id + 10", "'1'", "array(1.0D, 1.0D)"))
    assert plan_of(V.search(store, many, 5, max_queries=10)).count("Join") == top.count("Join")


def test_loss_over_whole_namespaces(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    rows = [(["a", "b", None][i % 3] if i else "alone", i, v.tolist()) for i, v in enumerate(x)] + [("a", 900, [0.0] * 6), ("a", 901, None), ("b", 902, [1.0])]
    store = spark.createDataFrame(rows, "namespace string, id long, vec array<double>")
    for tile in (1000, 7):
        got = {r.namespace: r.loss for r in V.info_nce(store, tile=tile).collect()}
        assert got.pop("alone") == 0.0 and set(got) == {"a", "b", None}
        for ns, loss in got.items():
            u = np.array([v for n, i, v in rows[:90] if n == ns])
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            s = u @ u.T / 0.05
            assert abs(loss - np.mean(np.log(np.exp(s).sum(axis=1)) - np.diag(s))) < 1e-4


def test_chat_context_against_brute_force(spark):
    from paperloom.functions import providers as P
    from paperloom.plans import api

    words = "river stone light paper green seven north cloud bread music".split()
    texts = [" ".join(words[(i * 3 + j * j) % 10] for j in range(3 + i % 4)) for i in range(25)] + ["river stone", "river stone"]
    chunks = spark.createDataFrame([(i // 5, i % 5, t, i % 3, None if i % 2 else f"head {i}") for i, t in enumerate(texts)], "doc_id long, index int, text string, page int, heading string")
    asked = [(1, "river stone light"), (2, "green paper\n\nnorth cloud"), (3, "music")]
    store = api.load(chunks, "corpus", "hash64")
    got = {r.base: re.sub(r"score: [^)]*", "", r.context) for r in api.chat_context(store, spark.createDataFrame(asked, "base long, query string"), "hash64", k=3).collect()}

    entries, model = store.collect(), P.HashProvider(64)

    def cosine(a, b):
        norms = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0

    for base, query in asked:
        answer = ("Rephrase:\n" + query)[:200]
        found = {}
        for variant in [query, *[x for x in answer.split("\n") if x.strip()][:3]]:
            q = model.embed(variant)
            best = sorted(((-cosine(q, e.vec), e.rowid, e) for e in entries), key=lambda x: x[:2])[:6]
            for s, _, e in best:
                if s <= 0:
                    found.setdefault(e.id, e)
        passages = [f"[Trecho () [p.{e.page}" + (f", §{e.heading}" if e.heading else "") + f"]]\n{e.text}\n" for e in list(found.values())[:3]]
        assert got[base] == "\n".join(passages)


def test_blocks_score_odd_vectors_as_pairs_do(spark):
    import math

    nan, inf = math.nan, math.inf
    odd = [[1.0, 2.0], [0.0, 0.0], [], None, [1.0, None], [nan, 1.0], [3.0], [1.0, 1.0, 1.0], [-1.0, -2.0], [inf, 1.0]]
    store = spark.createDataFrame([(i, i, ["a", None, "b"][i % 3], v) for i, v in enumerate(odd * 60)], "rowid long, id long, namespace string, vec array<double>").coalesce(1)
    asked = [(i, None, v) for i, v in enumerate(odd[:9])]
    queries = spark.createDataFrame(asked, "query_no long, namespace string, qvec array<double>")

    def score(x, y):
        if x is None or y is None or None in x or None in y:
            return None
        both = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return 0.0 if both == 0 else sum(a * b for a, b in zip(x, y, strict=False)) / both

    want = [(n, i, s) for n, _, x in asked for i, y in enumerate(odd * 60) if (s := score(x, y)) is not None and not s < 0.2]
    plain = lambda rows: sorted((n, i, "nan" if math.isnan(s) else f"{s:.3f}") for n, i, s in rows)
    for most in (10_000, 0):
        hits = V.search(store, queries, None, 0.2, max_queries=most)
        assert plain(map(tuple, hits.collect())) == plain(want)
    assert "zip_with" not in plan_of(hits) and "MapInArrow" in plan_of(hits)


def test_hashed_words_are_those_of_plain_md5():
    import hashlib

    import numpy as np

    text, want = "The cat, the CAT and été 9", np.zeros(64)
    for w in ("the", "cat", "the", "cat", "and", "été", "9"):
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        want[h % 64] += 1 if h >> 63 else -1
    assert P.HashProvider(64).embed(text) == (want / np.linalg.norm(want)).tolist()
    assert P.HashProvider(64).embed("") == [0.0] * 64


def test_entries_are_embedded_once(spark):
    """The search and the texts of its hits, and several tools, read what is kept."""
    from paperloom.plans import catalogue

    for name, least in (("retrieval_pipeline", 2), ("document_tool_results", 6)):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
        assert plan.count("InMemoryRelation") >= least
    spark.catalog.clearCache()
