"""Folds against plain Python models, properties, sources, providers and streams."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import providers as P
from paperloom.functions import text as T
from paperloom.operators import analysis as X
from paperloom.operators import blocks as B
from paperloom.operators import chunks as C
from paperloom.operators import render as R
from paperloom.operators import state as S
from paperloom.plans.config import PipelineConfig
from paperloom.sources import extract as E
from paperloom.streaming import jobs as J

tokens = lambda t: max(1, len(t) // 3)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def chunk_rows(rng, n):
    return [(d, i, "w" * int(rng.choice([10, 40, 200, 400])), f"h{i}" if rng.random() < 0.5 else None) for d in range(n) for i in range(int(rng.integers(1, 9)))]


def test_tiny_merge_is_the_greedy_pairing(spark):
    rows = chunk_rows(np.random.default_rng(1), 60)
    df = spark.createDataFrame(rows, "doc_id long, index int, text string, heading string").withColumn("tokens", T.token_count(F.col("text")))
    got = sorted((r.doc_id, r["index"], r.text, r.heading) for r in C.merge_tiny(df).collect())
    want = []
    for d in range(60):
        c = [r for r in rows if r[0] == d]
        i = 0
        while i < len(c):
            if tokens(c[i][2]) < 50 and i + 1 < len(c):
                want.append((d, c[i][1], c[i][2] + "\n\n" + c[i + 1][2], c[i][3] or c[i + 1][3]))
                i += 2
            else:
                want.append((d, c[i][1], c[i][2], c[i][3]))
                i += 1
    assert got == sorted(want)


def test_short_merge_is_the_fold(spark):
    rng = np.random.default_rng(2)
    rows = [(d, i, " ".join(["w"] * int(rng.choice([3, 9, 10, 20, 31, 40])))) for d in range(80) for i in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "doc_id long, seg_no int, text string")
    got = sorted((r.doc_id, r.text) for r in C.merge_short(df).collect())
    want = []
    for d in range(80):
        kept = []
        for r in (r for r in rows if r[0] == d):
            if kept and len(r[2].split()) < 10 and len(kept[-1].split()) > 30:
                kept[-1] += "\n\n" + r[2]
            else:
                kept.append(r[2])
        want += [(d, t) for t in kept]
    assert got == sorted(want)


def test_greedy_pack_is_the_fold(spark):
    rng = np.random.default_rng(3)
    texts = ["\n\n".join("x" * int(rng.integers(0, 200)) for _ in range(int(rng.integers(1, 12)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", C.greedy_pack(F.col("text"), 100).alias("c"))
    for r in df.collect():
        buf, out = "", []
        for p in texts[r.doc_id].split("\n\n"):
            if not buf:
                buf = p
            elif tokens(buf) + tokens(p) <= 100:
                buf += "\n\n" + p
            else:
                out.append(buf)
                buf = p
        if buf.strip():
            out.append(buf)
        assert [c.text for c in r.c] == [x.strip() for x in out]


def test_dedup_is_the_fold(spark):
    rng = np.random.default_rng(4)
    pool = ["alpha line one", "beta line two", "gamma " * 20, "delta", "a repeated footer line"]
    rows = [(d, i, "\n".join(rng.choice(pool, int(rng.integers(1, 5))))) for d in range(60) for i in range(int(rng.integers(1, 7)))]
    got = {}
    for r in C.dedup_adjacent(spark.createDataFrame(rows, "doc_id long, index int, text string"), least=5).collect():
        got.setdefault(r.doc_id, {})[r.k] = r.text
    for d in range(60):
        kept = []
        for t in (r[2] for r in rows if r[0] == d):
            if not kept:
                kept.append(t)
                continue
            prev = kept[-1]
            if t in prev or prev in t:
                kept[-1] = t if len(t) > len(prev) else prev
                continue
            lines = t.split("\n")
            new = [x for x in lines if x not in prev.split("\n") or len(x.strip()) > 80]
            if len(new) >= len(lines) * 0.3 and tokens("\n".join(new)) >= 5:
                kept.append("\n".join(new))
        assert [got[d][k] for k in sorted(got[d])] == kept


def test_pelt_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(10, 40))
        x = np.repeat(rng.normal(size=(4, 2)), n // 4 + 1, axis=0)[:n] + rng.normal(size=(n, 2)) * 0.1
        cost = lambda a, b: ((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum()
        best = [-0.5] + [np.inf] * n
        for t in range(5, n + 1):
            best[t] = min([best[s] + cost(s, t) + 0.5 for s in range(t - 4) if best[s] < np.inf], default=np.inf)
        cuts = [0, *C.pelt(x, 0.5)]
        assert abs(sum(cost(a, b) + 0.5 for a, b in zip(cuts, cuts[1:])) - 0.5 - best[n]) < 1e-6


def test_wasserstein_cost():
    assert C.wasserstein_cost(np.ones((5, 2)), 10) == 0.0
    assert C.wasserstein_cost(np.ones((8, 2)), 8) == pytest.approx(0.0, abs=1e-9)
    assert C.wasserstein_cost(np.vstack([np.eye(4), 5 * np.eye(4)[::-1] * [[1], [2], [3], [4]]]), 8) > 0


@few
@given(st.lists(st.text("ab\n/ 1LINK", max_size=30), min_size=1, max_size=5))
def test_boilerplate_filter_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(T.drop_boilerplate(F.col("text")).alias("text"))
    for r in df.select("text", T.drop_boilerplate(F.col("text")).alias("again")).collect():
        assert r.text == r.again


@few
@given(st.text(min_size=0, max_size=4000), st.integers(100, 400), st.integers(0, 90))
def test_fixed_cuts_cover_the_text(spark, text, size, overlap):
    cuts = spark.range(1).select(C.fixed_cuts(F.lit(text), size, overlap).alias("c")).first().c
    para, want = text, []
    while tokens(para) > size:
        want.append(para[:size])
        para = para[size - overlap :]
    assert cuts == [*want, para]
    with pytest.raises(ValueError):
        C.fixed_cuts(F.lit(text), size, size)


def test_config_bounds():
    assert PipelineConfig().chunk_size == 2000
    for bad in ({"chunk_size": 50}, {"chunk_overlap": 5000}, {"chunk_size": 100, "chunk_overlap": 100}, {"output_format": "pdf"}):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)


def test_files_through_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("one|two")
    (tmp_path / "b.pdf").write_text("bad")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.pdf").write_text("x" * 100)

    def parser(content: bytes) -> list[dict]:
        parts = content.decode().split("|")
        if len(parts) < 2:
            raise ValueError("no parts")
        return [{"page": 0, "block_no": i, "line_no": 0, "span_no": 0, "text": p, "size": 11.04, "font": "F"} for i, p in enumerate(parts)]

    good, refused = E.scan_files(spark, str(tmp_path), max_bytes=50)
    assert sorted(r.error for r in refused.collect()) == ["not a PDF", "too large"]
    assert [(r.block_no, r.text, r.font_size) for r in E.span_blocks(E.parse(good, parser)).orderBy("block_no").collect()] == [(0, "one", 11.0), (1, "two", 11.0)]
    assert ["no parts" in r.error for r in E.failures(good, parser).collect()] == [True]


def test_providers(spark):
    with pytest.raises(ValueError):
        P.provider("none")
    df = spark.createDataFrame([(1, "red apple"), (2, "red apple"), (3, None)], "id int, text string")
    v = {r.id: r.vec for r in P.embed(df).collect()}
    assert v[1] == v[2] and len(v[1]) == 384 and abs(np.linalg.norm(v[1]) - 1) < 1e-9 and not any(v[3])
    tools = P.Tools()
    tools.register("count", lambda: df.groupBy().count())

    class Scripted:
        def __init__(self, said):
            self.said, self.seen = list(said), []

        def chat(self, messages):
            self.seen = messages
            return self.said.pop(0)

    model = Scripted(['{"tool": "count", "arguments": {}}', "three rows"])
    assert tools.loop(model, "how many?") == "three rows" and '"count": 3' in model.seen[-1]["content"]
    with pytest.raises(ValueError):
        tools.call("other")


def test_tables_and_maps(spark):
    md = "| a | b<c |\n| --- | --- |\n| 1 | 2 |"
    row = spark.range(1).select(R.table_to_html(F.lit(md)).alias("h")).first()
    assert row.h == "<thead><tr><th>a</th><th>b&lt;c</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody>"


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from paperloom.sources import adapters as A

    events = A.job_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", J.tumbling), ("sliding", J.sliding), ("states", J.job_states)):
        J.run_to_table(f(stream), f"s_{name}", "complete", str(tmp_path / f"cp_{name}"))
        assert sorted(map(str, spark.table(f"s_{name}").collect())) == sorted(map(str, f(events).collect()))
    J.run_to_table(J.sessions(stream), "s_sessions", "complete", str(tmp_path / "cp_sessions"))
    assert sorted(map(str, spark.table("s_sessions").collect())) == sorted(map(str, J.sessions(events).collect()))


def test_admission_stream(spark, tmp_path):
    req = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    req.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "in"))
    J.run_to_table(J.admit_stream(stream, 2, 86400.0), "s_admit", "append", str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.table("s_admit").collect())) == sorted(map(tuple, S.admit(req, 2, 86400.0).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(1, i, t, "progress", 1.0) for i, t in enumerate(xs)], "job_id long, seq long, ts string, event string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((rows("2024-01-01 00:10:00", "2024-01-01 09:00:00"), rows("2024-01-01 09:10:00"), rows("2024-01-01 00:20:00"), rows("2024-01-02 00:00:00"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / "in" / f"{k}").glob("part-*.parquet")).rename(tmp_path / "flat" / f"{k}.parquet")
    stream = spark.readStream.schema(rows("2024-01-01 00:00:00").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    J.run_to_table(J.tumbling(stream, late="1 hour"), "s_late", "append", str(tmp_path / "cp"))
    got = {str(r.window_start): r.n for r in spark.table("s_late").collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 09:00:00"] == 2


def test_two_columns(spark):
    rows = [(1, 0, i, "text", x, y, x + 100.0, y + 10.0) for i, (x, y) in enumerate([(0.0, 0.0), (300.0, 0.0), (0.0, 20.0), (300.0, 20.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_no int, type string, x0 double, y0 double, x1 double, y1 double")
    assert [r.block_no for r in X.two_columns(df).orderBy("pos").collect()] == [0, 2, 1, 3]
    assert {r.block_no: r.row for r in X.row_groups(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_noise_and_condition(spark):
    from paperloom.operators import retrieval as V

    rng = np.random.default_rng(6)
    rows = [("a", i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [("b", i, [1.0] * 8) for i in range(5)]
    df = spark.createDataFrame(rows, "namespace string, id long, vec array<double>").repartition(4)
    x = np.array([r[2] for r in rows[:200]])
    s = np.linalg.svd(x, compute_uv=False)
    got = {r.namespace: r.condition for r in V.condition_number(df, 8).collect()}
    assert got["a"] == pytest.approx(s[0] / s[-1], rel=1e-9) and got["b"] > 1e6
    noise = np.array([np.array(r.noisy) - np.array(r.vec) for r in V.noisy_copy(df, 0.1).where("namespace = 'a'").collect()]).ravel()
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 0.1) < 0.01


def test_images_are_described_up_to_a_cap(spark):
    df = spark.createDataFrame([(1, 0, i, bytearray(b"x" * i)) for i in range(12)], "doc_id int, page int, image_no int, data binary")
    got = {r.image_no: r.description for r in P.describe_images(df, lambda b: f"{len(b)} bytes").collect()}
    assert got[3] == "3 bytes" and got[9] == "9 bytes" and got[10] == got[11] == "[image]"


def test_change_points_equal_the_best_segmentation(spark):
    rng = np.random.default_rng(9)

    def brute(x, penalty, least, cost):
        best, back = [-penalty] + [np.inf] * len(x), [0] * (len(x) + 1)
        for t in range(least, len(x) + 1):
            for s in range(t - least + 1):
                if best[s] < np.inf and best[s] + cost(x[s:t]) + penalty < best[t] - 1e-12:
                    best[t], back[t] = best[s] + cost(x[s:t]) + penalty, s
        ends, t = [], len(x)
        while t:
            ends.append(t)
            t = back[t]
        return sorted(ends)

    l2 = lambda w: ((w - w.mean(axis=0)) ** 2).sum()
    for n in (12, 40, 75):
        x = np.concatenate([rng.normal(m, 0.3, (n // 3, 4)) for m in (0, 2, -1)])
        for penalty in (0.5, 3.0):
            assert C.pelt(x, penalty) == brute(x, penalty, 5, l2) == C.search(x, penalty, 5, lambda w, n: l2(w))


def test_wasserstein_cost_of_halves():
    def plain(x, n):
        if len(x) < 6:
            return 0.0
        mid, halves = len(x) // 2, []
        for part in (x[:mid], x[mid:]):
            m = np.maximum(np.linalg.norm(part, axis=1) / (np.linalg.norm(part, axis=1).sum() + 1e-10), 1e-10)
            halves.append([(i / len(part), w / m.sum()) for i, w in enumerate(m)])
        at = sorted({p for h in halves for p, _ in h})
        cdf = [[sum(w for p, w in h if p <= t) for t in at] for h in halves]
        return sum(abs(a - b) * (u - t) for a, b, t, u in zip(*cdf, at, at[1:])) * (1 + 10 * len(x) / n)

    rng = np.random.default_rng(2)
    for n in (4, 6, 9, 31):
        x = rng.random((n, 3))
        assert C.wasserstein_cost(x, 40) == pytest.approx(plain(x, 40), rel=1e-9)


def test_change_point_segments_of_documents(spark):
    calm, loud = "the small river runs along the quiet field today", "CHAPTER 9: 11, 22, 33, 44, 55, 66, 77, 88; 99!!!"
    rows = [(i, "\n".join([calm] * 12 + [loud] * 12 + [calm] * 12)) for i in range(5)] + [(9, "# short\n" + calm), (10, None), (11, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = spark.createDataFrame([(0, 0, "nothing of it", True, 2)], "doc_id long, block_no int, text string, is_heading boolean, heading_level int")
    for cost in ("l2", lambda x, n: float(((x - x.mean(axis=0)) ** 2).sum())):
        u = C.unit_features(C.units_of(texts))
        got = C.change_points(u.where("doc_id < 9"), cost=cost).collect()
        assert {(r.doc_id, r.n_units) for r in got} == {(i, 12) for i in range(5)} and len(got) == 15
        assert all(r.confidence == 1.0 for r in got)
    s = C.change_point_segments(texts, blocks, cost="wasserstein").collect()
    assert {r.doc_id for r in s} == set(range(5))


def test_dispatcher_covers_every_document(spark):
    from paperloom.plans import api
    from paperloom.sources import adapters as A

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blocks = B.classify(A.blocks(docs.where("doc_id % 2 = 0")))
    config = PipelineConfig(chunk_size=100, chunk_overlap=10)
    for change in (False, True):
        out = api.chunk(blocks, docs.select("doc_id", "text"), config, change_points=change).collect()
        assert {r.doc_id % 2 for r in out} == {0, 1}
        by = {}
        for r in sorted(out, key=lambda r: (r.doc_id, r["index"])):
            assert r["index"] == len(by.setdefault(r.doc_id, [])) and r.end_char - r.start_char == len(r.text)
            by[r.doc_id].append(r.text)
    assert api.chunk(None, docs.select("doc_id", "text"), config).count() > 0


def test_provided_rows_and_failures(spark):

    def tables(row):
        return [{"path": row["path"], "page": i, "md": "| a |", "accuracy": 0.9} for i in range(row["pages"])] if row["pages"] < 5 else 1 / 0

    df = spark.createDataFrame([("a", 2), ("b", 9), ("c", 0)], "path string, pages int")
    got = E.provided(df, tables, "path string, page int, md string, accuracy double").collect()
    assert [(r.path, r.page, r.md) for r in got] == [("a", 0, "| a |"), ("a", 1, "| a |")]
