import oracle
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import analysis as X
from paperloom.operators import blocks as B
from paperloom.plans import catalogue
from paperloom.sources import adapters as A

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_rules_are_judged_once(spark):
    plan = optimized(catalogue.QUERIES["noise_filter"](spark, SF))
    assert plan.count("folha") == 1  # the page label's pattern
    assert plan.count("RepartitionByExpression") == 1  # of the blocks alone, not of what is summed up from them


def test_rules_take_any_white_space(spark):
    texts = ["1.2\n\tTitle", " IV.\x0b x", "RESULTS\n\n  AND\tMORE " + "\n" * 40 + "TEXT", "Abstract\f", "12  Abc 34 x", "12 Abc\n34 x", "a", "A\n\nB", "Introduction\nof", "", "ABC" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t, c = F.col("_t"), T.collapse(F.col("_t"))
    known = B.text_rules(df)
    level = F.coalesce(T.heading_level(t), T.heading_level(c))
    out = known.select(F.col("_level").eqNullSafe(level) & (F.col("_common") == T.is_common_heading(t)) & (F.col("_caps") == (T.is_short_caps(t) | T.is_short_caps(c)))).collect()
    assert [r[0] for r in out] == [True] * len(texts)
    assert [r[0] for r in known.select(t).collect()] == [x.strip(" \t\n\x0b\f\r") for x in texts]


def test_edges_of_pages(spark):
    rows = [(1, p, 10 * p + i, t) for p in range(4) for i, t in enumerate(["Same header ", f"body {p}", "Same footer"])] + [(1, 4, 50, "Alone line"), (1, None, 60, "no page")]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_no int, text string")
    found = lambda **k: {tuple(r) for r in B.frequent_edges(df, 0.5, **k).collect()}
    assert found(trim=True, least_per_page=2) == {(1, "header", "Same header", 4), (1, "footer", "Same footer", 4)}
    assert found(trim=False) == {(1, "header", "Same header ", 4), (1, "footer", "Same footer", 4)}


def test_break_positions_step_from_mark_to_mark(spark):
    from paperloom.operators import analysis as X

    def slow(tree, n):
        d, run, out = 0, 0, set()
        for c in tree:
            d += {"(": 1, ")": -1}.get(c, 0)
            if d <= 1 and c in ".!?" and 5 < run < n - 5:
                out.add(run)
            run = 0 if c == ")" else run + 1
        return sorted(out) or [n]

    trees = ["", "plain", "(S one two. three! four (C five. six.) seven? eight nine)", "a.\nb.c...d.e.f.g.h.i.j.k", "((((x. y. z. w.))))x. abcdefgh. ijklmnop", ")" * 9 + "éééééé. êêêêêêêê. x", "no mark " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(trees)], "i long, t string")
    got = {r.i: r.b for r in df.select("i", X.break_positions(F.col("t"), F.length("t")).alias("b")).collect()}
    assert got == {i: slow(t, len(t)) for i, t in enumerate(trees)}
    plan = optimized(df.select(X.break_positions(F.col("t"), F.length("t"))))
    assert "split(t#" in plan and ", , -1)" not in plan  # no step for each character


def test_window_costs_of_documents(spark):
    from paperloom.operators import chunks as C
    import numpy as np

    rows = [(d, i, float((i * 7 + (d or 3)) % 5 + 1), float(i % 3)) for d in (1, 2, None, 2**60 + 1, 2**60 + 2) for i in range(d % 5 + 4 if d else 9)]
    df = spark.createDataFrame(rows, "doc_id long, i int, a double, b double").repartition(4)
    got = {r.doc_id: r.cost for r in C.wasserstein_costs(df, "i", ["a", "b"]).collect()}
    x = {d: np.array([r[2:] for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    assert got == {d: C.wasserstein_cost(v, len(v)) for d, v in x.items()}
    assert C.wasserstein_costs(df.limit(0), "i", ["a", "b"]).count() == 0


def test_a_batch_holds_many_read_files(spark):
    from paperloom.sources import extract as E

    rows = E.read_batch([("a", 0, 1, None, None, [], [], [(None, "bad")]), ("b", 0, 1, 2, {"k": "v"}, [(0, 1, 0, 0, "t", 11, None)], [(0, "u", 0.0, 0.0, 1.0, 1.0)], [])])
    assert rows.num_rows == 2 and rows["spans"].to_pylist()[1][0]["size"] == 11.0 and rows["metadata"].to_pylist() == [None, [("k", "v")]]


def test_spans_are_shuffled_once(spark):
    from paperloom.sources import extract as E

    rows = [("a", 0, 0, 1, 1, "two", 9.0, "B"), ("a", 0, 0, 1, 0, "one ", 8.04, "A"), ("a", 0, 0, 2, 0, None, 7.0, "C"), ("a", 0, 0, 3, 0, "end", 6.0, "D"), ("a", 0, 0, None, 5, "top", 5.0, "N"), ("a", 0, 1, 0, 0, " ", 5.0, "N")]
    df = spark.createDataFrame(rows, "path string, page int, block_no int, line_no int, span_no int, text string, size double, font string")
    out = E.span_blocks(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in out.collect()] == [("a", 0, 0, "top\none two\n\nend", 5.0, "N", 16)]


def test_span_blocks_equals_sql_on_blank_and_repeated_documents(spark, tmp_path):
    texts = ["", None, "a", "a\n\n\nb  c", "\n\n\n", " \n\t\n x ", "\x0b a b\x0b", "a\r\nb\r\n", "\x85é 😀 x\x85\ny", "same a b\nline two", "same a b\nline two"]
    rows = [(None if i == 2 else min(i, 9), t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    for name in oracle.TABLES:
        if name != "documents":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert oracle.compare(spark, str(tmp_path), catalogue.QUERIES["span_blocks"], catalogue.ORACLES["span_blocks"]) is None


def test_runs_that_meet_are_taken_apart(spark):
    from paperloom.sources import extract as E

    row = lambda line, n, text, copy=0, size=9.0: ("a", 0, 0, line, n, text, size, "A", copy)
    rows = [row(0, 0, "é "), row(0, 1, "b "), row(0, 2, ""), row(0, 5, "f "), row(0, 3, "😀 "), row(0, 4, "e "), row(1, 0, "x "), row(1, 1, "y"), row(1, 1, "z"), row(1, 0, "w ", size=1.0), row(2, 3, "m", 1), row(2, 3, "n", 0), row(2, None, "k", 0)]
    df = spark.createDataFrame(rows, "path string, page int, block_no int, line_no int, span_no int, text string, size double, font string, copy int")
    assert E.span_runs(df.coalesce(1), ["path", "page", "block_no", "line_no"]).select("text", "ends").collect()[0] == ("é b ", [2, 4, 4])
    for parts in (1, 8):
        got, = E.span_blocks(df.repartition(parts) if parts > 1 else df.coalesce(1)).collect()
        assert (got.text, got.n_chars, got.font_size) == ("é b 😀 e f \nw x yz\nkmn", 21, 9.0)
        got, = E.span_blocks(df.repartition(parts) if parts > 1 else df.coalesce(1), copy="copy").collect()
        assert got.text == "é b 😀 e f \nw x yz\nkn\nm"
    blank = spark.createDataFrame([("a", 0, 1, 0, 0, " ", 5.0, "N")], E.SPANS)
    assert E.span_blocks(blank).count() == 0 and [(r.text, r.n_chars) for r in E.span_blocks(blank, strip=False).collect()] == [(" ", 1)]


def test_depth_reads_the_blocks_once(spark):
    plan = optimized(catalogue.QUERIES["depth_contains_join"](spark, SF))
    assert plan.count("RepartitionByExpression") == 1


def planned(spark, df):
    """How often the plan of ``df`` hashes whole blocks by document, and by anything with a text, where nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    return sum("REPARTITION_BY_COL" in x for x in exchanges), sum("_t#" in x or "strip" in x or "k#" in x for x in exchanges)


def small_blocks(spark):
    return A.blocks(spark.createDataFrame([(1, "a b\nc d", "s"), (2, "e", "s")], "doc_id long, text string, source string"))


def test_structure_classifies_and_hashes_blocks_once(spark):
    made = X.structure(B.classify(small_blocks(spark)))
    assert planned(spark, made) == (1, 0)
    rows = [(1, "heading", True, 1.0), (1, "paragraph", False, -0.0), (1, "paragraph", None, 0.0), (2, "paragraph", None, None)]
    got = X.structure(spark.createDataFrame(rows, "doc_id long, layout_type string, is_heading boolean, font_size double")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 2, {"heading": 1, "paragraph": 2}), (2, None, 0, 0, {"paragraph": 1})]
