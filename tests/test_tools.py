"""The six document tools over a provider whose answers are fixed."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import providers as P
from paperloom.plans import tools


def test_unread_answers_have_a_defined_result(spark):
    rows = [(1, None), (2, ""), (3, "no json"), (4, "{broken}"), (5, 'x {"category": "fatura", "confidence": 1} y'), (6, "{}")]
    df = spark.createDataFrame(rows, "id long, answer string")
    got = {r.id: tuple(r.c) for r in df.select("id", tools.read_category(F.col("answer")).alias("c")).collect()}
    unread = (tools.UNREAD_CATEGORY, 0.0, tools.UNREAD_REASON)
    assert got == {1: unread, 2: unread, 3: unread, 4: unread, 5: ("fatura", 1.0, None), 6: (None, None, None)}
    got = {r.id: (r.e.entities, r.e.error is None, r.e.raw) for r in df.select("id", tools.read_entities(F.col("answer")).alias("e")).collect()}
    assert got[3] == (None, False, "no json") and got[5] == ({"category": "fatura", "confidence": "1"}, True, None) and got[6] == ({}, True, None)


def test_contents_indent_by_level_and_stop_at_the_cap(spark):
    rows = [(1, i, 1 + i % 3, f" heading {i} ") for i in range(5)] + [(2, 0, 0, "x" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, level int, text string")
    got = {r.doc_id: r.toc for r in tools.contents(df, cap=4).collect()}
    assert got == {1: "- heading 0\n  - heading 1\n    - heading 2\n- heading 3", 2: "- " + "x" * 80}


def test_every_text_gets_an_answer(spark):
    texts = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    heads = spark.createDataFrame([(1, 0, 1, "Title")], "doc_id long, block_no int, level int, text string")
    assert sorted(r.doc_id for r in tools.summarize(texts, heads).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in tools.classify(texts).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in tools.entities(texts, schema='{"a": "b"}').collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="style"):
        tools.summarize(texts, heads, style="song")


def test_unknown_tool_is_an_error():
    with pytest.raises(ValueError, match="unknown tool"):
        P.Tools().call("paint_document")


def test_all_tools_answer(spark):
    from paperloom.plans.queries_tools import document_tool_results

    tools_seen = {r.tool for r in document_tool_results(spark, "/root/testdata/sf0.001").select("tool").distinct().collect()}
    assert tools_seen == {"search_document", "summarize_document", "classify_document", "analyze_document", "extract_structure", "map_arguments"}


def test_boundary_intervals_cover_the_truth(spark):
    from paperloom.operators import analysis as X

    rows = spark.range(3000).select("id", (F.rand(5) * 10).alias("x"))
    rows = rows.withColumn("label", (F.col("x") + F.randn(7) > 5).cast("double")).withColumn("part", F.expr("array('train', 'calibrate', 'judge')[cast(id % 3 as int)]"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, 1.0, "judge"), (-2, None, None, "train")], "id long, x double, label double, part string")).cache()
    got = {r.id: r for r in X.boundary_intervals(rows, ["x"], "label", "part", 0.9).collect()}
    assert len(got) == 3002 and got[-1].estimate is None and got[-2].lower is None
    judged = [r for r in got.values() if r.part == "judge" and r.estimate is not None]
    assert sum(r.lower <= r.label <= r.upper for r in judged) / len(judged) > 0.85
    assert all((r.estimate > 0.5) == (r.x > 5) for r in judged if abs(r.x - 5) > 1)


def test_boundary_intervals_without_a_model(spark):
    from paperloom.operators import analysis as X

    shape = "id long, x double, label double, part string"
    one = spark.createDataFrame([(1, 1.0, 1.0, "train"), (2, 2.0, 1.0, "train"), (3, 3.0, None, "judge")], shape)
    assert [(r.estimate, r.upper) for r in X.boundary_intervals(one, ["x"], "label", "part").orderBy("id").collect()] == [(1.0, float("inf"))] * 3
    assert X.boundary_intervals(spark.createDataFrame([], shape), ["x"], "label", "part").count() == 0
