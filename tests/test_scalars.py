"""Golden facts of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T


def value(spark, f, *args):
    return spark.range(1).select(f(*(F.lit(a) for a in args)).alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [
    ("esta-\nbelecimento", "estabelecimento"), ("configura-\nse", "configura-se"), ("a-\nb", "a-\nb"), ("dis-\n  tante", "distante"), ("diga-\nLHES.", "diga-LHES."), ("ver-\nlona", "verlona"),
])
def test_hyphens(spark, text, want):
    assert value(spark, T.repair_hyphens, text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("x²", "x^{2}"), ("H₂O", "H_2O"), ("x^{2}", "x_{2}"), ("x^2 + y^3", "x^{2} + y^{3}"), ("x23 + y45", "x_{23} + y_{45}"), ("x2", "x2"), ("plain", "plain"), ("(a)12,", "(a)_{12},"), ("abc2021", "abc_{2021}"),
])
def test_math(spark, text, want):
    assert value(spark, T.rebuild_math, text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("9.8 Title", 2), ("1.2.3 Title", 3), ("1 Title", 1), ("I. Intro", 1), ("IV. More", 1), ("B. Part", 2), ("EXERCISE 9.10", 1), ("APPENDIX A", 1), ("chapter 3", 1), ("1 Row 12 34 56", None), ("1. Title", None),
    ("plain text", None), ("3.14", None), ("civil. De", 2), ("C. x", 1), ("3 dias", 1), ("APP. B", 2), ("2 — Fundamentos", 1),
])
def test_heading_levels(spark, text, want):
    assert value(spark, T.heading_level, text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("Continue from your last visit?", True), ("FULLSCREEN", True), ("COPY LINK", True), ("CONTINUE READING", True), ("LINK", True), ("3 / 14", True), ("page 3 OF 14", True),
    ("fullscreen", False), ("LINKS", False), ("3 / 14 apples", False), ("Page three of 4", False), ("", False), ("Please COPY LINK", False),
])
def test_boilerplate(spark, text, want):
    assert value(spark, T.is_boilerplate, text) is want


@pytest.mark.parametrize(("text", "want"), [("- x", "bullet"), ("• x", "bullet"), ("* x", "bullet"), ("1. x", "ordered"), ("a) x", "ordered"), ("A) x", None), ("x", None), ("-x", None)])
def test_lists(spark, text, want):
    assert value(spark, T.list_kind, text) == want


def test_small_ones(spark):
    assert value(spark, T.escape_html, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert value(spark, T.token_count, "ab") == 1 and value(spark, T.token_count, "a" * 31) == 10
    assert value(spark, T.tree_depth, "(a (b) ((c)))") == 3 and value(spark, T.tree_depth, "x") == 0
    assert value(spark, T.drop_page_markers, "see 3/14 here") == "see  here"
    assert value(spark, T.heading_guess, "\n## Big one\ntext") == "Big one" and value(spark, T.heading_guess, "Ends with dot.") is None
    assert value(spark, T.mostly_formatting, "-\n#\n| a |\nlonger text here") is True
    assert value(spark, T.coref_density, "one sentence only") == 0.0
    assert value(spark, lambda a, b: T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), 1, 1) == 0.0
