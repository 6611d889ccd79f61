"""Structure reports, blocks inside tables, links of files, and intervals of each group, against brute force."""

import math
import random
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from paperloom.operators import analysis as X
from paperloom.operators import blocks as B
from paperloom.plans import queries_reports as R
from paperloom.plans import tools
from paperloom.sources import extract as E

BLOCK = "doc_id long, block_no int, page int, type string, text string, font string, layout_type string, is_heading boolean"


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_larger_tables_equal_sql_and_have_rows(spark, name):
    assert oracle.compare(spark, "/root/testdata/sf0.01", R.QUERIES[name], R.ORACLES[name]) is None


def test_report_of_odd_documents(spark):
    rows = [
        (1, 0, 0, "text", " Title\nmore ", "A", "heading", True), (1, 1, 0, "text", "body", "B", "paragraph", False), (1, 2, 1, "image", None, None, None, False),
        (1, 3, 1, "text", "more", "A", None, False), (1, 4, 1, "text", "FULLSCREEN", "C", "heading", True), (1, 5, 1, "text", "lost", "B", "paragraph", False),
        (2, 0, 0, "text", None, None, None, False), (3, 0, 0, "image", None, None, None, False),
    ]
    b = spark.createDataFrame(rows, BLOCK)
    heads = b.where("is_heading").select("doc_id", "block_no", F.lit(None).cast("int").alias("level"), "text", "page")
    tables = spark.createDataFrame([(1, k, f"| {k} |\n| x |\n" if k else None) for k in range(25)], "doc_id long, k int, md string")
    links = spark.createDataFrame([(1,), (1,), (9,)], "doc_id long")
    got = {r.doc_id: r for r in tools.structure_report(b, heads, tables, links=links).collect()}
    one = got[1]
    assert set(got) == {1, 2, 3}
    assert [tuple(h) for h in one.toc] == [(0, "Title", 0)]
    assert [tuple(x)[1:] for x in one.sections] == [("Title", 0, 8, 2)]
    assert [tuple(x) for x in one.layout] == [("heading", 2), ("paragraph", 2), ("unknown", 1)]
    assert [tuple(x) for x in one.fonts] == [("A", 2), ("B", 2), ("C", 1)]
    assert [tuple(x) for x in one.tables] == [(0, 1, "")] + [(k, 2, f"| {k} |\n| x |\n") for k in range(1, 20)]
    assert (one.quality, one.n_annotations, one.n_links) == (None, 0, 2)
    assert got[3].toc == got[3].sections == got[3].layout == got[3].fonts == got[3].tables == [] and got[3].n_links == 0
    bare = tools.structure_report(b, heads).where("doc_id = 1").first()
    assert bare.tables == [] and bare.n_links == 0 and bare.toc == one.toc
    assert tools.structure_report(b.limit(0), heads.limit(0), tables.limit(0)).count() == 0


def test_blocks_inside_regions_stay_one_row(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 90.0, 90.0, 99.0, 99.0), (1, 2, 1, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, None, None, None, None)], "doc_id long, block_no int, page int, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 50.0), (1, 0, 4.0, 4.0, 6.0, 6.0), (1, 1, None, 0.0, 50.0, 50.0), (2, 0, 0.0, 0.0, 9.0, 9.0), (5, 0, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double")
    got = [(r.doc_id, r.block_no, r.inside_table) for r in B.mark_inside(blocks, regions).orderBy("doc_id", "block_no").collect()]
    assert got == [(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, False)]
    assert B.mark_inside(blocks, regions.limit(0)).where("inside_table").count() == 0


def test_links_come_with_the_spans_of_one_pass(spark):
    class Linked(E.TextFile):
        lines = 1

        def links(self, page):
            if self.text[page] == "bad":
                raise RuntimeError("bad links")
            return [{"uri": w, "box": (i, page, i + 1, page + 1)} for i, w in enumerate(self.text[page].split()) if w.startswith("http")] + [{}] * (self.text[page] == "empty")

    files = spark.createDataFrame([("a", 60, b"see http://x and http://y\nnone\nempty"), ("b", 9, b"bad\nhttp://z"), ("c", 7, b"%broken")], "path string, length long, content binary")
    read = E.read_documents(files, Linked, share_bytes=20).cache()
    got = sorted(tuple(r) for r in E.links_of(read).collect())
    assert got == [("a", 0, "http://x", 1.0, 0.0, 2.0, 1.0), ("a", 0, "http://y", 3.0, 0.0, 4.0, 1.0), ("a", 2, "", 0.0, 0.0, 0.0, 0.0), ("b", 1, "http://z", 0.0, 1.0, 1.0, 2.0)]
    assert sorted((r.path, r.page) for r in E.failures_of(read).collect()) == [("b", 0), ("c", None)]
    assert {r.page for r in E.spans_of(read).where("path = 'b'").collect()} == {1}
    assert E.links_of(E.read_documents(files, E.TextFile)).count() == 0


def test_intervals_of_each_group(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.random() if rng.random() < 0.7 else None, rng.random()) for i in range(400)]
    rows += [(1000, "c", 0.5, 0.5), (1001, "c", None, 0.2), (1002, None, None, 0.5), (1003, "a", None, None)]
    got = {r.id: r for r in X.conformal_by(spark.createDataFrame(rows, "id long, g string, truth double, estimate double"), ["g"], 0.8).collect()}
    assert len(got) == len(rows)
    errors = defaultdict(list)
    for _, g, t, e in rows:
        if t is not None and e is not None:
            errors[g].append(math.ceil(abs(t - e) * 10_000) / 10_000)
    for i, g, t, e in rows:
        k = math.ceil(round((len(errors[g]) + 1) * 0.8, 9))
        width = sorted(errors[g])[k - 1] if k <= len(errors[g]) else math.inf
        r = got[i]
        if e is None:
            assert r.lower is None and r.upper is None
        else:
            assert r.upper == pytest.approx(e + width) and r.lower == pytest.approx(e - width)
    held = [got[i] for i, g, t, _ in rows if t is not None and g in "ab"]
    assert sum(r.lower <= r.truth <= r.upper for r in held) / len(held) >= 0.8


def test_segments_without_a_model_are_half_sure(spark):
    shape = "doc_id long, seg_no int, text string, label double, part string"
    rows = [(1, 0, "one", 1.0, "judge"), (1, 1, None, None, "judge"), (2, 0, "", 0.0, "train")]
    for part, want in ((rows[:2], None), (rows, 0.0)):
        got = X.judged_segments(spark.createDataFrame(part, shape), "label", "part").collect()
        assert {(r.estimate, r.uncertainty, r.confidence) for r in got} == {(want, 0.5, 0.5)} and len(got) == len(part)
    assert X.judged_segments(spark.createDataFrame([], shape), "label", "part").count() == 0
