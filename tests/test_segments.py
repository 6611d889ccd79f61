"""Change-point segments and safe breaks against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import blocks as B
from paperloom.operators import chunks as C
from paperloom.sources import adapters as A

SF = "/root/testdata/sf0.001"


def best_cuts(x, penalty, least=5):
    """Ends of the segments of least total cost, by trying every last segment."""
    n = len(x)
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum())
    best, back = [-penalty] + [np.inf] * n, [0] * (n + 1)
    for t in range(least, n + 1):
        for s in range(t - least + 1):
            if best[s] < np.inf and (c := best[s] + cost(s, t) + penalty) < best[t] - 1e-9:
                best[t], back[t] = c, s
    ends, t = [], n
    while t:
        ends.append(t)
        t = back[t]
    return sorted(ends), best[n], cost


def test_words_are_hashed_once(spark):
    units = spark.createDataFrame([(1, 0, "some words of a unit that counts")], "doc_id long, unit_no int, text string")
    plan = C.unit_features(units)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_change_points_equal_exhaustive_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    units = C.unit_features(C.units_of(docs)).orderBy("doc_id", "unit_no").collect()
    by: dict[int, list] = {}
    for r in units:
        by.setdefault(r.doc_id, []).append(r)
    got: dict[int, list] = {}
    for r in sorted(C.change_points(C.unit_features(C.units_of(docs)), least_units=5).collect(), key=lambda r: (r.doc_id, r.seg_no)):
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d for d, rows in by.items() if len(rows) >= 5}
    seen = 0
    for d, segments in got.items():
        rows = by[d]
        if len(rows) > 120:
            continue
        seen += 1
        x, n = np.array([r.features for r in rows]), len(rows)
        ends, _, _ = best_cuts(x, 0.02 * n)
        penalty = 0.02 * n * (0.3 if len(ends) < 3 else 2 if len(ends) > 100 else 1)
        _, least, cost = best_cuts(x, penalty)
        cuts = [0, *np.cumsum([s.n_units for s in segments]).tolist()]
        assert cuts[-1] == n
        assert sum(cost(a, b) + penalty for a, b in zip(cuts, cuts[1:], strict=False)) - penalty == pytest.approx(least)
        at = 0
        for i, s in enumerate(segments):
            assert s.text == " ".join(r.text for r in rows[cuts[i] : cuts[i + 1]])
            assert (s.start_char, s.end_char) == (at, at + len(s.text))
            at = s.end_char
            spread = x[cuts[i] : cuts[i + 1]].var(axis=0).mean()
            edge = i in (0, len(segments) - 1)
            assert s.confidence == pytest.approx(1.0 if edge else min(1.0, max(0.1, 1 / (1 + spread))))
    assert seen > 20


def looks_back(spark, texts):
    t = F.col("t")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", ((F.size(T.matches(t, T.ANAPHORA)) > 0) | T.starts_looking_back(t)).alias("b"))
    return {r.i for r in rows.collect() if r.b}


def test_segments_keep_offsets_and_confidence_through_both_joins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    blocks = B.classify(A.blocks(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")))
    points = sorted(C.change_points(C.unit_features(C.units_of(docs)), least_units=5).collect(), key=lambda r: (r.doc_id, r.seg_no))
    back = looks_back(spark, [r.text for r in points])
    unsafe_at = {(r.doc_id, r.start_char) for r in points if r.start_char and r.doc_id % 2}
    sentences = spark.createDataFrame([(d, at - 8, "0123456.89 trailing words", "(S 0123456.89 trailing words)") for d, at in unsafe_at], "doc_id long, start long, text string, tree string")
    for trees in (None, sentences):
        want, last = [], None
        for i, r in enumerate(points):
            joined = last is not None and last[0] == r.doc_id
            if joined and trees is not None and (r.doc_id, r.start_char) in unsafe_at:
                last[1:4] = [last[1] + "\n\n" + r.text, r.end_char, last[3] + r.n_units]
                continue
            last = [r.doc_id, r.text, r.end_char, r.n_units, r.start_char, r.confidence, i]
            want.append(last)
        again = []
        for w in want:
            if trees is None and w[6] in back and again and again[-1][0] == w[0]:
                again[-1][1:4] = [again[-1][1] + "\n\n" + w[1], w[2], again[-1][3] + w[3]]
            else:
                again.append(w)
        got = C.change_point_segments(docs, blocks, sentences=trees).collect()
        assert {r.method for r in got} == {"bcpd_pelt"}
        rows = sorted((r.doc_id, r.start_char, r.end_char, r.n_units, round(r.confidence, 6), r.text) for r in got)
        if trees is None:
            assert rows == sorted((w[0], w[4], w[2], w[3], round(w[5], 6), w[1]) for w in again)
        else:  # joined at every unsafe break, and at others only by looking back
            assert not {(r[0], r[1]) for r in rows} & unsafe_at
            assert {(r[0], r[1]) for r in rows} <= {(w[0], w[4]) for w in want}


def plain_breaks(tree, size):
    """Sentence marks at depth one or less, as characters after the last closing bracket."""
    out, depth = set(), 0
    for i, c in enumerate(tree):
        depth += (c == "(") - (c == ")")
        if depth <= 1 and c in ".!?" and 5 < (at := len(tree[:i].split(")")[-1])) < size - 5:
            out.add(at)
    return sorted(out) or [size]


def test_safe_breaks_equal_a_plain_search(spark):
    texts = ["A first sentence, short. It goes on! And ends here now.", "x", "", "No marks at all in this long sentence of words, none", "w. " * 150]
    trees = [f"(S {re.sub(',([^,]*)', r',(C\\1)', t)})" for t in texts]
    sentences, at = [], 0
    for i, (t, tree) in enumerate(zip(texts, trees, strict=True)):
        sentences.append((1, at, t, None if i == 1 else tree))
        at += len(t) + 1
    asked = [(1, p) for p in range(0, at + 5)] + [(2, 30), (1, 7)]
    got = C.safe_breaks(spark.createDataFrame(asked, "doc_id long, at int"), spark.createDataFrame(sentences, "doc_id long, start int, text string, tree string"), window=50).collect()
    assert len(got) == len(asked)
    for r in got:
        safe, moved = True, r.at
        for d, start, t, tree in sentences:
            if d == r.doc_id and tree and start < r.at < start + len(t):
                breaks = plain_breaks(tree, len(t))
                safe = all(abs(b - (r.at - start)) >= 5 for b in breaks)
                moved = start + min([b for b in breaks if b > r.at - start], default=len(t))
        assert (r.safe, r.moved) == (safe, moved), r


def test_change_points_are_searched_once(spark):
    """The depth of a segment comes from its document's headings without the segments being made anew."""
    texts = spark.createDataFrame([(1, "\n".join(f"a line of some length {i}" for i in range(9)))], "doc_id long, text string")
    heads = spark.createDataFrame([(1, 5, True, " length ", 3), (1, 2, True, "line", 2), (1, 9, True, None, 1), (1, 0, False, "a", 1)], "doc_id long, block_no int, is_heading boolean, text string, heading_level int")
    out = C.change_point_segments(texts, heads)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r.depth for r in out.where("seg_no = 0").collect()] == [2]


def test_reference_back_without_names(spark):
    rows = [(1, 0, "Este"), (1, 1, "O_casa (mesmo) dia"), (1, 2, "nothing, here"), (1, 3, "todavia x"), (2, 0, None), (2, 1, "tal"), (2, 2, "cujos-9"), (2, 3, "estes9")]
    got = C.at_risk(spark.createDataFrame(rows, "doc_id long, seg_no long, text string"), "seg_no").orderBy("doc_id", "seg_no").collect()
    assert [bool(r.at_risk) for r in got] == [False, True, False, True, False, False, True, False]


def test_safe_breaks_shuffle_breaks_and_pieces_once(spark):
    """Overlapping sentences and equal breaks too; neither texts nor a sentence's list of breaks travel."""
    text = "One sentence here. " * 40
    sentences = spark.createDataFrame([(1, 0, text, text), (1, 300, "x" * 100 + ". " + "y" * 50, "x" * 100 + ". " + "y" * 50), (None, 0, text, text)], "doc_id long, start int, text string, tree string")
    asked = spark.createDataFrame([(1, 390)] * 3 + [(1, 450), (1, 0), (1, len(text)), (None, 17)], "doc_id long, at long")
    out = C.safe_breaks(asked, sentences)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(shuffles) == 2
    got = sorted(((r.doc_id or 0, r.at, r.safe, r.moved) for r in out.collect()))
    breaks = [i for i, c in enumerate(text) if c == "." and i < len(text) - 5]
    moved = lambda at, later: min([b for b in breaks if b > at] + [later])
    near = lambda at: any(abs(b - at) < 5 for b in [*breaks, 400])
    want = [(1, 390, not near(390), moved(390, 400))] * 3 + [(1, 450, not near(450), moved(450, 452)), (1, 0, True, 0), (1, len(text), True, len(text)), (0, 17, True, 17)]
    assert got == sorted(want)


def test_tree_breaks_equal_break_positions(spark):
    from paperloom.operators import analysis as X

    trees = ["", "plain", None, "(S one two. three! four (C five. six.) seven? eight nine)", "((((x. y. z. w.))))x. abcdefgh. ijklmnop", ")" * 9 + "éééééé. 🙂êêêêêêê. xyzxyz", "a sentence. " * 400, "(((" * 5]
    rows = [(i, t, n) for i, t in enumerate(trees) for n in (len(t or ""), 30, None)]
    df = spark.createDataFrame(rows, "i long, t string, n int").coalesce(1)
    got = df.select(X.break_positions(F.col("t"), F.col("n")).alias("a"), X.tree_breaks(F.col("t"), F.col("n"), 50).alias("b")).collect()
    assert len(got) == len(rows)
    assert [r.a for r in got] == [r.b for r in got]
