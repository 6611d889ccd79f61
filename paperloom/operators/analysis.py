"""Row grouping, safe breaks, confidence, conformal intervals, and document-level analyses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks as B
from . import chunks as C


def row_groups(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, row): blocks by height, each joining the first open row whose anchor it overlaps vertically."""
    key = F.struct("y0", "x0", "block_no", "y1", "x1")
    held = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(key)).alias("b"))
    state = F.struct(F.array().cast("array<struct<y0:double,y1:double>>").alias("anchors"), F.array().cast("array<struct<block_no:int,row:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(a["anchors"], lambda r: F.least(r["y1"], x["y1"]) > F.greatest(r["y0"], x["y0"])), True).cast("int")
        new = hit == 0
        row = F.when(new, F.size(a["anchors"])).otherwise(hit - 1)
        anchors = F.when(new, F.array_append(a["anchors"], F.struct(x["y0"].alias("y0"), x["y1"].alias("y1")))).otherwise(a["anchors"])
        return F.struct(anchors.alias("anchors"), F.array_append(a["out"], F.struct(x["block_no"].alias("block_no"), row.alias("row"))).alias("out"))

    rows = held.select("doc_id", "page", F.explode(F.aggregate("b", state, step, lambda a: a["out"])).alias("r"))
    return rows.select("doc_id", "page", "r.block_no", "r.row")


def two_columns(blocks: DataFrame, least: float = 15.0) -> DataFrame:
    """(doc_id, page, block_no, pos): pages with gaps inside rows read as two columns, split at the upper median right edge before a gap."""
    rows = blocks.join(row_groups(blocks), ["doc_id", "page", "block_no"])
    w = Window.partitionBy("doc_id", "page", "row").orderBy("x0", "block_no")
    gap = rows.withColumn("next", F.lead("x0").over(w)).where(F.col("next") - F.col("x1") > least)
    split = gap.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x1")).alias("g"))
    split = split.select("doc_id", "page", F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1).alias("split"))
    page = Window.partitionBy("doc_id", "page")
    out = blocks.join(split, ["doc_id", "page"], "left").withColumn("n", F.count("*").over(page))
    side = F.when(F.col("split").isNull() | (F.col("n") < 3), 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("split"), 0).otherwise(1)
    height = F.when(F.col("split").isNull() | (F.col("n") < 3), F.col("block_no").cast("double")).otherwise(F.col("y0"))
    return out.withColumn("side", side).withColumn("h", height).select("doc_id", "page", "block_no", (F.row_number().over(page.orderBy("side", "h", "block_no")) - 1).alias("pos"))


def break_positions(tree: Column, length: Column) -> Column:
    """Character positions of sentence marks outside nested brackets of a printed parse tree; the length if there are none.

    The fold takes a step for each mark or bracket, with the plain characters before it, not for each character.
    """
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        c = F.right(x, F.lit(1))
        d, at = a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0), a["run"] + F.length(x) - 1
        ok = (d <= 1) & c.isin(".", "!", "?") & (at > 5) & (at < length - 5)
        return F.struct(d.alias("d"), F.when(c == ")", 0).otherwise(at + 1).alias("run"), F.when(ok, F.array_append(a["out"], at)).otherwise(a["out"]).alias("out"))

    found = F.array_sort(F.array_distinct(F.aggregate(F.split(tree, "(?<=[().!?])"), state, step, lambda a: a["out"])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(length))


def breaks_of(trees: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """`break_positions` of many trees at once, on their bytes end to end; a null tree has no marks, a length below 0 is null."""
    trees = trees.cast(pa.large_binary())
    if trees.null_count:
        trees = trees.fill_null(b"")
    offsets = np.frombuffer(trees.buffers()[1], np.int64)[trees.offset : trees.offset + len(trees) + 1]
    held = trees.buffers()[2]
    text = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = np.zeros(256, np.int8)
    kinds[list(b"().!?")] = 1, 2, 3, 3, 3
    at = np.flatnonzero(kinds[text])
    kind = kinds[text[at]]
    place, begins = at, offsets[:-1]
    if len(text) and text.max() > 127:  # characters, not bytes
        chars = np.append(0, np.cumsum((text & 0xC0) != 0x80))
        place, begins = chars[at], chars[begins]
    row = np.repeat(np.arange(len(trees)), np.diff(np.searchsorted(at, offsets)))
    depth = np.append(0, np.cumsum((kind == 1).astype(np.int64) - (kind == 2)))
    depth = depth[1:] - depth[np.searchsorted(at, offsets[:-1])][row]
    closed = np.maximum.accumulate(np.where(kind == 2, place, -1)) if len(at) else at
    run = place - np.maximum(closed, begins[row] - 1) - 1
    ok = (kind == 3) & (depth <= 1) & (run > 5) & (run < lengths[row] - 5)
    found = np.unique(row[ok] << 32 | run[ok])
    counts = np.bincount(found >> 32, minlength=len(trees))
    none = counts == 0
    firsts = np.cumsum(counts) - counts
    values = np.insert(found & 0xFFFFFFFF, firsts[none], lengths[none])
    ends = np.append(0, np.cumsum(np.maximum(counts, 1))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32), mask=values < 0))


def tree_breaks(tree: Column, length: Column, size: int = 4_000_000) -> Column:
    """`break_positions` in Arrow batches, for large tables; trees of about ``size`` bytes, or one longer, are read at a time."""

    @F.arrow_udf("array<int>")
    def read(trees: pa.Array, lengths: pa.Array) -> pa.Array:
        sizes = lengths.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.fill_null(pc.binary_length(trees), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out, lo = [], 0
        while lo < len(trees):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            out.append(breaks_of(trees.slice(lo, hi - lo), sizes[lo:hi]))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return read(tree, length.cast("int"))


def nearest_break(breaks: Column, proposed: Column, length: Column) -> Column:
    """The smallest break after ``proposed``, or the text's end."""
    return F.coalesce(F.array_min(F.filter(breaks, lambda b: b > proposed)), length)


def segment_confidence(units: DataFrame, features: list[str]) -> DataFrame:
    """(doc_id, seg_no, confidence): 1 at a document's edges, else 1 / (1 + mean variance of the features), within 0.1 and 1."""
    mean_var = sum((F.var_pop(f) for f in features), F.lit(0.0)) / len(features)
    s = units.groupBy("doc_id", "seg_no").agg(F.count("*").alias("n"), mean_var.alias("v"))
    doc = Window.partitionBy("doc_id")
    s = s.withColumn("last", F.max("seg_no").over(doc))
    inner = F.when(F.col("n") >= 2, F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1 / (1 + F.col("v"))))).otherwise(0.8)
    return s.select("doc_id", "seg_no", F.when((F.col("seg_no") <= 0) | (F.col("seg_no") >= F.col("last")), 1.0).otherwise(inner).alias("confidence"))


def conformal(scored: DataFrame, confidence: float = 0.9) -> DataFrame:
    """``scored`` (truth or null, estimate) with lower and upper: the estimate plus or minus the split-conformal quantile of calibration errors.

    Rows with a truth calibrate. The quantile is approximate to one part in 10,000 of the rank, so its cost is one pass.
    """
    cal = scored.where("truth is not null")
    n = cal.count()
    rank = min(1.0, (n + 1) * confidence / n) if n else 1.0
    q = cal.agg(F.percentile_approx(F.abs(F.col("truth") - F.col("estimate")), rank, 10_000).alias("q")).first()["q"] if n else None
    width = F.lit(float("inf") if q is None else float(q))
    return scored.withColumn("lower", F.col("estimate") - width).withColumn("upper", F.col("estimate") + width)


def conformal_by(scored: DataFrame, by: list[str], confidence: float = 0.9, digits: int = 4) -> DataFrame:
    """``scored`` (truth or null, estimate) with lower and upper: an interval of its own for each group of ``by``.

    Rows with a truth calibrate their group: its width is the k-th smallest error, k = ceil((n + 1) * confidence), errors
    rounded up to ``digits`` digits, so that the promised cover holds. Groups without rows enough have infinite intervals,
    rows with a null estimate null ones; nulls in ``by`` are a group. Errors are counted by value before they are ordered:
    a group's window has one row a distinct error (10,001 for chances), however many rows it has, and nothing is collected.
    """
    error = F.ceil(F.abs(F.col("truth") - F.col("estimate")) * 10**digits)
    seen = scored.where("truth is not null and estimate is not null").groupBy(*by, error.alias("_e")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_e").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    # ceil of a product that is whole in decimals must not be raised by its binary rounding
    rank = F.ceil(F.round((F.col("_n") + 1) * confidence, 9))
    widths = seen.where(F.col("_upto") >= rank).groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg((F.min("_e") / 10**digits).alias("_w"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & scored[c].eqNullSafe(widths[f"_g{i}"])
    out = scored.join(widths, same, "left").withColumn("_w", F.coalesce("_w", F.lit(float("inf"))))
    out = out.withColumn("lower", F.col("estimate") - F.col("_w")).withColumn("upper", F.col("estimate") + F.col("_w"))
    return out.drop("_w", *[f"_g{i}" for i in range(len(by))])


def segment_features(segments: DataFrame, order: str = "seg_no") -> DataFrame:
    """``segments`` with chars, words and inner: the length over 500, the words over 100, and whether a segment stands before it."""
    text = F.lower(F.coalesce("text", F.lit("")))
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) > 1
    size = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return segments.withColumn("chars", F.length(text) / 500.0).withColumn("words", size / 100.0).withColumn("inner", before.cast("int"))


def segment_uncertainty(scored: DataFrame) -> DataFrame:
    """``scored`` (lower, upper) with uncertainty and confidence: the interval's width up to 1, and what is left of 1.

    Without an interval (null or infinite) both are 0.5, as nothing is known.
    """
    width = F.col("upper") - F.col("lower")
    known = width.isNotNull() & ~F.isnan(width) & (width < float("inf"))
    doubt = F.round(F.when(known, F.least(F.lit(1.0), width)).otherwise(0.5), 4)
    trust = F.round(F.when(known, F.greatest(F.lit(0.0), 1 - width)).otherwise(0.5), 4)
    return scored.withColumn("uncertainty", doubt).withColumn("confidence", trust)


def judged_segments(segments: DataFrame, label: str, part: str, confidence: float = 0.9, step: float = 0.1, order: str = "seg_no") -> DataFrame:
    """``segments`` (doc_id, order, text) with estimate, lower, upper, uncertainty and confidence of ``label`` (0, 1 or null).

    The estimate is the mean label of the 'train' rows of like length, words and place (cells of ``step``), or of all of
    them where the cell has none, or null where there is no training row; 'calibrate' rows with a label give each place
    (first or inner) its width (see `conformal_by`). Every step is a grouped aggregate of a few numbers.
    """
    cell = [F.floor(F.col("chars") / step).alias("_a"), F.floor(F.col("words") / step).alias("_b"), F.col("inner")]
    rows = segment_features(segments, order).select("*", *cell[:2])
    known = rows.where((F.col(part) == "train") & F.col(label).isNotNull())
    near = known.groupBy("_a", "_b", "inner").agg(F.avg(label).alias("_near"))
    rows = rows.join(near, ["_a", "_b", "inner"], "left").crossJoin(F.broadcast(known.agg(F.avg(label).alias("_all"))))  # one row
    rows = rows.withColumn("estimate", F.round(F.coalesce("_near", "_all"), 6))
    rows = rows.withColumn("truth", F.when(F.col(part) == "calibrate", F.col(label).cast("double")))
    out = segment_uncertainty(conformal_by(rows, ["inner"], confidence))
    return out.select(*segments.columns, "estimate", "lower", "upper", "uncertainty", "confidence")


def fit_boundary_model(rows: DataFrame, features: list[str], label: str):
    """A logistic model of segment boundaries; its probability column feeds `conformal`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50)]).fit(rows)


def boundary_intervals(rows: DataFrame, features: list[str], label: str, part: str, confidence: float = 0.9) -> DataFrame:
    """``rows`` with estimate, lower and upper: the chance of a boundary and its split-conformal interval.

    Rows whose ``part`` is 'train' fit the model, those of 'calibrate' give the width; both need a label. Any other row is
    only judged. Rows with a null feature keep a null estimate; without training rows, or with one label alone, the
    estimate is the share of boundaries among them, 0.5 if there are none, as no model can be fitted.
    """
    from pyspark.ml.functions import vector_to_array

    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    known = rows.where((F.col(part) == "train") & F.col(label).isNotNull() & whole)
    seen = known.agg(F.min(label).alias("low"), F.max(label).alias("high"), F.avg(label).alias("mean")).first()
    if seen["low"] == seen["high"]:
        estimate = F.lit(0.5 if seen["mean"] is None else float(seen["mean"]))
        scored = rows.withColumn("estimate", F.when(whole, estimate))
    else:
        model = fit_boundary_model(known, features, label)
        judged = model.transform(rows.where(whole)).withColumn("estimate", vector_to_array("probability")[1])
        scored = judged.select(*rows.columns, "estimate").unionByName(rows.where(~whole).withColumn("estimate", F.lit(None).cast("double")))
    truth = F.when((F.col(part) == "calibrate") & F.col("estimate").isNotNull(), F.col(label).cast("double"))
    return conformal(scored.withColumn("truth", truth), confidence).drop("truth")


def guard_chain(segments: DataFrame) -> DataFrame:
    """Segments (doc_id, seg_no, text, depth, heading, page) after both joins: those that refer back, then short ones."""
    return C.merge_short(C.merge_anaphoric(segments))


def analysis_sections(blocks: DataFrame, budget: int = 8000, cap: int = 20) -> DataFrame:
    """(doc_id, context): the first ``cap`` sections with text, each cut to 600 characters, while the joined text stays within ``budget``."""
    rows = B.section_ids(blocks, F.col("is_heading"))
    head = F.max(F.when(F.col("is_heading"), F.substring(F.substring_index(T.strip(F.col("text")), "\n", 1), 1, 100)))
    rows = rows.withColumn("body", F.when(~F.col("is_heading"), F.col("text")))
    s = rows.groupBy("doc_id", "section").agg(F.coalesce(head, F.lit("(Pré-texto)")).alias("heading"), F.min("page").alias("page"), C.ordered_text("block_no", "body", "\n").alias("content"))
    s = s.where("content <> ''").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))).where(F.col("k") <= cap)
    content = T.strip(F.col("content"))
    s = s.where(F.length(content) >= 30).withColumn("chunk", F.concat(F.lit("### "), "heading", F.lit(" (p."), F.col("page").cast("string"), F.lit(")\n"), F.substring(content, 1, 600), F.lit("\n")))
    upto = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("spent", F.sum(F.length("chunk")).over(upto) + F.greatest(F.count("*").over(upto) - 2, F.lit(0)))
    stop = F.min(F.when(F.col("spent") > budget, F.col("section"))).over(Window.partitionBy("doc_id"))
    s = s.withColumn("stop", stop).where("stop is null or section < stop")
    return s.groupBy("doc_id").agg(C.ordered_text("section", "chunk", "\n").alias("context"))


def structure(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_headings, n_sections, n_fonts, layout): outline sizes and the count of each layout type as a map; one pass, as each heading opens a section."""
    size = F.col("font_size") + F.lit(0).cast(blocks.schema["font_size"].dataType)  # -0.0 is 0.0
    kinds = blocks.groupBy("doc_id", "layout_type").agg(F.count("*").alias("n"), F.sum(F.col("is_heading").cast("long")).alias("heads"), F.collect_set(size).alias("sizes"))
    out = kinds.where("doc_id is not null").groupBy("doc_id").agg(
        F.sum("heads").alias("n_headings"), F.size(F.array_distinct(F.flatten(F.collect_list("sizes")))).cast("long").alias("n_fonts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("layout_type", "n")))).alias("layout"),
    )
    return out.select("doc_id", "n_headings", F.coalesce("n_headings", F.lit(0)).cast("long").alias("n_sections"), "n_fonts", "layout")
