"""Operators on positioned blocks (doc_id, block_no, page, text, font_size, font, x0, y0, x1, y1): labels, layout, headers.

Per-document state is always a window or an aggregate over doc_id, so a corpus is one job whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _doc():
    return Window.partitionBy("doc_id")


def _in_doc():
    return _doc().orderBy("block_no")


def _so_far():
    return _in_doc().rowsBetween(Window.unboundedPreceding, 0)


def _page():
    return Window.partitionBy("doc_id", "page")


def by_document(blocks: DataFrame) -> DataFrame:
    """``blocks`` hashed by document once: every window, aggregate and join on doc_id after it then needs no shuffle."""
    return blocks.repartition("doc_id")


def body_font(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size): the font size that most characters have, of sizes 7 to 30; ties to the first seen; 12 without any."""
    ok = (F.length(T.strip(F.col("text"))) > 1) & F.col("font_size").between(7, 30)
    rows = blocks.select("doc_id", F.bround("font_size", 1).alias("size"), F.when(ok, F.struct(F.length("text").alias("n"), "block_no")).alias("k"))
    sized = rows.groupBy("doc_id", "size").agg(F.sum("k.n").alias("mass"), F.min("k.block_no").alias("first"))
    best = F.max_by("size", F.when(F.col("mass").isNotNull(), F.struct("mass", -F.col("first"))))
    return sized.groupBy("doc_id").agg(F.coalesce(best, F.lit(12.0)).alias("body_size"))


def heading_by_font(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``blocks`` with body_size, is_heading and heading_level by font ratio and weight; ``sizes`` is their `body_font`, if it is at hand."""
    ratio = F.col("font_size") / F.col("body_size")
    bold = F.col("font").contains("Bold") | F.col("font").contains("Black")
    out = blocks.join(body_font(blocks) if sizes is None else sizes, "doc_id").withColumn("is_heading", (ratio >= 1.2) | ((ratio >= 1.0) & bold))
    level = F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.3, 3).otherwise(4)
    return out.withColumn("heading_level", F.when(F.col("is_heading"), level))


def list_items(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with is_heading) with list_type and is_list_item; headings are no list items."""
    kind = F.when(~F.col("is_heading"), T.list_kind(F.col("text")))
    return blocks.withColumn("list_type", kind).withColumn("is_list_item", kind.isNotNull())


def frequent_edges(blocks: DataFrame, ratio: float, trim: bool, least_per_page: int = 1, least_pages: int = 1) -> DataFrame:
    """(doc_id, place, text, pages): texts that start (header) or end (footer) enough pages of their document.

    Of each document's five most frequent candidates, ties to the first seen, those on at least max(2, ratio * pages) pages and
    longer than five characters. Pages with fewer than ``least_per_page`` blocks don't vote.
    """
    place = F.struct("block_no")
    ends = blocks.groupBy("doc_id", "page").agg(F.min_by("text", place).alias("header"), F.max_by("text", place).alias("footer"), F.count("*").alias("n"))
    edge = ends.withColumn("n_pages", F.count("page").over(_doc())).where(F.col("n") >= least_per_page)
    edge = edge.select("doc_id", "page", "n_pages", F.stack(F.lit(2), F.lit("header"), "header", F.lit("footer"), "footer").alias("place", "t"))
    edge = edge.withColumn("t", T.strip(F.col("t"))) if trim else edge
    count = edge.groupBy("doc_id", "place", "t").agg(F.count("*").alias("pages"), F.min("page").alias("seen"), F.first("n_pages").alias("n_pages"))
    top = Window.partitionBy("doc_id", "place").orderBy(F.desc("pages"), "seen")
    count = count.withColumn("k", F.row_number().over(top)).where("k <= 5")
    enough = (F.col("pages") >= F.greatest(F.lit(2.0), F.col("n_pages") * ratio)) & (F.length("t") > 5) & (F.col("n_pages") >= least_pages)
    return count.where(enough).select("doc_id", "place", F.col("t").alias("text"), "pages")


def without_edges(rows: DataFrame, edges: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose trimmed text is no header or footer of their document."""
    gone = edges.groupBy("doc_id").agg(F.collect_set(T.strip(F.col("text"))).alias("_gone"))
    met = F.coalesce(F.array_contains("_gone", T.strip(F.col(column))), F.lit(False))
    return rows.join(gone, "doc_id", "left").where(~met).select(*rows.columns)


def text_rules(blocks: DataFrame) -> DataFrame:
    """``blocks`` with what their trimmed text ``_t`` alone tells: _level, _common, _caps, _chapter, _label.

    The numbering of a text is that of the text with its white space collapsed, since its patterns take any white space;
    only capitals are counted, so only they need the collapsed text. Common headings are single words.
    """
    t = F.col("_t")
    spread = t.rlike(rf"^[{T.UP}][{T.UP}\s]{{2,}}$")
    common = F.when(F.length(t) <= max(map(len, T.COMMON_HEADINGS)), T.is_common_heading(t)).otherwise(False)
    return blocks.withColumn("_t", T.strip(F.col("text"))).withColumns({
        "_level": T.heading_level(t), "_common": common, "_caps": F.when(spread, T.is_short_caps(T.collapse(t))).otherwise(False), "_chapter": T.is_chapter_like(t), "_label": T.is_page_label(t),
    })


def classify(blocks: DataFrame) -> DataFrame:
    """``blocks`` with layout_type, is_noise, is_heading and heading_level by text rules, page edges and fonts.

    The rules of texts are judged before the joins, once a block; fonts and edges are summed up where the blocks are, so only the
    blocks themselves are hashed by document, and once: a document's few edges reach them as arrays, as a join on document and
    text would hash them again.
    """
    edges = frequent_edges(blocks, 0.5, trim=True, least_per_page=2)
    of = lambda place: F.collect_set(F.when(F.col("place") == place, F.col("text")))
    places = edges.groupBy("doc_id").agg(of("header").alias("_headers"), of("footer").alias("_footers"))
    base = by_document(text_rules(blocks).withColumn("_kind", T.list_kind(F.col("text"))))
    base = heading_by_font(base, body_font(blocks)).withColumn("list_type", F.when(~F.col("is_heading"), F.col("_kind"))).withColumn("is_list_item", F.col("list_type").isNotNull())
    base = base.join(places, "doc_id", "left")
    label = (
        F.when(F.col("_label"), "page_number").when(F.array_contains("_headers", F.col("_t")), "header").when(F.array_contains("_footers", F.col("_t")), "footer")
        .when(F.col("_level").isNotNull() | F.col("is_heading") | F.col("_chapter") | F.col("_common"), "heading")
        .when(F.col("is_list_item"), "list_item").when(F.col("_caps"), "heading").when(F.length("_t") < 15, "short_text").otherwise("paragraph")
    )
    out = base.withColumn("layout_type", label)
    plain = F.col("layout_type") == "heading"
    new = F.when(plain & F.col("_level").isNotNull(), F.col("_level")).when(plain & F.col("is_heading"), F.col("heading_level")).when(plain & F.col("_chapter"), F.col("heading_level")).when(plain & F.col("_common"), 1).when(plain & F.col("_caps"), 2).otherwise(F.col("heading_level"))
    marked = plain & (F.col("_level").isNotNull() | F.col("_common") | F.col("_caps")) & ~(F.col("_chapter") & F.col("_level").isNull())
    out = out.withColumn("heading_level", new).withColumn("is_heading", F.col("is_heading") | marked)
    return out.withColumn("is_noise", F.col("layout_type").isin("header", "footer", "page_number")).drop("_t", "_headers", "_footers", "_level", "_common", "_caps", "_chapter", "_label", "_kind")


def merge_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """``blocks`` (with is_heading) labelled by an external model's elements (doc_id, page, text, type, confidence, pos).

    The first element of equal page and trimmed text gives layout_type and confidence, else "paragraph"; texts that the model
    calls header or footer anywhere in the document are that, and headings stay headings. is_noise follows.
    """
    labels = labels.withColumn("_t", T.strip(F.col("text")))
    first = Window.partitionBy("doc_id", "page", "_t").orderBy("pos")
    one = labels.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("doc_id", "page", "_t", F.col("type").alias("_label"), "confidence")
    edge = labels.where(F.col("type").isin("header", "footer")).groupBy("doc_id", "_t").agg(F.min("type").alias("_edge"))
    out = blocks.withColumn("_t", T.strip(F.col("text"))).join(one, ["doc_id", "page", "_t"], "left").join(edge, ["doc_id", "_t"], "left")
    out = out.withColumn("layout_type", F.when(F.col("is_heading"), "heading").otherwise(F.coalesce("_edge", "_label", F.lit("paragraph"))))
    return out.withColumn("is_noise", F.col("layout_type").isin("header", "footer", "page_number")).drop("_t", "_label", "_edge")


def repeated_texts(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    """(doc_id, text, pages) of trimmed texts on at least ``ratio`` of a document's pages."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    seen = blocks.groupBy("doc_id", T.strip(F.col("text")).alias("text")).agg(F.countDistinct("page").alias("pages"))
    return seen.join(pages, "doc_id").where((F.col("text") != "") & (F.col("pages") / F.col("n_pages") >= ratio)).select("doc_id", "text", "pages")


def footer_band(blocks: DataFrame) -> DataFrame:
    """(doc_id, footer_y0, footer_y1): a band of 30 points above the median bottom, where most pages end within 20 points of it."""
    pages = blocks.groupBy("doc_id", "page").agg(F.max("y1").alias("bottom"))
    mid = pages.groupBy("doc_id").agg(F.median("bottom").alias("mid"), F.count("*").alias("n"))
    near = pages.join(mid, "doc_id").groupBy("doc_id", "mid", "n").agg(F.sum((F.abs(F.col("bottom") - F.col("mid")) < 20).cast("int")).alias("near"))
    ok = F.col("near") > F.greatest(F.lit(2.0), F.col("n") * 0.5)
    return near.select("doc_id", F.when(ok, F.col("mid") - 30).alias("footer_y0"), F.when(ok, F.col("mid")).alias("footer_y1"))


def column_histogram(blocks: DataFrame) -> DataFrame:
    """(doc_id, bin, n): the three most frequent 20-point bins of block centres, over max(5, 5 %) of more than ten blocks."""
    centre = (F.col("x0") + F.col("x1")) / 2
    total = Window.partitionBy("doc_id")
    bins = blocks.groupBy("doc_id", (F.bround(centre / 20, 0) * 20).alias("bin")).agg(F.count("*").alias("n"), F.min("block_no").alias("seen"))
    bins = bins.withColumn("all", F.sum("n").over(total))
    top = Window.partitionBy("doc_id").orderBy(F.desc("n"), "seen")
    bins = bins.withColumn("k", F.row_number().over(top)).where((F.col("k") <= 3) & (F.col("all") > 10) & (F.col("n") > F.greatest(F.lit(5.0), F.col("all") * 0.05)))
    return bins.select("doc_id", "bin", "n")


def column_gaps(blocks: DataFrame, least: float = 15.0) -> DataFrame:
    """(doc_id, page, boundaries): middles of those gaps between blocks sorted by left edge that are close to the upper median gap."""
    by_x = Window.partitionBy("doc_id", "page").orderBy("x0", "block_no")
    rows = blocks.withColumn("next", F.lead("x0").over(by_x)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page")))
    gaps = rows.where((F.col("n") >= 3) & (F.col("next") - F.col("x1") > least)).select("doc_id", "page", (F.col("next") - F.col("x1")).alias("gap"), ((F.col("next") + F.col("x1")) / 2).alias("mid"))
    held = gaps.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("gap")).alias("gaps"), F.collect_list(F.struct("gap", "mid")).alias("all"))
    held = held.withColumn("median", F.element_at("gaps", F.floor(F.size("gaps") / 2).cast("int") + 1))
    near = F.filter("all", lambda g: F.abs(g["gap"] - F.col("median")) < F.col("median") / 2)
    return held.select("doc_id", "page", F.array_sort(F.array_distinct(F.transform(near, lambda g: g["mid"]))).alias("boundaries"))


def assign_columns(blocks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``blocks`` with ``col``: how many of the page's boundaries lie left of the block's centre."""
    centre = (F.col("x0") + F.col("x1")) / 2
    out = blocks.join(boundaries, ["doc_id", "page"], "left")
    return out.withColumn("col", F.coalesce(F.size(F.filter("boundaries", lambda b: b <= centre)), F.lit(0))).drop("boundaries")


def reading_order(blocks: DataFrame, boundaries: DataFrame, scope: str = "page") -> DataFrame:
    """``blocks`` with ``pos``: by page, column and height, text first; scope "document" lets pages interleave."""
    keys = ["doc_id"] if scope == "document" else ["doc_id", "page"]
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("type") == "text"), "col", "y0", "block_no")
    return assign_columns(blocks, boundaries).withColumn("pos", F.row_number().over(order) - 1)


def projection_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, x): where left edges show a column gap: between adjacent frequent edges, wide and near the middle."""
    page = Window.partitionBy("doc_id", "page")
    rows = blocks.withColumn("n", F.count("*").over(page)).withColumn("w", F.max("x1").over(page)).where("n >= 4")
    bins = rows.groupBy("doc_id", "page", "w", (F.bround(F.col("x0") / 10, 0) * 10).alias("edge")).agg(F.count("*").alias("k"), F.min("block_no").alias("seen"))
    bins = bins.where((F.col("k") >= 2) & F.col("edge").between(F.col("w") * 0.08, F.col("w") * 0.92))
    bins = bins.withColumn("r", F.row_number().over(page.orderBy(F.desc("k"), "seen"))).where("r <= 6")
    gaps = bins.withColumn("next", F.lead("edge").over(page.orderBy("edge"))).withColumn("mid", (F.col("edge") + F.col("next")) / 2)
    return gaps.where((F.col("next") - F.col("edge") > F.col("w") * 0.12) & F.col("mid").between(F.col("w") * 0.25, F.col("w") * 0.75)).groupBy("doc_id", "page").agg(F.median("mid").alias("x"))


def overlap_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, a, b) of blocks of a page that overlap vertically; the page is the join's equal key."""
    a = blocks.select("doc_id", "page", F.col("block_no").alias("a"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    b = blocks.select("doc_id", "page", F.col("block_no").alias("b"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    return a.join(b, ["doc_id", "page"]).where("a < b and a0 < b1 and b0 < a1").select("doc_id", "page", "a", "b")


def inside(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a region (doc_id, page, rx0, ry0, rx1, ry1) of their page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b = blocks.withColumn("cx", cx).withColumn("cy", cy).alias("b")
    on = "b.doc_id = r.doc_id and b.page = r.page and cx between rx0 and rx1 and cy between ry0 and ry1"
    return b.join(regions.alias("r"), F.expr(on), "left_semi").drop("cx", "cy")


def mark_inside(blocks: DataFrame, regions: DataFrame, name: str = "inside_table") -> DataFrame:
    """``blocks`` with a boolean ``name``: whether the centre lies in a region (doc_id, page, rx0, ry0, rx1, ry1) of the page.

    A page's regions travel as one array, so a block stays one row however many regions hold it. A region with a null
    edge holds nothing; a block without a box is in none.
    """
    box = F.struct("rx0", "ry0", "rx1", "ry1")
    held = regions.groupBy("doc_id", "page").agg(F.collect_list(box).alias("_regions"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = F.exists("_regions", lambda r: F.coalesce(cx.between(r["rx0"], r["rx1"]) & cy.between(r["ry0"], r["ry1"]), F.lit(False)))
    return blocks.join(held, ["doc_id", "page"], "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_regions")


def section_ids(blocks: DataFrame, heading: Column) -> DataFrame:
    """``blocks`` with section: the number of headings up to the row; 0 before the first."""
    return blocks.withColumn("section", F.sum(heading.cast("int")).over(_so_far()))


def sections(blocks: DataFrame, heading: Column | None = None) -> DataFrame:
    """(doc_id, section, heading, page, char_count, block_count): sums over the sections that headings open."""
    heading = F.col("is_heading") if heading is None else heading
    rows = section_ids(blocks, heading)
    first = F.min_by(F.when(heading, F.substring(F.substring_index(T.strip(F.col("text")), "\n", 1), 1, 100)), "block_no")
    body = F.when(~heading, F.length("text")).otherwise(0)
    return rows.groupBy("doc_id", "section").agg(first.alias("heading"), F.min("page").alias("page"), F.sum(body).alias("char_count"), F.sum((~heading).cast("int")).alias("block_count"))


def list_runs(blocks: DataFrame, shown: Column | None = None) -> DataFrame:
    """``blocks`` (with is_list_item) with ``run``: consecutive list items share one, null elsewhere; rows that are not ``shown`` count for nothing."""
    before = F.lag("is_list_item").over(_in_doc())
    if shown is not None:
        item = F.when(shown, F.coalesce("is_list_item", F.lit(False)))
        before = F.last(item, ignorenulls=True).over(_in_doc().rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("is_list_item") & ~F.coalesce(before, F.lit(False))
    return blocks.withColumn("run", F.when(F.col("is_list_item"), F.sum(starts.cast("int")).over(_so_far())))


def is_reference(counts: Column) -> Column:
    """Whether a block is author-like with a year in parentheses, after a references heading of its document among the blocks that ``counts`` marks."""
    t = T.strip(F.col("text"))
    opens = t.rlike(r"^(?i:refer[eê]ncias|bibliografia|references|bibliography)")
    return F.max(F.when(counts, opens)).over(_so_far()) & ~opens & t.rlike(r"^[A-ZÀ-ɂ][\wÀ-ɂ]+.*\([0-9]{4}\)")


def references_after_heading(blocks: DataFrame) -> DataFrame:
    """Author-like blocks with a year in parentheses, after a references heading of their document."""
    return blocks.withColumn("_refers", is_reference(F.lit(True))).where("_refers").drop("_refers")


def is_footnote() -> Column:
    t = T.strip(F.col("text"))
    return t.rlike(r"^\[[0-9]+\]\s+|^[0-9]+\.\s{2,}") & (F.length(t) < 300)


def footnotes(blocks: DataFrame) -> DataFrame:
    return blocks.where(is_footnote())


def authored_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, heading, page, char_count, block_count) as `sections` gives them, but those that a boilerplate heading opens and
    blocks before the first heading are left out."""
    heading = F.coalesce("is_heading", F.lit(False)) | F.coalesce(F.col("layout_type") == "heading", F.lit(False))
    return sections(blocks, heading).where((F.col("section") > 0) & ~F.lower("heading").isin(*T.BOILERPLATE_HEADINGS))


def layout_features(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no and nine features): size and its ratio to the median, case, length, marks, height on the page, repetition."""
    t = T.strip(F.col("text"))
    body, page_h = F.median("font_size").over(_doc()), F.max("y1").over(_page())
    rep = repeated_texts(blocks).select("doc_id", F.col("text").alias("_t"), F.lit(True).alias("_rep"))
    rows = blocks.withColumn("_t", t).withColumn("_ratio", F.when(body > 0, F.col("font_size") / body).otherwise(1.0)).withColumn("_y", F.when(page_h > 0, F.col("y0") / page_h).otherwise(0.5))
    rows, t = rows.join(rep, ["doc_id", "_t"], "left"), F.col("_t")
    caps = (F.length(t) > 1) & t.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]") & ~t.rlike("[a-zß-öø-ÿ]")
    return rows.select(
        "doc_id", "block_no", "font_size", F.col("_ratio").alias("font_size_ratio"), caps.alias("is_all_caps"), (F.length(t) < 20).alias("is_short"), t.rlike("^[0-9]").alias("starts_with_number"),
        t.rlike("[.!?:;]$").alias("ends_with_punctuation"), t.rlike("^[0-9]+$").alias("is_number"), F.col("_y").alias("relative_y"), F.coalesce("_rep", F.lit(False)).alias("is_repeated"),
    )


def scores(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, label, noise): additive rule scores over size, case, punctuation, place and repetition.

    Blocks that ``inside_table`` marks (see `mark_inside`) and that are not large are table cells, never noise.
    """
    page_h = F.max("y1").over(Window.partitionBy("doc_id", "page"))
    body = F.median("font_size").over(_doc())
    rep = repeated_texts(blocks).select("doc_id", F.col("text").alias("t"), F.lit(True).alias("rep"))
    rows = blocks.withColumn("t", T.strip(F.col("text"))).withColumn("ratio", F.col("font_size") / body).withColumn("y", F.col("y0") / page_h)
    rows = rows.join(rep, ["doc_id", "t"], "left").withColumn("rep", F.coalesce("rep", F.lit(False)))
    short, num = F.length("t") < 20, F.col("t").rlike("^[0-9]")
    caps = (F.length("t") > 1) & F.col("t").rlike("[A-Za-zÀ-ÖØ-öø-ÿ]") & ~F.col("t").rlike("[a-zß-öø-ÿ]")
    ends, digits = F.col("t").rlike("[.!?:;]$"), F.col("t").rlike("^[0-9]+$")
    add = lambda *p: sum((F.when(c, F.lit(v)).otherwise(0.0) for c, v in p), F.lit(0.0))
    score = [
        ("heading", add((F.col("ratio").between(0.9, 1.15) & (F.col("ratio") < 1.15), 0.5), (caps, 1.5), (short, 0.3))),
        ("paragraph", add((F.col("ratio").between(0.85, 1.15), 1.0), (ends, 1.0), (short, -1.5), (caps, -0.5))),
        ("short_text", add((short, 1.5), (~ends, 0.5), (num, -0.5))), ("header", add((F.col("y") < 0.15, 2.0), (short, 0.5))),
        ("footer", add((F.col("y") > 0.85, 2.0), (short, 0.5))), ("page_number", add((digits, 3.0), (short, 1.0))),
        ("list_item", add((num, 2.0), (short, 0.5))), ("table_cell", add((short, 0.5), (~num, 0.3))),
    ]
    top = F.greatest(*[s for _, s in score])
    best = F.coalesce(*[F.when(s == top, F.lit(n)) for n, s in score])
    noise = F.col("rep") | (digits & short & (F.col("y") > 0.75)) | ((F.col("ratio") < 0.6) & short)
    kind = F.when(digits, "page_number").when(F.col("y") < 0.15, "header").when(F.col("y") > 0.85, "footer").otherwise("noise")
    big = F.col("ratio") >= 1.15
    cell = F.coalesce("inside_table", F.lit(False)) if "inside_table" in blocks.columns else F.lit(False)
    label = F.when(big, "heading").when(cell, "table_cell").when(noise, kind).otherwise(best)
    return rows.select("doc_id", "block_no", label.alias("label"), (~big & ~cell & noise).alias("noise"))


def quality(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a document: seven scores in 0..1 and their mean, over its blocks (with is_heading) and text (doc_id, text)."""
    rows = F.split("text", "\n")
    broken = F.regexp_count("text", F.lit(rf"[{T.LETTER}]+-\n[{T.LETTER}]+"))
    orphan = F.size(F.filter(rows, lambda x: T.strip(x).rlike("^[A-Za-zÀ-ÿ]{1,4}$") & ~T.strip(x).rlike("^[IVXLCDM]+$")))
    t = texts.select("doc_id", F.size(rows).alias("n_lines"), broken.alias("broken"), orphan.alias("orphans"), (F.length("text") / F.size(rows)).alias("mean_line"))
    page = Window.partitionBy("doc_id").orderBy("x0")
    xs = blocks.select("doc_id", F.bround("x0", 0).alias("x0")).distinct().withColumn("gap", F.col("x0") - F.lag("x0").over(page))
    cols = xs.groupBy("doc_id").agg((1 + F.sum(F.coalesce((F.col("gap") > 50).cast("int"), F.lit(0)))).alias("cols"))
    tables = F.sum((F.col("text").contains("|") & (F.length("text") > 50)).cast("int"))
    b = blocks.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("is_heading").cast("int")).alias("heads"), tables.alias("tables"))
    j = b.join(t, "doc_id").join(cols, "doc_id")
    cap = lambda c: F.least(F.lit(1.0), c)
    r2 = lambda c: F.floor(c * 100 + 0.5) / 100
    dims = {
        "hyphenation": r2(1 - cap(F.col("broken") / F.greatest(F.col("n_lines") * 0.02, F.lit(1.0)))),
        "orphan_lines": r2(1 - cap(F.col("orphans") / F.greatest(F.col("n_lines") * 0.05, F.lit(1.0)))),
        "text_coverage": r2(F.when(F.col("chars") > 0, F.greatest(F.lit(0.1), cap(F.col("chars") / (F.col("pages") * 2000)))).otherwise(0.0)),
        "headings": r2(cap(F.col("heads") / (F.col("pages") * 2))), "tables": r2(cap(F.col("tables") / F.greatest(F.col("pages") * 0.1, F.lit(1.0)))),
        "ocr_quality": F.lit(1.0), "line_quality": r2(cap(F.col("mean_line") / F.greatest(F.lit(35.0), F.lit(80.0) - (F.col("cols") - 1) * 20))),
    }
    out = j.select("doc_id", *[c.alias(n) for n, c in dims.items()])
    return out.withColumn("overall", r2(sum((F.col(n) for n in dims), F.lit(0.0)) / 7))
