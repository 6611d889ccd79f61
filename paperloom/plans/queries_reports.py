"""Queries over whole reports of a document, its renderings, and judged segments, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as X
from ..operators import blocks as B
from ..sources import adapters as A
from . import tools
from . import oracle_base as O
from .queries_blocks import ORACLES as BLOCK_TWINS
from .queries_blocks import blocks, texts
from .queries_rest import CLASS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def told(array: str, *fields: str) -> Column:
    """An array of structs as text: a line an item, its fields parted by bars."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), "\n")


#: Table texts stand in bars, notes in brackets stand for annotations, and words with an @ for links.
@query(rf"""WITH {CLASS}, docs AS (SELECT DISTINCT doc_id FROM blocks),
one AS (SELECT *, split_part({O.trim('text')}, chr(10), 1) AS line FROM classified),
toc AS (SELECT doc_id, string_agg(concat(coalesce(heading_level, 4), '|', substr(line, 1, 80), '|', page), chr(10) ORDER BY block_no) AS toc
  FROM one WHERE is_heading AND lower(substr(line, 1, 80)) NOT IN ({O.words(T.BOILERPLATE_HEADINGS)}) GROUP BY 1),
opened AS (SELECT *, is_heading OR layout_type = 'heading' AS opens FROM one),
sec AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section FROM opened),
part AS (SELECT doc_id, section, max(CASE WHEN opens THEN substr(line, 1, 100) END) AS heading, min(page) AS page,
  CAST(sum(CASE WHEN opens THEN 0 ELSE length(text) END) AS BIGINT) AS chars, count(*) FILTER (NOT opens) AS k FROM sec WHERE section > 0 GROUP BY 1, 2),
secs AS (SELECT doc_id, string_agg(concat(heading, '|', page, '|', chars, '|', k), chr(10) ORDER BY section) AS sections
  FROM part WHERE lower(heading) NOT IN ({O.words(T.BOILERPLATE_HEADINGS)}) GROUP BY 1),
kinds AS (SELECT doc_id, string_agg(concat(layout_type, '|', n), chr(10) ORDER BY layout_type) AS layout
  FROM (SELECT doc_id, layout_type, count(*) AS n FROM classified GROUP BY 1, 2) GROUP BY 1),
used AS (SELECT doc_id, string_agg(concat(font, '|', n), chr(10) ORDER BY n DESC, seen) AS fonts
  FROM (SELECT doc_id, font, count(*) AS n, min(block_no) AS seen FROM blocks GROUP BY 1, 2) GROUP BY 1),
bars AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS i FROM blocks WHERE text LIKE '|%'),
tabs AS (SELECT doc_id, string_agg(concat(i, '|', len(string_split({O.trim('text')}, chr(10))), '|', substr(text, 1, 200)), chr(10) ORDER BY i) AS tables FROM bars WHERE i < 20 GROUP BY 1),
qual AS ({BLOCK_TWINS['quality_score']}),
notes AS (SELECT doc_id, count(*) FILTER (regexp_matches(text, '^\[[0-9]+\]')) AS n_annotations, CAST(sum(len(regexp_extract_all(text, '[^\s@]+@[^\s@]+'))) AS BIGINT) AS n_links FROM blocks GROUP BY 1)
SELECT doc_id, coalesce(toc, '') AS toc, coalesce(sections, '') AS sections, coalesce(layout, '') AS layout, coalesce(fonts, '') AS fonts, coalesce(tables, '') AS tables,
  overall AS quality, n_annotations, n_links FROM docs LEFT JOIN toc USING (doc_id) LEFT JOIN secs USING (doc_id) LEFT JOIN kinds USING (doc_id) LEFT JOIN used USING (doc_id)
  LEFT JOIN tabs USING (doc_id) LEFT JOIN (SELECT doc_id, overall FROM qual) USING (doc_id) LEFT JOIN notes USING (doc_id)""")
def structure_report(s, d):
    b = blocks(s, d)
    c = B.classify(b)
    heads = c.where("is_heading").select("doc_id", "block_no", F.coalesce("heading_level", F.lit(4)).alias("level"), "text", "page")
    bars = b.where(F.col("text").startswith("|")).select("doc_id", F.col("block_no").alias("k"), F.col("text").alias("md"))
    notes = b.where(F.col("text").rlike(r"^\[[0-9]+\]"))
    links = b.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s@]+@[^\s@]+"), 0)).alias("uri"))
    out = tools.structure_report(c, heads, bars, B.quality(B.heading_by_font(b), texts(s, d)), notes, links)
    return out.select(
        "doc_id", told("toc", "level", "text", "page").alias("toc"), told("sections", "heading", "page", "char_count", "block_count").alias("sections"),
        told("layout", "kind", "n").alias("layout"), told("fonts", "font", "n").alias("fonts"), told("tables", "index", "rows", "preview").alias("tables"),
        "quality", "n_annotations", "n_links",
    )


SCORED = BLOCK_TWINS["layout_scores"]
HELD = "(x0 + x1) / 2 BETWEEN 40 AND 300 AND (y0 + y1) / 2 BETWEEN 200 + 10 * (doc_id % 7) AND 420"


@query(f"""WITH scored AS ({SCORED}), {O.BLOCKS}, ratios AS (SELECT doc_id, block_no, font_size / median(font_size) OVER (PARTITION BY doc_id) AS ratio, page % 2 = 0 AND {HELD} AS cell FROM blocks)
SELECT doc_id, block_no, CASE WHEN ratio < 1.15 AND cell THEN 'table_cell' ELSE label END AS label, noise AND NOT cell AS noise FROM scored JOIN ratios USING (doc_id, block_no)""")
def layout_scores_in_tables(s, d):
    """Scores of blocks, those in the table regions of even pages being cells; a second region lies within the first."""
    b = blocks(s, d)
    pages = b.where("page % 2 = 0").select("doc_id", "page").distinct()
    box = lambda x0, y0, x1, y1: F.struct(F.lit(x0).alias("rx0"), y0.cast("double").alias("ry0"), F.lit(x1).alias("rx1"), F.lit(y1).alias("ry1"))
    regions = F.array(box(40.0, 200 + F.col("doc_id") % 7 * 10, 300.0, 420.0), box(100.0, F.lit(300.0), 200.0, 320.0))
    return B.scores(B.mark_inside(b, pages.select("doc_id", "page", F.inline(regions))))


@query(rf"""WITH {O.LINES}, f AS (SELECT doc_id, line_no, length(line) / 500.0::DOUBLE AS chars, len(list_filter(regexp_split_to_array(lower(line), '\s+'), lambda w: w <> '')) / 100.0::DOUBLE AS words,
  CASE WHEN line_no > 0 THEN 1 ELSE 0 END AS inner_, CASE WHEN length(line) < 60 THEN 1.0::DOUBLE ELSE 0.0 END AS y, doc_id % 3 AS part FROM lines),
c AS (SELECT *, floor(chars / 0.1) AS a, floor(words / 0.1) AS b FROM f), near AS (SELECT a, b, inner_, avg(y) AS near FROM c WHERE part = 0 GROUP BY 1, 2, 3),
e AS (SELECT c.*, round(coalesce(near, (SELECT avg(y) FROM c WHERE part = 0)), 6) AS estimate FROM c LEFT JOIN near USING (a, b, inner_)),
g AS (SELECT inner_, ceil(abs(y - estimate) * 10000) AS err FROM e WHERE part = 1 AND estimate IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY inner_ ORDER BY err) AS k, count(*) OVER (PARTITION BY inner_) AS n FROM g),
w AS (SELECT inner_, min(err) / 10000 AS w FROM k WHERE k >= ceil(round((n + 1) * 0.9, 9)) GROUP BY 1)
SELECT doc_id, line_no, round(estimate, 4) AS estimate, round(CASE WHEN w IS NULL OR estimate IS NULL THEN 0.5 ELSE least(1.0, 2 * w) END, 4) AS uncertainty,
  round(CASE WHEN w IS NULL OR estimate IS NULL THEN 0.5 ELSE greatest(0.0, 1 - 2 * w) END, 4) AS confidence FROM e LEFT JOIN w USING (inner_)""")
def segment_doubt(s, d):
    """How sure each line is to be short, judged from like lines of other documents."""
    l = A.lines(A.table(s, d, "documents")).select("doc_id", "line_no", F.col("line").alias("text"))
    part = F.get(F.array(F.lit("train"), F.lit("calibrate"), F.lit("judge")), (F.col("doc_id") % 3).cast("int"))
    rows = l.withColumn("label", F.when(F.length("text") < 60, 1.0).otherwise(0.0)).withColumn("part", part)
    out = X.judged_segments(rows, "label", "part", order="line_no")
    return out.select("doc_id", "line_no", F.round("estimate", 4).alias("estimate"), "uncertainty", "confidence")
