"""Queries over whole chunkers, unit features, segments, unions of blocks and reranking, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import retrieval as V
from ..sources import adapters as A
from ..sources import extract as E
from . import api
from . import oracle_base as O
from .config import PipelineConfig
from .queries_blocks import SECTIONS, blocks
from .queries_rest import FALLBACK, FUSED, ISLES, lines, sections_sql, segments, variants, words_n

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Chunkers


def merged_sql(least: int) -> str:
    """raw (doc_id, idx, text, page, heading, depth, tokens) with tiny chunks merged, as merged."""
    return f"""ma AS (SELECT *, tokens < {least} AS small, tokens < {least} AND NOT coalesce(lag(tokens < {least}) OVER w, false) AS new FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
mb2 AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM ma),
mc AS (SELECT *, small AND row_number() OVER (PARTITION BY doc_id, run, small ORDER BY idx) % 2 = 1 AND lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) IS NOT NULL AS head FROM mb2),
md AS (SELECT *, coalesce(lag(head) OVER w, false) AS taken, CASE WHEN head THEN text || chr(10) || chr(10) || lead(text) OVER w ELSE text END AS t,
  CASE WHEN head THEN coalesce(heading, lead(heading) OVER w) ELSE heading END AS h FROM mc WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
merged AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY doc_id) AS n, t AS text, page, h AS heading, depth FROM md WHERE NOT taken)"""


def deduped_sql(least: int) -> str:
    """merged (doc_id, i, n, text) with repeats of the chunk before dropped, as deduped (doc_id, pl, src, text); src is the chunk whose other columns stay."""
    fresh = "list_filter(string_split(c.text, chr(10)), lambda x: NOT list_contains(string_split(f.last, chr(10)), x) OR length(" + O.trim("x") + ") > 80)"
    return f"""fd AS (SELECT doc_id, i, n, text AS last, i AS src, CAST(NULL AS VARCHAR) AS done, i AS dsrc FROM merged WHERE i = 1 UNION ALL
  SELECT doc_id, i, n, CASE WHEN inside THEN CASE WHEN length(cur) > length(last) THEN cur ELSE last END WHEN few THEN last ELSE kept END,
    CASE WHEN inside THEN CASE WHEN length(cur) > length(last) THEN i ELSE src END WHEN few THEN src ELSE i END, CASE WHEN NOT inside AND NOT few THEN last END, src FROM (
    SELECT *, len(fresh) < len(string_split(cur, chr(10))) * 0.3 OR greatest(1, length(kept) // 3) < {least} AS few FROM (
      SELECT f.doc_id, c.i, c.n, f.last, f.src, c.text AS cur, contains(f.last, c.text) OR contains(c.text, f.last) AS inside, {fresh} AS fresh, array_to_string({fresh}, chr(10)) AS kept
      FROM fd f JOIN merged c ON c.doc_id = f.doc_id AND c.i = f.i + 1))),
deduped AS (SELECT doc_id, i AS pl, dsrc AS src, done AS text FROM fd WHERE done IS NOT NULL UNION ALL SELECT doc_id, n + 1, src, last FROM fd WHERE i = n)"""


FORMATTING = rf"len(list_filter(string_split({O.trim('d.text')}, chr(10)), lambda x: regexp_matches(x, '^\s*[■•*-]\s*$|^\s*#{{1,6}}\s*$|^\s*\|.*\|\s*$') OR length({O.trim('x')}) < 5)) > len(string_split({O.trim('d.text')}, chr(10))) * 0.6"
FINISHED = f"""SELECT d.doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, d.text, m.page, m.heading, CAST(m.depth AS INTEGER) AS depth, CAST(greatest(1, length(d.text) // 3) AS INTEGER) AS tokens,
  CAST(sum(length(d.text)) OVER w - length(d.text) AS BIGINT) AS start_char, CAST(sum(length(d.text)) OVER w AS BIGINT) AS end_char
  FROM deduped d JOIN merged m ON m.doc_id = d.doc_id AND m.i = d.src WHERE NOT ({FORMATTING}) WINDOW w AS (PARTITION BY d.doc_id ORDER BY pl)"""


@query(f"""WITH RECURSIVE {O.LINES}, raw AS (SELECT doc_id, line_no * 2 AS idx, line AS text FROM lines UNION ALL SELECT doc_id, line_no * 2 + 1, substr(line, 1, 120) FROM lines WHERE line_no % 3 = 0),
merged AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY doc_id) AS n, text FROM raw), {deduped_sql(10)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pl) - 1 AS INTEGER) AS k, text FROM deduped""")
def adjacent_dedup(s, d):
    c = lines(s, d).select("doc_id", (F.col("line_no") * 2).alias("index"), F.col("line").alias("text"))
    cut = c.where("index % 6 = 0").select("doc_id", (F.col("index") + 1).alias("index"), F.substring("text", 1, 120).alias("text"))
    return C.dedup_adjacent(c.unionByName(cut), least=10)


@query(f"""WITH RECURSIVE {sections_sql(True)}, raw AS (SELECT doc_id, section AS idx, text, page, heading, depth, greatest(1, length(text) // 3) AS tokens FROM sections), {merged_sql(50)}, {deduped_sql(50)} {FINISHED}""")
def chunk_postprocess(s, d):
    """Section chunks after every step that follows a chunker."""
    return C.postprocess(C.semantic_chunks(B.classify(blocks(s, d)), 300)).drop("section").withColumnRenamed("index", "idx")


@query(f"""WITH RECURSIVE {FALLBACK}, {sections_sql(True).removeprefix(O.LINES + ',')},
raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS idx, text, page, heading, depth, greatest(1, length(text) // 3) AS tokens FROM sections WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pl, j), text, NULL, NULL, 0, greatest(1, length(text) // 3) FROM fraw WHERE doc_id % 3 = 0), {merged_sql(50)}, {deduped_sql(50)} {FINISHED}""")
def chunk_dispatch(s, d):
    """Chunks of a corpus of which a third has no blocks: by section where there are blocks, by size elsewhere."""
    t = A.table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = api.chunk(B.classify(blocks(s, d)).where("doc_id % 3 <> 0"), t, PipelineConfig(chunk_size=300, chunk_overlap=20))
    return out.drop("section").withColumnRenamed("index", "idx")


@query(f"""WITH RECURSIVE {sections_sql(False)}, segs AS (SELECT doc_id, section AS seg_no, text, depth, heading, page FROM sections), {ISLES},
sh AS (SELECT *, {words_n('text')} AS nw FROM merged), sb AS (SELECT *, last_value(CASE WHEN nw >= 10 THEN nw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS big FROM sh),
sg AS (SELECT *, sum(CASE WHEN nw < 10 AND coalesce(big, 0) > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seg_no) AS gg FROM sb)
SELECT doc_id, CAST(min(seg_no) AS BIGINT) AS seg_no, string_agg(text, chr(10) || chr(10) ORDER BY seg_no) AS text, CAST(max(depth) AS INTEGER) AS depth, arg_min(heading, seg_no) FILTER (heading IS NOT NULL) AS heading, arg_min(page, seg_no) AS page, 1.0 AS confidence, 'heading' AS method FROM sg GROUP BY doc_id, gg""")
def hybrid(s, d):
    t = A.table(s, d, "documents").select("doc_id", "text")
    return C.hybrid_segments(t, B.classify(blocks(s, d)))


@query()
def bcpd_segments(s, d):
    """Change-point segments of whole texts, with the headings of their blocks."""
    return C.change_point_segments(A.table(s, d, "documents").select("doc_id", "text"), B.classify(blocks(s, d)))


# Features


UNITS = f"{O.BLOCKS}, un AS (SELECT * FROM (SELECT doc_id, block_no AS unit_no, {O.trim('text')} AS t FROM blocks) WHERE t LIKE '#%' OR length(t) > 20), uw AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS w FROM un)"


def units(s, d):
    b = blocks(s, d).groupBy("doc_id").agg(C.ordered_text("block_no", "text", "\n").alias("text"))
    return C.unit_features(C.units_of(b))


@query(rf"""WITH {UNITS} SELECT doc_id, CAST(unit_no AS INTEGER) AS unit_no, round(length(t) / 500, 6) AS f0, round(len(w) / 100, 6) AS f1,
  round(len(list_filter(w, lambda x: x IN ({O.words(T.LEGAL_TERMS)}))) / greatest(len(w), 1), 6) AS f2, round(length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t), 6) AS f3,
  CASE WHEN t LIKE '#%' THEN 1.0 ELSE 0.0 END AS f4, CASE WHEN t LIKE '##%' OR t LIKE '# %' THEN 1.0 ELSE 0.0 END AS f5,
  CASE WHEN {' OR '.join(f"starts_with(lower(t), '{x}')" for x in T.LEGAL_OPENINGS)} THEN 1.0 ELSE 0.0 END AS f6, round(least(greatest(len(w), 1), 100) / 100, 6) AS f7,
  round(length(regexp_replace(t, '[^.,;:!?]', '', 'g')) / length(t), 6) AS f8, CASE WHEN regexp_matches(t, '^[0-9.]+\s') THEN 1.0 ELSE 0.0 END AS f9 FROM uw""")
def unit_features(s, d):
    return units(s, d).select("doc_id", "unit_no", *(F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(10)))


@query(f"""WITH {UNITS}, b AS (SELECT doc_id, unit_no, unnest(list_transform(w[1:25], lambda x: CAST('0x' || substr(md5(x), 1, 7) AS INTEGER) % 68)) AS bucket FROM uw)
SELECT doc_id, CAST(unit_no AS INTEGER) AS unit_no, CAST(bucket AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL""")
def unit_word_buckets(s, d):
    rows = units(s, d).select("doc_id", "unit_no", F.posexplode(F.slice("features", 13, C.BUCKETS)).alias("bucket", "n"))
    return rows.where("n > 0")


@query(rf"""WITH {O.BLOCKS}, np AS (SELECT doc_id, count(DISTINCT page) AS n FROM blocks GROUP BY 1),
rep AS (SELECT doc_id, t FROM (SELECT doc_id, {O.trim('text')} AS t, count(DISTINCT page) AS k FROM blocks GROUP BY 1, 2) JOIN np USING (doc_id) WHERE t <> '' AND k / n >= 0.6),
f AS (SELECT b.doc_id, block_no, font_size, {O.trim('text')} AS t, font_size / median(font_size) OVER (PARTITION BY b.doc_id) AS ratio, y0 / max(y1) OVER (PARTITION BY b.doc_id, page) AS y FROM blocks b)
SELECT f.doc_id, block_no, font_size, round(ratio, 6) AS font_size_ratio, length(f.t) > 1 AND regexp_matches(f.t, '[A-Za-zÀ-ÖØ-öø-ÿ]') AND NOT regexp_matches(f.t, '[a-zß-öø-ÿ]') AS is_all_caps, length(f.t) < 20 AS is_short,
  regexp_matches(f.t, '^[0-9]') AS starts_with_number, regexp_matches(f.t, '[.!?:;]$') AS ends_with_punctuation, regexp_matches(f.t, '^[0-9]+$') AS is_number, round(y, 6) AS relative_y, r.t IS NOT NULL AS is_repeated
FROM f LEFT JOIN rep r ON r.doc_id = f.doc_id AND r.t = f.t""")
def layout_features(s, d):
    return B.layout_features(blocks(s, d)).withColumn("font_size_ratio", F.round("font_size_ratio", 6)).withColumn("relative_y", F.round("relative_y", 6))


@query(f"""WITH {SECTIONS.replace('CASE WHEN is_heading THEN 1 ELSE 0 END', "CASE WHEN is_heading OR layout_type = 'heading' THEN 1 ELSE 0 END")}, st AS (SELECT doc_id, CAST(section AS BIGINT) AS section,
  arg_min(substr(split_part({O.trim('text')}, chr(10), 1), 1, 100), block_no) FILTER (is_heading OR layout_type = 'heading') AS heading, min(page) AS page,
  CAST(sum(CASE WHEN is_heading OR layout_type = 'heading' THEN 0 ELSE length(text) END) AS BIGINT) AS char_count, CAST(count(*) FILTER (NOT (is_heading OR layout_type = 'heading')) AS BIGINT) AS block_count FROM sec GROUP BY 1, 2)
SELECT * FROM st WHERE section > 0 AND lower(heading) NOT IN ({O.words(T.BOILERPLATE_HEADINGS)})""")
def authored_sections(s, d):
    return B.authored_sections(B.classify(blocks(s, d)))


# Sources


TABLES = "tb AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS k, text AS md FROM blocks WHERE text LIKE '|%'), im AS (SELECT doc_id, page, 0 AS image_no, 100 + page AS width FROM blocks WHERE block_no % 11 = 3)"


@query(f"""WITH {O.BLOCKS}, {TABLES}, al AS (SELECT doc_id, 'text' AS type, page, block_no AS n, text, CAST(NULL AS VARCHAR) AS md, CAST(NULL AS INTEGER) AS width, 0 AS kind FROM blocks
  UNION ALL SELECT doc_id, 'table', page, k, NULL, md, NULL, 1 FROM tb UNION ALL SELECT doc_id, 'image', page, image_no, NULL, NULL, width, 2 FROM im)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, CASE WHEN kind > 0 THEN page ELSE 0 END, n) - 1 AS INTEGER) AS block_no, type, page, text, md, width FROM al""")
def united_blocks(s, d):
    b = blocks(s, d)
    k = F.row_number().over(B._in_doc()) - 1
    tables = b.where("text like '|%'").select("doc_id", "page", k.alias("k"), F.col("text").alias("md"))
    images = b.where("block_no % 11 = 3").select("doc_id", "page", F.lit(0).alias("image_no"), (F.col("page") + 100).alias("width"))
    return E.unite(b.drop("source"), tables, images).select("doc_id", "block_no", "type", "page", "text", "md", "width")


@query(f"""WITH {O.BLOCKS}, lo AS (SELECT doc_id, page FROM blocks GROUP BY 1, 2 HAVING sum(length(text)) < 200), mx AS (SELECT doc_id, max(block_no) + 1 AS f FROM blocks GROUP BY 1)
SELECT doc_id, block_no, page, type, text FROM blocks UNION ALL SELECT doc_id, CAST(f + row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INTEGER), page, 'ocr', 'seen ' || page FROM lo JOIN mx USING (doc_id) WHERE page % 2 = 0""")
def ocr_blocks(s, d):
    """Pages with little text get a block of recognised text, here for even pages."""
    b = blocks(s, d)
    seen = b.select("doc_id", "page").distinct().where("page % 2 = 0").withColumn("text", F.concat(F.lit("seen "), F.col("page").cast("string")))
    return E.with_ocr_blocks(b, seen, least=200).select("doc_id", "block_no", "page", "type", "text")


@query(f"WITH {O.BLOCKS}, p AS (SELECT doc_id, max(page) + 1 AS pages FROM blocks GROUP BY 1), a AS (SELECT doc_id, pages FROM p UNION ALL SELECT -doc_id - 1, 0 FROM documents WHERE doc_id % 50 = 0) SELECT doc_id, pages, CASE WHEN pages > 4 THEN 'too many pages' ELSE 'empty' END AS error FROM a WHERE pages > 4 OR pages < 1")
def page_guard(s, d):
    """Documents with over four pages, and those listed that have no page at all."""
    ids = A.table(s, d, "documents").select("doc_id")
    return E.page_guard(blocks(s, d), "doc_id", 4, ids.unionByName(ids.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id"))))


# Retrieval and guards


@query(f"WITH {FUSED}, sc AS (SELECT base, place, id, round((id % 17) / 16, 4) AS rerank_score FROM fused) SELECT base, CAST(rank AS INTEGER) AS rank, id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rerank_score DESC, place) AS rank FROM sc) WHERE rank <= 3")
def rerank(s, d):
    """Fused hits in the order of a second score."""
    return V.rerank(V.fuse(variants(s, d), 10**9), 3, score=(F.col("id") % 17) / 16).select("base", "rank", "id", "rerank_score")


@query(f"WITH {FUSED} SELECT base, CAST(place AS INTEGER) AS rank, id FROM fused WHERE place <= 3")
def rerank_without_model(s, d):
    return V.rerank(V.fuse(variants(s, d), 10**9), 3).select("base", "rank", "id")


NAMED = r"regexp_matches({0}, '(^|\s)[A-Z][a-z]+')"


@query(f"""WITH RECURSIVE {O.LINES}, sg AS (SELECT doc_id, line_no AS seg_no, line AS text, substr(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), 1, 200) AS prev FROM lines)
SELECT doc_id, seg_no FROM sg WHERE seg_no > 0 AND (len({O.matches('text', T.ANAPHORA)}) > 0 OR regexp_matches(lower(text), '^\\s*({"|".join(T.LOOKING_BACK)})([^a-zà-öø-ÿ0-9_]|$)')) AND NOT {NAMED.format('prev')}""")
def orphan_antecedent(s, d):
    """Segments that refer back where the one before names nothing to refer to."""
    return C.at_risk(segments(s, d), names=lambda t: t.rlike(r"(^|\s)[A-Z][a-z]+")).where("at_risk").select("doc_id", "seg_no")
