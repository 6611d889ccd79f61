"""Queries over text scalars and positioned blocks, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..sources import adapters as A
from . import oracle_base as O

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def blocks(s, d):
    return A.blocks(A.table(s, d, "documents"))


def texts(s, d):
    """(doc_id, text): each document's blocks as one text, in order."""
    rows = blocks(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return rows.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


TEXTS = f"{O.BLOCKS}, texts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1)"
SUPER = "regexp_replace(text, '([a-z])er ', '\\1²³ ', 'g')"


def scripted(s, d):
    return A.table(s, d, "documents").select("doc_id", F.regexp_replace("text", "([a-z])er ", "$1²³ ").alias("text"))


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {O.is_boilerplate('x')}), chr(10)) AS kept FROM texts")
def boilerplate_lines(s, d):
    return texts(s, d).select("doc_id", T.drop_boilerplate(F.col("text")).alias("kept"))


@query(f"WITH {O.BLOCKS} SELECT doc_id, block_no, text FROM blocks WHERE NOT {O.is_boilerplate('text')}")
def boilerplate_blocks(s, d):
    return blocks(s, d).where(~T.is_boilerplate(F.col("text"))).select("doc_id", "block_no", "text")


@query(rf"WITH {O.BLOCKS} SELECT doc_id, block_no, {O.trim(r"regexp_replace(text, '\b[0-9]+\s*/\s*[0-9]+\b', '', 'g')")} AS text FROM blocks")
def page_marker_strip(s, d):
    return blocks(s, d).select("doc_id", "block_no", T.drop_page_markers(F.col("text")).alias("text"))


@query(f"WITH {O.BODY} SELECT doc_id, block_no, list_type FROM items WHERE list_type IS NOT NULL")
def list_item_detect(s, d):
    return B.list_items(B.heading_by_font(blocks(s, d))).where("is_list_item").select("doc_id", "block_no", "list_type")


@query(f"WITH {O.BODY} SELECT doc_id, block_no, heading_level FROM heads WHERE is_heading")
def heading_font_ratio(s, d):
    return B.heading_by_font(blocks(s, d)).where("is_heading").select("doc_id", "block_no", "heading_level")


@query(f"WITH {O.BLOCKS} SELECT doc_id, block_no, {O.level('text')} AS level FROM blocks")
def heading_level_infer(s, d):
    return blocks(s, d).select("doc_id", "block_no", T.heading_level(F.col("text")).alias("level"))


@query(f"WITH {O.BLOCKS} SELECT doc_id, block_no, {O.caps('text')} AS caps, {O.page_label('text')} AS label, regexp_matches(text, '{O.CHAPTER}') AS chapter FROM blocks")
def caps_heading(s, d):
    t = F.col("text")
    return blocks(s, d).select("doc_id", "block_no", T.is_short_caps(t).alias("caps"), T.is_page_label(t).alias("label"), T.is_chapter_like(t).alias("chapter"))


@query(f"WITH {O.BLOCKS} SELECT doc_id, block_no, text FROM blocks WHERE lower({O.collapse('text')}) IN ({O.words(T.COMMON_HEADINGS)})")
def common_heading(s, d):
    return blocks(s, d).where(T.is_common_heading(F.col("text"))).select("doc_id", "block_no", "text")


@query(f"SELECT doc_id, {O.collapse('text')} AS text FROM documents")
def whitespace_collapse(s, d):
    return A.table(s, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


ENC = "|".join(sorted(T.ENCLITICS, key=len, reverse=True))
BROKEN = "replace(text, 'tion ', 'tion-' || chr(10))"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace({BROKEN}, '([{T.LETTER}]{{2,}})-\n\s*((?i:{ENC}))([^{T.LETTER}]|$)', '\1-\2\3', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(text, '([{T.LETTER}]{{2,}})-\n\s*([{T.LETTER}]{{2,}})', '\1\2', 'g') AS text FROM t""")
def hyphen_repair(s, d):
    broken = F.replace("text", F.lit("tion "), F.lit("tion-\n"))
    return A.table(s, d, "documents").select("doc_id", T.repair_hyphens(broken).alias("text"))


DIGITS = f"translate(regexp_replace(regexp_replace({{0}}, '([{T.SUPERS}])', '^\\1', 'g'), '([{T.SUBS}])', '_\\1', 'g'), '{T.SUPERS}{T.SUBS}', '01234567890123456789')"
CARETS = r"regexp_replace(regexp_replace({0}, '\^\{{([^}}]+)\}}', '_{{\1}}', 'g'), '([a-zA-Z)\]])\^([0-9]+)', '\1^{{\2}}', 'g')"
SUBDIGITS = r"regexp_replace(regexp_replace({0}, '([a-zA-Z)])([0-9]{{2,}})([a-zA-Z\s,;.]|$)', '\1_{{\2}}\3', 'g'), '([a-zA-Z)])([0-9]{{2,}})([a-zA-Z\s,;.]|$)', '\1_{{\2}}\3', 'g')"


@query(f"SELECT doc_id, {DIGITS.format(SUPER)} AS text FROM documents")
def unicode_scripts(s, d):
    return scripted(s, d).select("doc_id", T.script_digits(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {CARETS.format(DIGITS.format(SUPER))} AS text FROM documents")
def caret_notation(s, d):
    return scripted(s, d).select("doc_id", T.caret_notation(T.script_digits(F.col("text"))).alias("text"))


GLUED = "regexp_replace(text, '([a-z])the ', '\\1' || '23 ', 'g')"


def glued(s, d):
    return A.table(s, d, "documents").select("doc_id", F.regexp_replace("text", "([a-z])the ", "$123 ").alias("text"))


@query(f"SELECT doc_id, {SUBDIGITS.format(GLUED)} AS text FROM documents")
def digit_subscripts(s, d):
    return glued(s, d).select("doc_id", T.digit_subscripts(F.col("text")).alias("text"))


MATH = rf"(regexp_matches({{0}}, '[\^_{T.SUPERS}{T.SUBS}{{{{}}}}]') OR regexp_matches({{0}}, '[a-zA-Z)][0-9]{{{{2,}}}}([a-zA-Z\s,;.]|$)'))"


@query(f"SELECT doc_id, {MATH.format(GLUED)} AS has_math FROM documents")
def math_detect(s, d):
    return glued(s, d).select("doc_id", T.has_math(F.col("text")).alias("has_math"))


@query(f"SELECT doc_id, CASE WHEN {MATH.format(SUPER)} THEN {SUBDIGITS.format(CARETS.format(DIGITS.format(SUPER)))} ELSE {SUPER} END AS text FROM documents")
def math_reconstruct(s, d):
    return scripted(s, d).select("doc_id", T.rebuild_math(F.col("text")).alias("text"))


@query("SELECT doc_id, greatest(1, CAST(length(text) // 3 AS INTEGER)) AS tokens FROM documents")
def token_count(s, d):
    return A.table(s, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(s, d):
    return A.table(s, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(s, d):
    text = F.concat(F.lit("```json\n"), "props", F.lit("\n``` done"))
    return A.table(s, d, "events").select("event_id", T.json_from_text(text, "k int")["k"].alias("k"))


NESTED = "replace(replace(text, 'th', '('), 'on', ')')"


@query(f"""WITH c AS (SELECT doc_id, unnest(string_split(s, '')) AS ch, unnest(range(len(string_split(s, '')))) AS i FROM (SELECT doc_id, {NESTED} AS s FROM documents)),
r AS (SELECT doc_id, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c)
SELECT doc_id, CAST(greatest(0, max(depth)) AS INTEGER) AS depth FROM r GROUP BY 1""")
def tree_depth(s, d):
    return A.table(s, d, "documents").select("doc_id", T.tree_depth(F.expr(NESTED)).alias("depth"))


@query(rf"""WITH {TEXTS} SELECT doc_id, len(list_filter(string_split({O.trim('text')}, chr(10)), lambda x: regexp_matches(x, '^\s*[■•*-]\s*$|^\s*#{{1,6}}\s*$|^\s*\|.*\|\s*$') OR length({O.trim('x')}) < 5))
  > len(string_split({O.trim('text')}, chr(10))) * 0.6 AS formatting FROM texts""")
def formatting_only(s, d):
    return texts(s, d).select("doc_id", T.mostly_formatting(F.col("text")).alias("formatting"))


@query(rf"WITH {O.BLOCKS} SELECT doc_id, block_no, text FROM blocks WHERE regexp_matches({O.trim('text')}, '^\[[0-9]+\]\s+|^[0-9]+\.\s{{2,}}') AND length({O.trim('text')}) < 300")
def footnotes(s, d):
    return B.footnotes(blocks(s, d)).select("doc_id", "block_no", "text")


BACK = "|".join(T.LOOKING_BACK)


@query(rf"""WITH {O.LINES} SELECT doc_id, line_no, list_sort(list_distinct({O.matches('line', T.ANAPHORA)})) AS pronouns, list_sort(list_distinct({O.matches('line', T.PARTIES)})) AS parties,
  regexp_matches(lower(line), '^\s*({BACK})([^a-zà-öø-ÿ0-9_]|$)') AS looks_back FROM lines""")
def anaphora_profile(s, d):
    c = F.col("line")
    pick = lambda w: F.array_sort(F.array_distinct(T.matches(c, w)))
    return A.lines(A.table(s, d, "documents")).select("doc_id", "line_no", pick(T.ANAPHORA).alias("pronouns"), pick(T.PARTIES).alias("parties"), T.starts_looking_back(c).alias("looks_back"))


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\s+'), lambda x: {O.trim('x')}), lambda x: x <> '') AS s FROM documents),
q AS (SELECT doc_id, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: len({O.matches('x', T.ANAPHORA)}) + len({O.matches('x', T.PARTIES)}))), 0) AS total FROM p)
SELECT doc_id, CASE WHEN n < 2 THEN 0.0 ELSE round_even(total / n, 4) END AS density FROM q""")
def coref_density(s, d):
    return A.table(s, d, "documents").select("doc_id", T.coref_density(F.col("text")).alias("density"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(replace(text, 'de ', 'lei ')), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(len(list_filter(w, lambda x: list_contains([{O.words(T.LEGAL_TERMS)}], x))) / greatest(len(w), 1), 6) AS ratio FROM w""")
def legal_term_ratio(s, d):
    return A.table(s, d, "documents").select("doc_id", F.round(T.legal_ratio(F.replace("text", F.lit("de "), F.lit("lei "))), 6).alias("ratio"))


@query(rf"""WITH {O.BLOCKS} SELECT doc_id, block_no, round(length(text) / 500, 6) AS f_chars, round(len(string_split({O.collapse('text')}, ' ')) / 100, 6) AS f_words,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) AS f_digits, CASE WHEN text LIKE '#%' THEN 1.0 ELSE 0.0 END AS f_mark,
  round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / length(text), 6) AS f_punct, CASE WHEN regexp_matches(text, '^[0-9.]+\s') THEN 1.0 ELSE 0.0 END AS f_number FROM blocks WHERE length(text) > 20""")
def feature_vector(s, d):
    t = F.col("text")
    share = lambda p: F.round(F.length(F.regexp_replace(t, p, "")) / F.length(t), 6)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return blocks(s, d).where(F.length(t) > 20).select(
        "doc_id", "block_no", F.round(F.length(t) / 500, 6).alias("f_chars"), F.round(F.size(F.split(T.collapse(t), " ")) / 100, 6).alias("f_words"), share("[^0-9]").alias("f_digits"),
        flag(t.startswith("#")).alias("f_mark"), share("[^.,;:!?]").alias("f_punct"), flag(t.rlike(r"^[0-9.]+\s")).alias("f_number"),
    )


@query(rf"""WITH {O.BLOCKS}, np AS (SELECT doc_id, count(DISTINCT page) AS n FROM blocks GROUP BY 1),
rep AS (SELECT doc_id, t FROM (SELECT doc_id, {O.trim('text')} AS t, count(DISTINCT page) AS k FROM blocks GROUP BY 1, 2) JOIN np USING (doc_id) WHERE t <> '' AND k / n >= 0.6),
f AS (SELECT b.doc_id, block_no, {O.trim('text')} AS t, font_size / median(font_size) OVER (PARTITION BY b.doc_id) AS ratio, y0 / max(y1) OVER (PARTITION BY b.doc_id, page) AS y FROM blocks b),
g AS (SELECT f.*, r.t IS NOT NULL AS rep, length(f.t) < 20 AS short, regexp_matches(f.t, '^[0-9]') AS num, regexp_matches(f.t, '[.!?:;]$') AS ends, regexp_matches(f.t, '^[0-9]+$') AS digits,
  length(f.t) > 1 AND regexp_matches(f.t, '[A-Za-zÀ-ÖØ-öø-ÿ]') AND NOT regexp_matches(f.t, '[a-zß-öø-ÿ]') AS caps FROM f LEFT JOIN rep r ON r.doc_id = f.doc_id AND r.t = f.t),
s AS (SELECT *, CASE WHEN ratio >= 0.9 AND ratio < 1.15 THEN 0.5 ELSE 0 END + CASE WHEN caps THEN 1.5 ELSE 0 END + CASE WHEN short THEN 0.3 ELSE 0 END AS s1,
  CASE WHEN ratio BETWEEN 0.85 AND 1.15 THEN 1.0 ELSE 0 END + CASE WHEN ends THEN 1 ELSE 0 END - CASE WHEN short THEN 1.5 ELSE 0 END - CASE WHEN caps THEN 0.5 ELSE 0 END AS s2,
  CASE WHEN short THEN 1.5 ELSE 0 END + CASE WHEN ends THEN 0 ELSE 0.5 END - CASE WHEN num THEN 0.5 ELSE 0 END AS s3, CASE WHEN y < 0.15 THEN 2 ELSE 0 END + CASE WHEN short THEN 0.5 ELSE 0 END AS s4,
  CASE WHEN y > 0.85 THEN 2 ELSE 0 END + CASE WHEN short THEN 0.5 ELSE 0 END AS s5, CASE WHEN digits THEN 3 ELSE 0 END + CASE WHEN short THEN 1.0 ELSE 0 END AS s6,
  CASE WHEN num THEN 2 ELSE 0 END + CASE WHEN short THEN 0.5 ELSE 0 END AS s7, CASE WHEN short THEN 0.5 ELSE 0 END + CASE WHEN num THEN 0 ELSE 0.3 END AS s8 FROM g),
m AS (SELECT *, greatest(s1, s2, s3, s4, s5, s6, s7, s8) AS top, rep OR (digits AND short AND y > 0.75) OR (ratio < 0.6 AND short) AS noise0 FROM s)
SELECT doc_id, block_no, CASE WHEN ratio >= 1.15 THEN 'heading' WHEN noise0 THEN CASE WHEN digits THEN 'page_number' WHEN y < 0.15 THEN 'header' WHEN y > 0.85 THEN 'footer' ELSE 'noise' END
  WHEN s1 = top THEN 'heading' WHEN s2 = top THEN 'paragraph' WHEN s3 = top THEN 'short_text' WHEN s4 = top THEN 'header' WHEN s5 = top THEN 'footer' WHEN s6 = top THEN 'page_number'
  WHEN s7 = top THEN 'list_item' ELSE 'table_cell' END AS label, NOT ratio >= 1.15 AND noise0 AS noise FROM m""")
def layout_scores(s, d):
    return B.scores(blocks(s, d))


@query(f"WITH {O.BODY} SELECT doc_id, body_size FROM body")
def body_font_mode(s, d):
    return B.body_font(blocks(s, d))


@query(f"WITH {O.BLOCKS} SELECT doc_id, coalesce(median(font_size), 12.0) AS size FROM blocks GROUP BY 1")
def median_font(s, d):
    return blocks(s, d).groupBy("doc_id").agg(F.coalesce(F.median("font_size"), F.lit(12.0)).alias("size"))


@query(f"WITH {O.BLOCKS} SELECT doc_id, page, max(y1) AS height FROM blocks GROUP BY 1, 2")
def page_heights(s, d):
    return blocks(s, d).groupBy("doc_id", "page").agg(F.max("y1").alias("height"))


@query(f"WITH {O.BLOCKS}, np AS (SELECT doc_id, count(DISTINCT page) AS n FROM blocks GROUP BY 1) SELECT doc_id, t AS text, k AS pages FROM (SELECT doc_id, {O.trim('text')} AS t, count(DISTINCT page) AS k FROM blocks GROUP BY 1, 2) JOIN np USING (doc_id) WHERE t <> '' AND k / n >= 0.6")
def repeated_texts(s, d):
    return B.repeated_texts(blocks(s, d))


@query(f"""WITH {O.BLOCKS}, p AS (SELECT doc_id, page, max(y1) AS bottom FROM blocks GROUP BY 1, 2), m AS (SELECT doc_id, median(bottom) AS mid, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT doc_id, mid, n, count(*) FILTER (abs(bottom - mid) < 20) AS near FROM p JOIN m USING (doc_id) GROUP BY ALL)
SELECT doc_id, CASE WHEN near > greatest(2, n * 0.5) THEN mid - 30 END AS footer_y0, CASE WHEN near > greatest(2, n * 0.5) THEN mid END AS footer_y1 FROM k""")
def footer_band(s, d):
    return B.footer_band(blocks(s, d))


@query(f"""WITH {O.BLOCKS}, b AS (SELECT doc_id, round_even((x0 + x1) / 40, 0) * 20 AS bin, count(*) AS n, min(block_no) AS seen FROM blocks GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM b)
SELECT doc_id, bin, n FROM c WHERE k <= 3 AND total > 10 AND n > greatest(5.0, total * 0.05)""")
def column_histogram(s, d):
    return B.column_histogram(blocks(s, d))


@query(f"WITH {O.BLOCKS}, {O.edges(0.6, False, 1)} SELECT * FROM edges")
def hf_candidates_blocks(s, d):
    return B.frequent_edges(blocks(s, d), 0.6, trim=False)


def source_pages(s, d):
    """Blocks of sources taken as documents, each of whose rows is a page."""
    b = blocks(s, d)
    return b.select(F.crc32("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "block_no", "text")


@query(rf"""WITH {O.BLOCKS}, l AS (SELECT source, doc_id AS page, block_no, {O.trim('text')} AS t, count(*) OVER w AS n, row_number() OVER (w ORDER BY block_no) AS r FROM blocks WINDOW w AS (PARTITION BY doc_id)),
e AS (SELECT source, page, t, 'header' AS place FROM l WHERE r <= greatest(1, n // 10) AND length(t) > 5 UNION ALL SELECT source, page, t, 'footer' FROM l WHERE r > n - greatest(1, n // 10) AND length(t) > 5),
c AS (SELECT source, place, t AS text, count(*) AS lines, min(page) AS seen FROM e GROUP BY 1, 2, 3), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM blocks GROUP BY 1)
SELECT source, place, text, lines FROM (SELECT *, row_number() OVER (PARTITION BY source, place ORDER BY lines DESC, seen, text) AS k FROM c) JOIN p USING (source) WHERE k <= 5 AND pages >= 3 AND lines >= greatest(2, 0.1 * pages)""")
def hf_candidates_lines(s, d):
    from ..operators import texts as X

    return X.line_edges(blocks(s, d), "source", "doc_id", 0.1)


@query(f"WITH {O.BLOCKS}, {O.edges(0.5, True, 2)} SELECT doc_id, block_no, text FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = b.doc_id AND e.text = {O.trim('b.text')})")
def strip_hf_lines(s, d):
    b = blocks(s, d)
    return B.without_edges(b, B.frequent_edges(b, 0.5, trim=True, least_per_page=2)).select("doc_id", "block_no", "text")


@query(f"WITH {O.CLASSIFIED} SELECT doc_id, block_no, layout_type, is_noise, is_heading, heading_level FROM classified")
def classify_blocks(s, d):
    return B.classify(blocks(s, d)).select("doc_id", "block_no", "layout_type", "is_noise", "is_heading", "heading_level")


@query(f"WITH {O.CLASSIFIED} SELECT doc_id, block_no, layout_type, text FROM classified WHERE NOT is_noise")
def noise_filter(s, d):
    return B.classify(blocks(s, d)).where("not is_noise").select("doc_id", "block_no", "layout_type", "text")


@query(f"WITH {O.CLASSIFIED} SELECT doc_id, layout_type, count(*) AS n FROM classified GROUP BY 1, 2")
def layout_histogram(s, d):
    return B.classify(blocks(s, d)).groupBy("doc_id", "layout_type").agg(F.count("*").alias("n"))


@query(rf"WITH {O.CLASSIFIED} SELECT doc_id, block_no, h AS text, coalesce(heading_level, 4) AS level, page FROM (SELECT *, split_part({O.trim('text')}, chr(10), 1) AS h FROM classified) WHERE is_heading AND length(h) >= 2 AND NOT {O.is_boilerplate('h')}")
def heading_rebuild(s, d):
    rows = B.classify(blocks(s, d)).where("is_heading").withColumn("h", F.substring_index(T.strip(F.col("text")), "\n", 1))
    return rows.where((F.length("h") >= 2) & ~T.is_boilerplate(F.col("h"))).select("doc_id", "block_no", F.col("h").alias("text"), F.coalesce("heading_level", F.lit(4)).alias("level"), "page")


@query(f"WITH {O.BLOCKS}, f AS (SELECT source, font || ' ' || CAST(font_size AS INTEGER) AS font, count(*) AS n, min(doc_id * 1000 + block_no) AS seen FROM blocks GROUP BY 1, 2) SELECT source, font, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM f) WHERE k <= 10")
def top_fonts(s, d):
    from pyspark.sql import Window

    name = F.concat_ws(" ", "font", F.col("font_size").cast("int"))
    f = blocks(s, d).groupBy("source", name.alias("font")).agg(F.count("*").alias("n"), F.min(F.col("doc_id") * 1000 + F.col("block_no")).alias("seen"))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "seen"))).where("k <= 10").select("source", "font", "n")


SECTIONS = f"""{O.CLASSIFIED}, sec AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section FROM classified)"""


@query(f"WITH {SECTIONS} SELECT doc_id, block_no, CAST(section AS BIGINT) AS section FROM sec")
def sections(s, d):
    return B.section_ids(B.classify(blocks(s, d)), F.col("is_heading")).select("doc_id", "block_no", "section")


@query(f"""WITH {SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, arg_min(substr(split_part({O.trim('text')}, chr(10), 1), 1, 100), block_no) FILTER (is_heading) AS heading, min(page) AS page,
  CAST(sum(CASE WHEN is_heading THEN 0 ELSE length(text) END) AS BIGINT) AS char_count, CAST(count(*) FILTER (NOT is_heading) AS BIGINT) AS block_count FROM sec GROUP BY 1, 2""")
def section_stats(s, d):
    return B.sections(B.classify(blocks(s, d)))


@query(f"WITH {O.BLOCKS}, t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS idx FROM blocks WHERE text LIKE '|%') SELECT doc_id, CAST(idx AS INTEGER) AS idx, len(string_split(text, chr(10))) AS n_lines, substr(text, 1, 200) AS preview FROM t WHERE idx < 20")
def table_summary(s, d):
    rows = blocks(s, d).where(F.col("text").startswith("|")).withColumn("idx", F.row_number().over(B._in_doc()) - 1).where("idx < 20")
    return rows.select("doc_id", "idx", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.substring("text", 1, 200).alias("preview"))


@query(f"WITH {O.CLASSIFIED} SELECT doc_id, max(page) + 1 AS pages, count(*) AS text_blocks, count(*) FILTER (is_heading) AS headings, count(*) FILTER (text LIKE '|%') AS tables FROM classified GROUP BY 1")
def doc_stats(s, d):
    c = B.classify(blocks(s, d))
    return c.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("text_blocks"), F.sum(F.col("is_heading").cast("long")).alias("headings"), F.sum(F.col("text").startswith("|").cast("long")).alias("tables"))


@query(rf"""WITH {O.BODY}, texts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1),
t AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '[{T.LETTER}]+-\n[{T.LETTER}]+')) AS broken,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({O.trim('x')}, '^[A-Za-zÀ-ÿ]{{1,4}}$') AND NOT regexp_matches({O.trim('x')}, '^[IVXLCDM]+$'))) AS orphans, length(text) / len(string_split(text, chr(10))) AS mean FROM texts),
x AS (SELECT doc_id, x0, x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0) AS gap FROM (SELECT DISTINCT doc_id, x0 FROM blocks)), c AS (SELECT doc_id, 1 + count(*) FILTER (gap > 50) AS cols FROM x GROUP BY 1),
b AS (SELECT doc_id, max(page) + 1 AS pages, sum(length(text)) AS chars, count(*) FILTER (is_heading) AS heads, count(*) FILTER (contains(text, '|') AND length(text) > 50) AS tables FROM heads GROUP BY 1),
q AS (SELECT doc_id, floor((1 - least(1.0, broken / greatest(n * 0.02, 1.0))) * 100 + 0.5) / 100 AS hyphenation, floor((1 - least(1.0, orphans / greatest(n * 0.05, 1.0))) * 100 + 0.5) / 100 AS orphan_lines,
  floor((CASE WHEN chars > 0 THEN greatest(0.1, least(1.0, chars / (pages * 2000))) ELSE 0.0 END) * 100 + 0.5) / 100 AS text_coverage, floor((least(1.0, heads / (pages * 2))) * 100 + 0.5) / 100 AS headings,
  floor((least(1.0, tables / greatest(pages * 0.1, 1.0))) * 100 + 0.5) / 100 AS tables, 1.0 AS ocr_quality, floor((least(1.0, mean / greatest(35.0, 80.0 - (cols - 1) * 20))) * 100 + 0.5) / 100 AS line_quality FROM b JOIN t USING (doc_id) JOIN c USING (doc_id))
SELECT *, floor(((hyphenation + orphan_lines + text_coverage + headings + tables + ocr_quality + line_quality) / 7) * 100 + 0.5) / 100 AS overall FROM q""")
def quality_score(s, d):
    return B.quality(B.heading_by_font(blocks(s, d)), texts(s, d))
