"""Shared DuckDB CTEs: the adapters' tables in SQL."""

from __future__ import annotations

from ..functions import text as T
from ..sources.adapters import HELD, PLACE, TRIGGER

LINES = """lines AS (SELECT doc_id, source, CAST(i AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""
BLOCKS = f"""{LINES},
blocks AS (SELECT doc_id, source, i AS block_no, p AS page, 'text' AS type, text,
  CASE WHEN length(text) < 25 THEN 18.0::DOUBLE WHEN length(text) < 60 THEN 14.0 ELSE 11.0 END AS font_size,
  CASE WHEN length(text) < 25 AND doc_id % 2 = 0 THEN 'Test-Bold' ELSE 'Test-Regular' END AS font,
  CASE WHEN i % 2 = 0 THEN 50.0::DOUBLE ELSE 320.0 END AS x0, (72.0 + 80 * (i % 8))::DOUBLE AS y0,
  CASE WHEN i % 2 = 0 THEN 290.0::DOUBLE ELSE 560.0 END AS x1, (138.0 + 80 * (i % 8))::DOUBLE AS y1
  FROM (SELECT doc_id, source, CAST(p * 8 + {PLACE} AS INTEGER) AS i, p, {TRIGGER} AS text FROM (
    SELECT *, line_no % r AS j, least(r, n - p * r) AS m, unnest([0, 1, 2, 3]) AS s FROM (SELECT *, CAST(line_no // r AS INTEGER) AS p FROM (
      SELECT *, doc_id AS d, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS h, CASE WHEN doc_id % 3 < 2 THEN 5 ELSE 7 END AS r,
        count(*) OVER (PARTITION BY doc_id) AS n FROM lines))) WHERE {HELD}))"""


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def words(names) -> str:
    return ", ".join("'" + n + "'" for n in names)


def matches(x: str, names) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-zà-öø-ÿ0-9_]+'), lambda w: list_contains([{words(names)}], w))"


def is_boilerplate(x: str) -> str:
    return f"regexp_matches({trim(x)}, '{T.BOILERPLATE}')"


ROMAN_UP, LETTER_UP, APP_DOT = r"^\s*[IVXLCDM]+\.\s", r"^\s*[A-Z]\.\s", r"^\s*(?i:APP[.])"


def level(x: str) -> str:
    n = {k: v.replace("'", "''") for k, v in T.NUMBERING.items()}
    m = lambda p: f"regexp_matches({x}, '{p}')"
    return rf"""CASE WHEN {m(n['dotted'])} THEN CASE WHEN {m(n['deep'])} THEN 3 ELSE 2 END
      WHEN {m(n['lone'])} AND NOT {m(n['data'])} THEN 1 WHEN {m(ROMAN_UP)} THEN 1 WHEN {m(LETTER_UP)} THEN 2
      WHEN {m(n['roman'])} OR {m(n['letter'])} THEN 2 WHEN {m(n['keyword'])} THEN 1
      WHEN {m(n['appendix'])} THEN CASE WHEN {m(APP_DOT)} THEN 2 ELSE 1 END END"""


PAGE_LABEL = T.PAGE_LABEL
CHAPTER = r"^\s*(?i:cap[iíÍ]tulo|se[cçÇ][aãÃ]o|parte|t[iíÍ]tulo|livro)\s+[0-9]+"


def page_label(x: str) -> str:
    return rf"(regexp_matches({x}, '^\s*[0-9]+\s*$') OR regexp_matches({x}, '{PAGE_LABEL}'))"


def caps(x: str) -> str:
    return rf"regexp_matches({x}, '^\s*[A-ZÀ-Ú][A-ZÀ-Ú\s]{{2,30}}$')"


BODY = f"""{BLOCKS},
sized AS (SELECT doc_id, round(font_size, 1) AS size, sum(CASE WHEN length({trim('text')}) > 1 AND font_size BETWEEN 7 AND 30 THEN length(text) END) AS mass,
  min(CASE WHEN length({trim('text')}) > 1 AND font_size BETWEEN 7 AND 30 THEN block_no END) AS seen FROM blocks GROUP BY 1, 2),
body AS (SELECT doc_id, coalesce(max(body_size), 12.0) AS body_size FROM (
  SELECT doc_id, CASE WHEN mass IS NOT NULL AND row_number() OVER (PARTITION BY doc_id ORDER BY mass DESC NULLS LAST, seen) = 1 THEN size END AS body_size FROM sized) GROUP BY 1),
fonts AS (SELECT b.*, body_size, (font_size / body_size >= 1.2 OR (font_size / body_size >= 1.0 AND (contains(font, 'Bold') OR contains(font, 'Black')))) AS is_heading FROM blocks b JOIN body USING (doc_id)),
heads AS (SELECT *, CASE WHEN is_heading THEN CASE WHEN font_size / body_size >= 1.8 THEN 1 WHEN font_size / body_size >= 1.5 THEN 2 WHEN font_size / body_size >= 1.3 THEN 3 ELSE 4 END END AS heading_level FROM fonts),
items AS (SELECT *, CASE WHEN is_heading THEN NULL WHEN regexp_matches(text, '^[-•–*]\\s') THEN 'bullet' WHEN regexp_matches(text, '^([0-9]+|[a-z])[.)]\\s') THEN 'ordered' END AS list_type FROM heads)"""


def edges(ratio: float, trimmed: bool, per_page: int) -> str:
    t = trim("text") if trimmed else "text"
    return f"""ranked AS (SELECT doc_id, page, {t} AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) AS f,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no DESC) AS l, count(*) OVER (PARTITION BY doc_id, page) AS n FROM blocks),
cand AS (SELECT doc_id, page, t, 'header' AS place FROM ranked WHERE f = 1 AND n >= {per_page} UNION ALL SELECT doc_id, page, t, 'footer' FROM ranked WHERE l = 1 AND n >= {per_page}),
counted AS (SELECT doc_id, place, t, count(*) AS pages, min(page) AS seen FROM cand GROUP BY ALL),
np AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM blocks GROUP BY 1),
edges AS (SELECT doc_id, place, t AS text, pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY pages DESC, seen) AS k FROM counted) JOIN np USING (doc_id)
  WHERE k <= 5 AND pages >= greatest(2, n_pages * {ratio}) AND length(t) > 5)"""


CLASSIFIED = rf"""{BODY}, {edges(0.5, True, 2)},
placed AS (SELECT doc_id, text AS t, max(place) AS place FROM edges GROUP BY 1, 2),
pre AS (SELECT i.*, {trim('i.text')} AS t, place FROM items i LEFT JOIN placed p ON p.doc_id = i.doc_id AND p.t = {trim('i.text')}),
flagged AS (SELECT *, coalesce({level('t')}, {level(collapse('t'))}) AS lv, lower({collapse('t')}) IN ({words(T.COMMON_HEADINGS)}) AS common,
  ({caps('t')} OR {caps(collapse('t'))}) AS caps, regexp_matches(t, '{CHAPTER}') AS chap FROM pre),
labelled AS (SELECT *, CASE WHEN {page_label('t')} THEN 'page_number' WHEN place = 'header' THEN 'header' WHEN place = 'footer' THEN 'footer'
  WHEN lv IS NOT NULL OR is_heading OR chap OR common THEN 'heading' WHEN list_type IS NOT NULL THEN 'list_item' WHEN caps THEN 'heading'
  WHEN length(t) < 15 THEN 'short_text' ELSE 'paragraph' END AS layout_type FROM flagged),
classified AS (SELECT doc_id, source, block_no, page, type, text, font_size, x0, y0, x1, y1, list_type, layout_type, layout_type IN ('header', 'footer', 'page_number') AS is_noise,
  is_heading OR (layout_type = 'heading' AND (lv IS NOT NULL OR common OR caps) AND NOT (chap AND lv IS NULL)) AS is_heading,
  CASE WHEN layout_type = 'heading' AND lv IS NOT NULL THEN lv WHEN layout_type = 'heading' AND is_heading THEN heading_level
    WHEN layout_type = 'heading' AND chap THEN heading_level WHEN layout_type = 'heading' AND common THEN 1 WHEN layout_type = 'heading' AND caps THEN 2 ELSE heading_level END AS heading_level FROM labelled)"""
