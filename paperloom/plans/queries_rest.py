"""Queries over joins, windows, chunks, retrieval, rendering and state, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import render as R
from ..operators import retrieval as V
from ..operators import state as S
from ..operators.tables import KeyedTable, shared_folder
from ..sources import adapters as A
from ..streaming import jobs as J
from . import oracle_base as O
from .queries_blocks import BACK, blocks, texts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(s, d):
    return A.lines(A.table(s, d, "documents"))


def segments(s, d):
    """Lines as segments (doc_id, seg_no, text, depth, heading, page)."""
    l = lines(s, d)
    return l.select("doc_id", F.col("line_no").alias("seg_no"), F.col("line").alias("text"), (F.col("line_no") % 4).alias("depth"), F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("h"), F.col("line_no").cast("string"))).alias("heading"), F.floor(F.col("line_no") / 5).cast("int").alias("page"))


SEGS = f"{O.LINES}, segs AS (SELECT doc_id, line_no AS seg_no, line AS text, line_no % 4 AS depth, CASE WHEN line_no % 3 = 1 THEN 'h' || line_no END AS heading, line_no // 5 AS page FROM lines)"
CLASS = O.CLASSIFIED


# Joins


EXTERNAL = "CASE WHEN block_no % 10 = 0 THEN 'header' WHEN block_no % 10 = 4 THEN 'footer' WHEN block_no % 2 = 0 THEN 'list_item' ELSE 'caption' END"


@query(f"""WITH {O.BODY}, labels2 AS (SELECT doc_id, page, {O.trim('text')} AS t, {EXTERNAL} AS type, 0.5 + (block_no % 5) / 10 AS confidence, block_no AS pos FROM blocks WHERE block_no % 3 <> 1),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, t ORDER BY pos) AS k FROM labels2) WHERE k = 1), edge AS (SELECT doc_id, t, min(type) AS edge FROM labels2 WHERE type IN ('header', 'footer') GROUP BY 1, 2),
m AS (SELECT b.doc_id, b.block_no, CASE WHEN is_heading THEN 'heading' ELSE coalesce(edge, o.type, 'paragraph') END AS layout_type, round(o.confidence, 4) AS confidence FROM heads b
  LEFT JOIN one o ON o.doc_id = b.doc_id AND o.page = b.page AND o.t = {O.trim('b.text')} LEFT JOIN edge e ON e.doc_id = b.doc_id AND e.t = {O.trim('b.text')})
SELECT *, layout_type IN ('header', 'footer', 'page_number') AS is_noise FROM m""")
def classified_merge(s, d):
    b = B.heading_by_font(blocks(s, d))
    labels = b.where("block_no % 3 <> 1").select("doc_id", "page", "text", F.expr(EXTERNAL).alias("type"), (0.5 + (F.col("block_no") % 5) / 10).alias("confidence"), F.col("block_no").alias("pos"))
    return B.merge_labels(b, labels).select("doc_id", "block_no", "layout_type", F.round("confidence", 4).alias("confidence"), "is_noise")


def mixed_blocks(s, d):
    """Classified blocks with table rows as table blocks and some blocks as images, and the tables' texts."""
    kind = F.when(F.col("text").startswith("|"), "table").when((F.col("block_no") % 7 == 6), "image").otherwise("text")
    b = blocks(s, d)
    c = B.classify(b).withColumn("type", kind)
    flat = F.col("type") != "text"
    c = c.withColumn("is_heading", F.col("is_heading") & ~flat).withColumn("is_list_item", F.col("is_list_item") & ~flat).withColumn("layout_type", F.when(~flat, F.col("layout_type")))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")) - 1
    tables = b.withColumn("type", kind).where("type = 'table' and block_no % 10 <> 7").select("doc_id", k.alias("k"), F.concat(F.lit("| t"), F.col("block_no").cast("string"), F.lit(" | x |")).alias("md"))
    return c, tables


MIXED = f"""{CLASS}, mixed AS (SELECT * REPLACE (CASE WHEN text LIKE '|%' THEN 'table' WHEN block_no % 7 = 6 THEN 'image' ELSE 'text' END AS type) FROM classified),
mb AS (SELECT * REPLACE (is_heading AND type = 'text' AS is_heading, CASE WHEN type = 'text' THEN list_type END AS list_type, CASE WHEN type = 'text' THEN layout_type END AS layout_type) FROM mixed),
tabs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS k, '| t' || block_no || ' | x |' AS md FROM mb WHERE type = 'table' AND block_no % 10 <> 7),
zip AS (SELECT m.*, t.md AS table_md FROM (SELECT *, CASE WHEN type = 'table' THEN count(*) FILTER (type = 'table') OVER (PARTITION BY doc_id ORDER BY block_no) - 1 END AS k FROM mb) m LEFT JOIN tabs t ON t.doc_id = m.doc_id AND t.k = m.k)"""


@query(f"WITH {MIXED} SELECT doc_id, block_no, table_md FROM zip WHERE type = 'table'")
def table_ordinal_join(s, d):
    return R.with_tables(*mixed_blocks(s, d)).where("type = 'table'").select("doc_id", "block_no", "table_md")


GAPS = f"""{O.BLOCKS}, nb AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, block_no) AS nx, count(*) OVER (PARTITION BY doc_id, page) AS n FROM blocks),
gp AS (SELECT doc_id, page, nx - x1 AS gap, (nx + x1) / 2 AS mid FROM nb WHERE n >= 3 AND nx - x1 > 15),
md AS (SELECT doc_id, page, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS med FROM gp GROUP BY 1, 2),
bounds AS (SELECT doc_id, page, coalesce(list_sort(list_distinct(list(mid) FILTER (abs(gap - med) < med / 2))), []) AS boundaries FROM gp JOIN md USING (doc_id, page) GROUP BY 1, 2)"""


@query(f"WITH {GAPS} SELECT doc_id, page, boundaries FROM bounds")
def column_gaps(s, d):
    return B.column_gaps(blocks(s, d))


@query(f"WITH {GAPS} SELECT b.doc_id, b.block_no, coalesce(len(list_filter(boundaries, lambda x: x <= (x0 + x1) / 2)), 0) AS col FROM blocks b LEFT JOIN bounds USING (doc_id, page)")
def column_assign_range(s, d):
    b = blocks(s, d)
    return B.assign_columns(b, B.column_gaps(b)).select("doc_id", "block_no", F.col("col").cast("long").alias("col"))


@query(f"""WITH {GAPS}, c AS (SELECT b.*, coalesce(len(list_filter(boundaries, lambda x: x <= (x0 + x1) / 2)), 0) AS col FROM blocks b LEFT JOIN bounds USING (doc_id, page))
SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, y0, block_no) - 1 AS pos FROM c""")
def reading_order(s, d):
    b = blocks(s, d)
    return B.reading_order(b, B.column_gaps(b)).select("doc_id", "page", "block_no", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {O.BLOCKS}, p AS (SELECT doc_id, page, sum(length(text) + 1) AS n FROM blocks GROUP BY 1, 2), o AS (SELECT doc_id, page, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM p),
q AS (SELECT doc_id, unnest([0, 700, 1500, 100000]) AS pos FROM (SELECT DISTINCT doc_id FROM blocks)) SELECT q.doc_id, CAST(q.pos AS INTEGER) AS pos, max(o.page) AS page FROM q JOIN o ON o.doc_id = q.doc_id AND o.lo <= q.pos GROUP BY 1, 2""")
def page_lookup_asof(s, d):
    p = blocks(s, d).groupBy("doc_id", "page").agg(F.sum(F.length("text") + 1).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "page"))).alias("starts"))
    asked = starts.withColumn("pos", F.explode(F.array(*map(F.lit, [0, 700, 1500, 100000]))))
    return asked.select("doc_id", "pos", F.element_at(F.filter("starts", lambda x: x["lo"] <= F.col("pos")), -1)["page"].alias("page"))


@query(rf"""WITH {CLASS}, l AS (SELECT doc_id, block_no AS seg_no, split_part({O.trim('text')}, chr(10), 1) AS first, text FROM classified), h AS (SELECT doc_id, block_no, {O.trim('text')} AS t, coalesce(heading_level, 1) AS lv FROM classified WHERE is_heading),
m AS (SELECT l.doc_id, seg_no, arg_min(lv, block_no) AS lv FROM l JOIN h ON h.doc_id = l.doc_id AND contains(first, t) GROUP BY 1, 2)
SELECT l.doc_id, seg_no, coalesce(lv, CASE WHEN regexp_matches(text, '^#{{1,6}}\s') THEN length(regexp_extract(text, '^(#+)', 1)) WHEN regexp_matches(text, '^[0-9]+\.[0-9]+\.\s') THEN 2 WHEN regexp_matches(text, '^[0-9]+\.\s') THEN 1 ELSE 0 END) AS depth FROM l LEFT JOIN m USING (doc_id, seg_no)""")
def depth_contains_join(s, d):
    c = B.classify(blocks(s, d))
    head = F.when(F.col("is_heading"), F.struct("block_no", T.strip(F.col("text")).alias("t"), F.coalesce("heading_level", F.lit(1)).alias("lv")))
    l = c.select("doc_id", F.col("block_no").alias("seg_no"), F.substring_index(T.strip(F.col("text")), "\n", 1).alias("first"), "text", F.collect_list(head).over(Window.partitionBy("doc_id")).alias("heads"))
    l = l.withColumn("lv", F.array_min(F.filter("heads", lambda h: F.col("first").contains(h["t"])))["lv"])
    x = F.col("text")
    rule = F.when(x.rlike(r"^#{1,6}\s"), F.length(F.regexp_extract(x, "^(#+)", 1))).when(x.rlike(r"^[0-9]+\.[0-9]+\.\s"), 2).when(x.rlike(r"^[0-9]+\.\s"), 1).otherwise(0)
    return l.select("doc_id", "seg_no", F.coalesce("lv", rule).cast("long").alias("depth"))


@query(f"WITH {O.BLOCKS} SELECT doc_id, block_no FROM blocks WHERE (x0 + x1) / 2 BETWEEN 40.0 + page % 4 * 20 AND 300.0 AND (y0 + y1) / 2 BETWEEN 100.0 AND 400.0")
def point_in_region(s, d):
    b = blocks(s, d)
    regions = b.select("doc_id", "page").distinct().select("doc_id", "page", (F.col("page") % 4 * 20 + 40.0).alias("rx0"), F.lit(100.0).alias("ry0"), F.lit(300.0).alias("rx1"), F.lit(400.0).alias("ry1"))
    return B.inside(b, regions).select("doc_id", "block_no")


@query(f"WITH {O.BLOCKS} SELECT a.doc_id, a.page, a.block_no AS a, b.block_no AS b FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_no < b.block_no AND a.y0 - 30 < b.y1 AND b.y0 - 30 < a.y1")
def interval_overlap_pairs(s, d):
    return B.overlap_pairs(blocks(s, d).withColumn("y0", F.col("y0") - 30))


MSGS = "msgs AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at FROM conversations), sess AS (SELECT session_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_messages FROM msgs GROUP BY 1)"
AS_OF = "timestamp'2024-01-05 00:00:00'"


def messages(s, d):
    return A.messages(A.table(s, d, "conversations"))


@query(f"WITH {MSGS} SELECT session_id, seq FROM msgs WHERE session_id IN (SELECT session_id FROM sess WHERE updated_at < TIMESTAMP '2024-01-01 10:00:00')")
def old_session_messages(s, d):
    m = messages(s, d)
    return m.join(S.session_view(m).where("updated_at < timestamp'2024-01-01 10:00:00'"), "session_id", "left_semi").select("session_id", "seq")


@query(f"WITH {MSGS} SELECT session_id, seq FROM msgs WHERE session_id NOT IN (SELECT session_id FROM sess WHERE updated_at < TIMESTAMP '2024-01-01 10:00:00')")
def recent_session_messages(s, d):
    m = messages(s, d)
    return m.join(S.session_view(m).where("updated_at < timestamp'2024-01-01 10:00:00'"), "session_id", "left_anti").select("session_id", "seq")


# Windows and folds


@query(f"WITH {O.BLOCKS} SELECT DISTINCT doc_id, page, first_value(text) OVER w AS first, last_value(text) OVER w AS last FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_per_page(s, d):
    return blocks(s, d).groupBy("doc_id", "page").agg(F.min_by("text", "block_no").alias("first"), F.max_by("text", "block_no").alias("last"))


@query(f"WITH {O.LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, line_no, r <= greatest(1, n // 10) AS head, r > n - greatest(1, n // 10) AS tail FROM r WHERE r <= greatest(1, n // 10) OR r > n - greatest(1, n // 10)")
def head_tail_decile(s, d):
    w = Window.partitionBy("doc_id")
    r = lines(s, d).withColumn("r", F.row_number().over(w.orderBy("line_no"))).withColumn("n", F.count("*").over(w)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    return r.withColumn("head", F.col("r") <= F.col("k")).withColumn("tail", F.col("r") > F.col("n") - F.col("k")).where("head or tail").select("doc_id", "line_no", "head", "tail")


@query(f"WITH {O.LINES} SELECT doc_id, line_no, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, CAST(sum(length(line)) OVER w - length(line) AS BIGINT) AS start_char, CAST(sum(length(line)) OVER w AS BIGINT) AS end_char FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def running_offsets(s, d):
    return C.numbered(lines(s, d).withColumnRenamed("line", "text"), ["line_no"]).select("doc_id", "line_no", F.col("index").alias("idx"), "start_char", "end_char")


ORPHAN_IN = f"{O.BLOCKS}, texts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1), li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM texts)"


@query(rf"""WITH {ORPHAN_IN}, f AS (SELECT *, regexp_matches({O.trim('t')}, '^[A-Za-zÀ-ÿ]{{1,3}}$') AND lag(t) OVER w IS NOT NULL AND lag(t) OVER w <> '' AS o FROM li WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
j AS (SELECT doc_id, g, CASE WHEN count(*) = 1 THEN max(t) ELSE string_agg(CASE WHEN o THEN {O.trim('t')} ELSE regexp_replace(t, '\s+$', '') END, ' ' ORDER BY i) END AS line FROM g GROUP BY 1, 2) SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS text FROM j GROUP BY 1""")
def orphan_merge(s, d):
    return C.orphan_merge(texts(s, d))


CHUNKS = f"{O.LINES}, ch AS (SELECT doc_id, line_no AS idx, line AS text, CASE WHEN line_no % 2 = 0 THEN 'h' || line_no END AS heading, greatest(1, length(line) // 3) AS tokens FROM lines)"


def line_chunks(s, d):
    l = lines(s, d)
    return l.select("doc_id", F.col("line_no").alias("index"), F.col("line").alias("text"), F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("h"), F.col("line_no").cast("string"))).alias("heading"), T.token_count(F.col("line")).alias("tokens"))


@query(f"""WITH {CHUNKS}, a AS (SELECT *, tokens < 50 AS small, tokens < 50 AND NOT coalesce(lag(tokens < 50) OVER w, false) AS new FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
b AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM a), c AS (SELECT *, small AND row_number() OVER (PARTITION BY doc_id, run, small ORDER BY idx) % 2 = 1 AND lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) IS NOT NULL AS head FROM b),
e AS (SELECT *, coalesce(lag(head) OVER w, false) AS taken, CASE WHEN head THEN text || chr(10) || chr(10) || lead(text) OVER w ELSE text END AS t, CASE WHEN head THEN coalesce(heading, lead(heading) OVER w) ELSE heading END AS h FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, t AS text, h AS heading, CAST(greatest(1, length(t) // 3) AS INTEGER) AS tokens FROM e WHERE NOT taken""")
def tiny_chunk_merge(s, d):
    return C.merge_tiny(line_chunks(s, d)).withColumnRenamed("index", "idx")


PACK = f"""{O.LINES}, pr AS (SELECT doc_id, line_no AS i, line AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
fold AS (SELECT doc_id, i, n, p AS buf, CAST(NULL AS VARCHAR) AS done FROM pr WHERE i = 0 UNION ALL
  SELECT f.doc_id, pr.i, pr.n, CASE WHEN f.buf = '' THEN pr.p WHEN greatest(1, length(f.buf) // 3) + greatest(1, length(pr.p) // 3) <= 300 THEN f.buf || chr(10) || chr(10) || pr.p ELSE pr.p END,
    CASE WHEN f.buf <> '' AND greatest(1, length(f.buf) // 3) + greatest(1, length(pr.p) // 3) > 300 THEN f.buf END FROM fold f JOIN pr ON pr.doc_id = f.doc_id AND pr.i = f.i + 1),
parts AS (SELECT doc_id, i AS pl, done AS text FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, n, buf FROM fold WHERE i = n - 1 AND {O.trim('buf')} <> '')"""


@query(f"WITH RECURSIVE {PACK} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pl) - 1 AS INTEGER) AS k, {O.trim('text')} AS text, CAST(greatest(1, length({O.trim('text')}) // 3) AS INTEGER) AS tokens FROM parts")
def greedy_pack(s, d):
    t = A.table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return t.select("doc_id", F.posexplode(C.greedy_pack(F.col("text"), 300)).alias("k", "c")).select("doc_id", "k", "c.text", "c.tokens")


@query("""WITH c AS (SELECT doc_id, text, greatest(0, CAST(ceil((length(text) - 902) / 250) AS INTEGER)) AS n FROM documents), r AS (SELECT doc_id, text, n, unnest(range(n + 1)) AS k FROM c)
SELECT doc_id, CAST(k AS INTEGER) AS k, CASE WHEN k < n THEN substr(text, k * 250 + 1, 300) ELSE substr(text, k * 250 + 1) END AS text FROM r""")
def fixed_cut_overlap(s, d):
    return A.table(s, d, "documents").select("doc_id", F.posexplode(C.fixed_cuts(F.col("text"), 300, 50)).alias("k", "text"))


def words_n(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


SHORTENED = "CASE WHEN seg_no % 3 = 2 THEN substr(text, 1, 40) ELSE text END"


@query(f"""WITH {SEGS}, a AS (SELECT doc_id, seg_no, depth, heading, page, t AS text, {words_n('t')} AS n FROM (SELECT *, {SHORTENED} AS t FROM segs)),
b AS (SELECT *, last_value(CASE WHEN n >= 10 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS big FROM a),
c AS (SELECT *, sum(CASE WHEN n < 10 AND coalesce(big, 0) > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seg_no) AS g FROM b)
SELECT doc_id, min(seg_no) AS seg_no, string_agg(text, chr(10) || chr(10) ORDER BY seg_no) AS text, max(depth) AS depth, arg_min(heading, seg_no) FILTER (heading IS NOT NULL) AS heading, arg_min(page, seg_no) AS page FROM c GROUP BY doc_id, g""")
def min_size_merge(s, d):
    return C.merge_short(segments(s, d).withColumn("text", F.expr(SHORTENED)))


def risky(x: str) -> str:
    return rf"(len({O.matches(x, T.ANAPHORA)}) > 0 OR regexp_matches(lower(split_part({x}, chr(10), 1)), '^\s*({BACK})([^a-zà-öø-ÿ0-9_]|$)'))"


ISLES = f"""f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) = 1 OR NOT {risky('text')} THEN 1 ELSE 0 END AS st FROM segs),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY seg_no) AS g FROM f),
merged AS (SELECT doc_id, min(seg_no) AS seg_no, string_agg(text, chr(10) || chr(10) ORDER BY seg_no) AS text, max(depth) AS depth, arg_min(heading, seg_no) FILTER (heading IS NOT NULL) AS heading, arg_min(page, seg_no) AS page FROM g GROUP BY doc_id, g)"""


@query(f"WITH {SEGS}, {ISLES} SELECT * FROM merged")
def orphan_segment_merge(s, d):
    return C.merge_anaphoric(segments(s, d))


@query(rf"WITH {O.BLOCKS}, o AS (SELECT *, regexp_matches({O.trim('text')}, '^(?i:refer[eê]ncias|bibliografia|references|bibliography)') AS op FROM blocks), r AS (SELECT *, bool_or(op) OVER (PARTITION BY doc_id ORDER BY block_no) AS inr FROM o) SELECT doc_id, block_no, text FROM r WHERE inr AND NOT op AND regexp_matches({O.trim('text')}, '^[A-ZÀ-ɂ][0-9A-Za-z_À-ɂ]+.*\([0-9]{{4}}\)')")
def refs_after_heading(s, d):
    b = blocks(s, d).withColumn("text", F.when(F.col("block_no") == 1, "References").otherwise(F.col("text")))
    return B.references_after_heading(b).select("doc_id", "block_no", "text")


ORACLES["refs_after_heading"] = ORACLES["refs_after_heading"].replace("AS op FROM blocks)", "AS op FROM (SELECT * REPLACE (CASE WHEN block_no = 1 THEN 'References' ELSE text END AS text) FROM blocks))")


@query(f"WITH {O.BODY}, r AS (SELECT *, list_type IS NOT NULL AND NOT coalesce(lag(list_type IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY block_no), false) AS st FROM items) SELECT doc_id, block_no, run FROM (SELECT *, CAST(count(*) FILTER (st) OVER (PARTITION BY doc_id ORDER BY block_no) AS BIGINT) AS run FROM r) WHERE list_type IS NOT NULL")
def list_runs(s, d):
    return B.list_runs(B.list_items(B.heading_by_font(blocks(s, d)))).where("is_list_item").select("doc_id", "block_no", "run")


@query(f"""WITH {O.LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines), c AS (SELECT doc_id, line_no, k, substr(line, 1, 600) AS text FROM k WHERE k <= 20 AND length(line) >= 30),
r AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no) AS spent FROM c), z AS (SELECT *, min(k) FILTER (spent > 1500) OVER (PARTITION BY doc_id) AS stop FROM r) SELECT doc_id, line_no, text FROM z WHERE stop IS NULL OR k < stop""")
def char_budget(s, d):
    return C.char_budget(lines(s, d).select("doc_id", "line_no", F.col("line").alias("text")), "line_no", 20, 30, 600, 1500)


@query(f"WITH {O.LINES}, n AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS total FROM lines) SELECT doc_id, line_no FROM n WHERE line_no % greatest(1, total // 5) = 0 OR line_no = total - 1")
def progress_throttle(s, d):
    l = lines(s, d).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return S.throttle(l, "total", "line_no", 5).select("doc_id", "line_no")


# Top-k and sets


@query(f"WITH {O.LINES}, r AS (SELECT *, row_number() OVER w AS k, CAST(ceil(count(*) OVER (PARTITION BY doc_id) / 4) AS INTEGER) AS total_pages FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no, total_pages FROM r WHERE k BETWEEN 5 AND 8")
def pagination(s, d):
    return S.page_of(lines(s, d), ["line_no"], 2, 4, "doc_id").select("doc_id", "line_no", "total_pages")


@query(f"WITH {MSGS} SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS k FROM msgs) WHERE k <= 3")
def history_oldest_n(s, d):
    return S.history(messages(s, d), 3).select("session_id", "seq")


@query(f"WITH {MSGS} SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS k FROM msgs) WHERE k <= 3")
def history_newest_n(s, d):
    return S.history(messages(s, d), 3, newest=True).select("session_id", "seq")


@query(f"WITH {MSGS} SELECT session_id, updated_at FROM sess ORDER BY updated_at DESC, session_id LIMIT 10")
def recent_sessions(s, d):
    return S.session_view(messages(s, d)).orderBy(F.desc("updated_at"), "session_id").limit(10).select("session_id", "updated_at")


@query(f"WITH {O.LINES}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM lines) SELECT doc_id, line_no, array_to_string(list_filter(string_split(line, ' '), lambda x: NOT list_contains(string_split(coalesce(prev, ''), ' '), x) OR length(x) > 8), ' ') AS fresh FROM p")
def new_lines(s, d):
    p = lines(s, d).withColumn("prev", F.coalesce(F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit("")))
    return p.select("doc_id", "line_no", F.array_join(F.filter(F.split("line", " "), lambda x: ~F.array_contains(F.split("prev", " "), x) | (F.length(x) > 8)), " ").alias("fresh"))


@query(f"WITH {O.LINES} SELECT doc_id, CAST(len(list_distinct(flatten(list({O.matches('line', T.ANAPHORA)})))) AS INTEGER) AS n FROM lines GROUP BY 1")
def distinct_matches(s, d):
    return lines(s, d).groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list(T.matches(F.col("line"), T.ANAPHORA))))).alias("n"))


@query("WITH m AS (SELECT doc_id, list_sort(list_distinct(list_concat([x for x in range(0, CAST(n_chars AS BIGINT), 700)], [x for x in range(0, CAST(n_chars AS BIGINT), 500)], [CAST(n_chars AS BIGINT)]))) AS cuts FROM documents) SELECT doc_id, array_to_string(cuts, ',') AS cuts FROM m")
def breakpoint_union(s, d):
    n = F.col("n_chars")
    steps = lambda k: F.filter(F.sequence(F.lit(0).cast("long"), n, F.lit(k).cast("long")), lambda x: x < n)
    cuts = F.array_sort(F.array_union(F.array_union(steps(700), steps(500)), F.array(n)))
    return A.table(s, d, "documents").select("doc_id", F.array_join(F.transform(cuts, lambda x: x.cast("string")), ",").alias("cuts"))


# Chunks and segments


def sections_sql(cut: bool) -> str:
    title = f"substr(split_part({O.trim('text')}, chr(10), 1), 1, 100)" if cut else "text"
    return f"""{CLASS}, sc AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section FROM classified),
sx AS (SELECT doc_id, section, max({title}) FILTER (is_heading) AS heading, coalesce(max(coalesce(heading_level, 1)) FILTER (is_heading), 0) AS depth,
  coalesce(min(page) FILTER (is_heading OR {O.trim('text')} <> ''), 0) AS page, coalesce(string_agg(text, chr(10) ORDER BY block_no) FILTER (NOT is_heading AND {O.trim('text')} <> ''), '') AS body FROM sc GROUP BY 1, 2),
sections AS (SELECT doc_id, section, heading, depth, page, t AS text FROM (SELECT *, {O.trim("CASE WHEN coalesce(heading, '') <> '' THEN repeat('#', CAST(depth AS INTEGER)) || ' ' || heading || chr(10) ELSE '' END || body")} AS t FROM sx) WHERE t <> '')"""


SECTION_CHUNKS = f"""WITH {sections_sql(True)} SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, text, page, heading, CAST(greatest(1, length(text) // 3) AS INTEGER) AS tokens, CAST(depth AS INTEGER) AS depth,
CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_char, CAST(sum(length(text)) OVER w AS BIGINT) AS end_char FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY section)"""


@query(SECTION_CHUNKS)
def semantic_chunks(s, d):
    return C.semantic_chunks(B.classify(blocks(s, d)), 300).drop("section").withColumnRenamed("index", "idx")


@query(f"WITH {sections_sql(False)}, segs AS (SELECT doc_id, section AS seg_no, text, depth, heading, page FROM sections), {ISLES} SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, text, CAST(depth AS INTEGER) AS depth, heading, page FROM merged")
def segments_heading(s, d):
    return C.heading_segments(B.classify(blocks(s, d)))


TAIL = "CASE WHEN greatest(1, length({0}) // 3) <= 20 THEN {0} ELSE regexp_replace(right({0}, CAST(floor(length({0}) * 20 / greatest(1, length({0}) // 3)) AS INTEGER)), '^\\s+', '') END"


FALLBACK = rf"""{O.LINES}, fpr AS (SELECT doc_id, line_no AS i, line AS p, count(*) OVER (PARTITION BY doc_id) AS n, greatest(0, CAST(ceil((length(line) - 902) / 280) AS INTEGER)) AS cuts FROM lines),
fpc AS (SELECT doc_id, i, n, cuts, [substr(p, CAST(k AS INTEGER) * 280 + 1, 300) for k in range(cuts)] AS parts, substr(p, cuts * 280 + 1) AS rest FROM fpr),
ffold AS (SELECT doc_id, i, n, parts AS done, rest AS buf FROM fpc WHERE i = 0 UNION ALL
  SELECT f.doc_id, c.i, c.n, CASE WHEN f.buf <> '' AND greatest(1, length(f.buf || chr(10) || chr(10) || c.rest) // 3) > 300 THEN list_append(c.parts, f.buf) ELSE c.parts END,
    CASE WHEN f.buf = '' THEN c.rest WHEN greatest(1, length(f.buf || chr(10) || chr(10) || c.rest) // 3) > 300 THEN {O.trim(TAIL.format('f.buf') + " || chr(10) || chr(10) || c.rest")} ELSE f.buf || chr(10) || chr(10) || c.rest END
  FROM ffold f JOIN fpc c ON c.doc_id = f.doc_id AND c.i = f.i + 1),
fraw AS (SELECT doc_id, i AS pl, unnest(done) AS text, unnest(range(len(done))) AS j FROM ffold UNION ALL SELECT doc_id, n, {O.trim('buf')}, 0 FROM ffold WHERE i = n - 1 AND {O.trim('buf')} <> '')"""


@query(f"WITH RECURSIVE {FALLBACK} SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, text, CAST(greatest(1, length(text) // 3) AS INTEGER) AS tokens, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_char, CAST(sum(length(text)) OVER w AS BIGINT) AS end_char FROM fraw WINDOW w AS (PARTITION BY doc_id ORDER BY pl, j)")
def fallback_chunks(s, d):
    t = A.table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.fallback_chunks(t, 300, 20).withColumnRenamed("index", "idx")


# Retrieval


def store(s, d):
    return A.vectors(A.table(s, d, "embeddings"))


def asked(s, d, step: int):
    return store(s, d).where(F.col("id") % step == 0).select(F.col("id").alias("query_no"), "namespace", F.col("vec").alias("qvec"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
HITS = f"hits AS (SELECT a.vec_id AS query_no, b.vec_id AS id, b.label, {COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0)"


@query(f"WITH {HITS} SELECT query_no, CAST(rank AS INTEGER) AS rank, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, id) AS rank FROM hits WHERE score >= 0.0) WHERE rank <= 5")
def vector_topk(s, d):
    return V.search(store(s, d), asked(s, d, 100), 5)


@query(f"WITH {HITS} SELECT query_no, id, round(score, 4) AS score FROM hits WHERE score >= 0.2")
def vector_threshold(s, d):
    return V.search(store(s, d), asked(s, d, 100), None, threshold=0.2)


@query(f"SELECT a.vec_id AS query_no, b.vec_id AS id, round({COS}, 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {COS} >= 0.25")
def query_vector_cross(s, d):
    q = asked(s, d, 100).withColumn("namespace", F.lit(None).cast("string"))
    return V.search(store(s, d), q, None, threshold=0.25)


FUSED = f"""{HITS}, top AS (SELECT query_no // 400 AS base, query_no, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, id) AS rank, id, round(score, 4) AS score FROM hits WHERE score >= 0.0),
one AS (SELECT *, row_number() OVER (PARTITION BY base, id ORDER BY query_no, rank) AS i FROM top WHERE rank <= 10),
fused AS (SELECT base, row_number() OVER (PARTITION BY base ORDER BY query_no, rank) AS place, id, score FROM one WHERE i = 1)"""


def variants(s, d):
    return V.search(store(s, d), asked(s, d, 100), 10).withColumn("base", F.floor(F.col("query_no") / 400))


@query(f"WITH {FUSED} SELECT base, CAST(place AS INTEGER) AS place, id, score FROM fused WHERE place <= 5")
def multi_query_search(s, d):
    return V.fuse(variants(s, d), 5)


@query(f"WITH {FUSED} SELECT base, id FROM fused")
def keep_first_union(s, d):
    return V.fuse(variants(s, d), 10**9).select("base", "id")


@query(f"""WITH {FUSED}, p AS (SELECT base, place, '[Trecho (score: ' || round(score * 10000)::INT || ') [p.' || (id % 7) || CASE WHEN t.lang <> '' THEN ', §' || substr(t.lang, 1, 50) ELSE '' END || ']]' || chr(10) || t.text || chr(10) AS p FROM fused JOIN documents t ON t.doc_id = fused.id WHERE place <= 5),
c AS (SELECT base, string_agg(p, chr(10) ORDER BY place) AS c FROM p GROUP BY 1) SELECT base, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || chr(10) || '...[cortado]' ELSE c END AS context FROM c""")
def context_assembly(s, d):
    hits = V.fuse(variants(s, d), 5).withColumn("score", F.round(F.col("score") * 10000).cast("int"))
    docs = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("heading"), "text")
    return V.context(hits.join(docs, "id").withColumn("page", F.col("id") % 7))


@query("""WITH u AS (SELECT label, unnest(embedding)::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2),
q AS (SELECT label, sum(s * s) AS q, max(n) AS n FROM s GROUP BY 1) SELECT CAST(label AS VARCHAR) AS namespace, CASE WHEN n < 3 THEN 1.0 ELSE round(sqrt(q) / n, 4) END AS mean_norm, CASE WHEN n < 3 THEN 1.0 ELSE round((q - n) / (n * (n - 1)), 4) END AS mean_cosine FROM q""")
def anisotropy(s, d):
    return V.anisotropy(store(s, d))


@query("""WITH v AS (SELECT CAST(label AS VARCHAR) AS namespace, vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.namespace, a.id, b.id AS other, list_dot_product(a.e, b.e) / (a.n * b.n) / 0.05 AS s FROM v a JOIN v b ON a.namespace IS NOT DISTINCT FROM b.namespace WHERE a.n > 0 AND b.n > 0),
l AS (SELECT namespace, id, max(s) FILTER (id = other) AS own, 20 + ln(sum(exp(s - 20))) AS lse FROM s GROUP BY 1, 2)
SELECT namespace, round(avg(lse - own), 4) AS loss FROM l GROUP BY 1""")
def info_nce(s, d):
    return V.info_nce(store(s, d))


@query("SELECT CAST(label AS VARCHAR) AS namespace, count(*) AS n FROM embeddings GROUP BY 1")
def namespace_size(s, d):
    return store(s, d).groupBy("namespace").agg(F.count("*").alias("n"))


# Rendering


NOTE = rf"regexp_matches({O.trim('text')}, '^\[[0-9]+\]\s+|^[0-9]+\.\s{{2,}}') AND length({O.trim('text')}) < 300"


@query(rf"""WITH {MIXED}, v AS (SELECT *, type = 'text' AND NOT is_heading AND list_type IS NULL AND text LIKE '>%' AS quote, is_heading OR type IN ('table', 'image') AS closes FROM zip WHERE NOT coalesce(NOT is_heading AND list_type IS NULL AND layout_type IN ('header', 'footer'), false)),
w AS (SELECT *, coalesce(last_value(CASE WHEN quote THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM v),
x AS (SELECT doc_id, block_no, CASE WHEN open AND closes THEN chr(10) || chr(10) ELSE '' END || CASE WHEN type = 'table' THEN chr(10) || table_md || chr(10) WHEN type = 'image' THEN chr(10) || '![Imagem - p.' || page || ']()' || chr(10)
  WHEN is_heading THEN chr(10) || repeat('#', CAST(coalesce(heading_level, 1) AS INTEGER)) || ' ' || text || chr(10) WHEN list_type IS NOT NULL THEN CASE WHEN list_type = 'bullet' THEN '- ' ELSE '1. ' END || text WHEN quote OR text LIKE '```%' THEN chr(10) || text || chr(10) ELSE text END AS part FROM w),
m AS (SELECT doc_id, {O.trim("string_agg(part, chr(10) || chr(10) ORDER BY block_no)")} AS m FROM x WHERE part IS NOT NULL GROUP BY 1),
nn AS (SELECT doc_id, string_agg('- ' || {O.trim('text')}, chr(10) ORDER BY block_no) AS notes FROM mb WHERE type = 'text' AND {NOTE} GROUP BY 1),
ro AS (SELECT *, regexp_matches({O.trim('text')}, '^(?i:refer[eê]ncias|bibliografia|references|bibliography)') AS op FROM mb WHERE type = 'text'), rr AS (SELECT *, bool_or(op) OVER (PARTITION BY doc_id ORDER BY block_no) AS inr FROM ro),
rf AS (SELECT doc_id, string_agg('- ' || {O.trim('text')}, chr(10) ORDER BY block_no) AS refs FROM rr WHERE inr AND NOT op AND regexp_matches({O.trim('text')}, '^[A-ZÀ-ɂ][0-9A-Za-z_À-ɂ]+.*\([0-9]{{4}}\)') GROUP BY 1)
SELECT doc_id, m || coalesce(chr(10) || chr(10) || '---' || chr(10) || '**Notas de rodapé:**' || chr(10) || notes, '') || coalesce(chr(10) || chr(10) || '---' || chr(10) || '**Referências:**' || chr(10) || refs, '') AS markdown FROM m LEFT JOIN nn USING (doc_id) LEFT JOIN rf USING (doc_id)""")
def render_markdown(s, d):
    return R.markdown(R.with_tables(*mixed_blocks(s, d)))


ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


TABLE_HTML = "'<tbody><tr><th>t' || regexp_extract(table_md, '[0-9]+') || '</th><th>x</th></tr></tbody>'"


def html_section(rows: str, name: str, title: str) -> str:
    return f"coalesce(chr(10) || '<hr/><section class=\"{name}\">' || chr(10) || '<h2>{title}</h2>' || chr(10) || {rows} || chr(10) || '</section>', '')"


@query(rf"""WITH {MIXED}, v AS (SELECT * FROM zip WHERE type <> 'text' OR is_heading OR list_type IS NOT NULL OR layout_type NOT IN ('header', 'footer')), u AS (SELECT *, list_type IS NOT NULL AND NOT is_heading AS li FROM v),
st AS (SELECT *, li AND NOT coalesce(lag(li) OVER (PARTITION BY doc_id ORDER BY block_no), false) AS s FROM u), ru AS (SELECT *, CASE WHEN li THEN count(*) FILTER (s) OVER (PARTITION BY doc_id ORDER BY block_no) END AS run FROM st),
pt AS (SELECT *, CASE WHEN type = 'table' THEN '<figure data-page="' || page || '"><table>' || {TABLE_HTML} || '</table></figure>'
  WHEN type = 'image' THEN '<figure data-page="' || page || '"><img src="" alt="Imagem p.' || page || '" width="0" height="0"/></figure>'
  WHEN is_heading THEN '<h' || coalesce(heading_level, 1) || ' data-page="' || page || '">' || {ESC.format('text')} || '</h' || coalesce(heading_level, 1) || '>' WHEN li THEN '<li>' || {ESC.format('text')} || '</li>'
  WHEN text LIKE '> %' THEN '<blockquote data-page="' || page || '"><p>' || {ESC.format('substr(text, 3)')} || '</p></blockquote>' WHEN text LIKE '```%' THEN '<pre><code data-page="' || page || '">' || {ESC.format("trim(text, '`')")} || '</code></pre>'
  ELSE '<p data-page="' || page || '">' || {ESC.format('text')} || '</p>' END AS part, coalesce(run, -block_no - 1) AS g FROM ru),
rs AS (SELECT doc_id, g, min(block_no) AS pl, string_agg(part, chr(10) ORDER BY block_no) AS part, arg_min(list_type, block_no) AS kind, max(run) AS run FROM pt WHERE part IS NOT NULL GROUP BY 1, 2),
bd AS (SELECT doc_id, string_agg(CASE WHEN run IS NOT NULL THEN '<' || CASE WHEN kind = 'bullet' THEN 'ul' ELSE 'ol' END || '>' || chr(10) || part || chr(10) || '</' || CASE WHEN kind = 'bullet' THEN 'ul' ELSE 'ol' END || '>' ELSE part END, chr(10) ORDER BY pl) AS body FROM rs GROUP BY 1),
nn AS (SELECT doc_id, string_agg('<p>' || {ESC.format(O.trim('text'))} || '</p>', chr(10) ORDER BY block_no) AS notes FROM mb WHERE type = 'text' AND {NOTE} GROUP BY 1),
ro AS (SELECT *, regexp_matches({O.trim('text')}, '^(?i:refer[eê]ncias|bibliografia|references|bibliography)') AS op FROM mb WHERE type = 'text'), rr AS (SELECT *, bool_or(op) OVER (PARTITION BY doc_id ORDER BY block_no) AS inr FROM ro),
rf AS (SELECT doc_id, string_agg('<p>' || {ESC.format(O.trim('text'))} || '</p>', chr(10) ORDER BY block_no) AS refs FROM rr WHERE inr AND NOT op AND regexp_matches({O.trim('text')}, '^[A-ZÀ-ɂ][0-9A-Za-z_À-ɂ]+.*\([0-9]{{4}}\)') GROUP BY 1)
SELECT doc_id, '<article class="document">' || chr(10) || body || {html_section('notes', 'footnotes', 'Notas de rodapé')} || {html_section('refs', 'references', 'Referências')} || chr(10) || '</article>' AS html FROM bd LEFT JOIN nn USING (doc_id) LEFT JOIN rf USING (doc_id)""")
def render_html(s, d):
    return R.html(R.with_tables(*mixed_blocks(s, d)))


MD = "concat('| name | qty<1> |', chr(10), '| --- | --- |', chr(10), '| ', o_orderpriority, ' | ', o_orderkey, ' |')"


@query("SELECT o_orderkey, '<thead><tr><th>name</th><th>qty&lt;1&gt;</th></tr></thead><tbody><tr><td>' || trim(o_orderpriority) || '</td><td>' || o_orderkey || '</td></tr></tbody>' AS html FROM orders")
def table_to_html(s, d):
    return A.table(s, d, "orders").select("o_orderkey", R.table_to_html(F.expr(MD)).alias("html"))


@query("SELECT o_orderkey, '| key | priority |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || trim(o_orderpriority) || ' |' || chr(10) || '|  | ' || o_orderstatus || ' |' AS md FROM orders")
def table_to_markdown(s, d):
    rows = F.array(F.array(F.lit("key"), F.lit(" priority ")), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")), F.array(F.lit(None).cast("string"), F.col("o_orderstatus")))
    return A.table(s, d, "orders").select("o_orderkey", R.rows_to_markdown(rows).alias("md"))


@query(f"WITH {CLASS}, k AS (SELECT doc_id, block_no, repeat('#', CAST(least(coalesce(heading_level, 4) + 1, 6) AS INTEGER)) || ' ' || substr(split_part({O.trim('text')}, chr(10), 1), 1, 80) AS line FROM classified WHERE is_heading) SELECT doc_id, '# Documento' || chr(10) || string_agg(line, chr(10) ORDER BY block_no) AS outline FROM k GROUP BY 1")
def outline(s, d):
    h = B.classify(blocks(s, d)).where("is_heading").select("doc_id", "block_no", F.coalesce("heading_level", F.lit(4)).alias("level"), "text")
    return R.outline(h)


@query("""SELECT doc_id, concat_ws(chr(10), '# Doc ' || doc_id, '## Tese Central', '### ' || lang, '## ' || CASE doc_id % 3 WHEN 0 THEN '📘' WHEN 1 THEN '⚡' ELSE '📄' END || ' ' || source, '### d', '### 📌 sub', '## 🔗 Relações Argumentativas', '### a ' || CASE doc_id % 2 WHEN 0 THEN '⇝' ELSE '→' END || ' ? (' || CASE doc_id % 2 WHEN 0 THEN 'contrasta' ELSE 'x' END || ')') AS map FROM documents""")
def mindmap(s, d):
    kind = F.expr("case doc_id % 3 when 0 then 'conceito' when 1 then 'argumento' else 'other' end")
    rel = F.expr("case doc_id % 2 when 0 then 'contrasta' else 'x' end")
    raw = F.concat(F.lit('answer: ```json\n{"titulo":"Doc '), F.col("doc_id").cast("string"), F.lit('","tese_central":"'), "lang", F.lit('","topicos":[{"nome":"'), "source", F.lit('","tipo":"'), kind, F.lit('","descricao":"d","subtopicos":[{"nome":"sub","tipo":"exemplo"}]}],"relacoes":[{"de":"a","tipo":"'), rel, F.lit('"}]}\n```'))
    return A.table(s, d, "documents").select("doc_id", R.mindmap(T.json_from_text(raw, R.MAP_SCHEMA)).alias("map"))


# State and streams


@query(f"WITH {MSGS} SELECT * FROM sess")
def sessions_view(s, d):
    return S.session_view(messages(s, d))


@query(f"""WITH {MSGS} SELECT session_id, s.created_at, updated_at, n_messages, seq, role, content
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS k FROM msgs) m JOIN sess s USING (session_id) WHERE k <= 50""")
def session_history(s, d):
    """Every session with its oldest 50 messages."""
    return S.session_history(messages(s, d), 50)


def job_rows(s, d):
    """The log of a job's states, two writes of it, in a keyed table."""
    log = A.job_events(A.table(s, d, "events")).select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "ts", "event")
    table = KeyedTable(s, shared_folder(s, "jobs"), log.schema, "job_id", ("ts", "seq"), 16)
    for epoch in range(2):
        table.upsert(log.where(F.col("seq") % 2 == epoch), epoch)
    return table


JOBS = "je AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE WHEN event_type IN ('view', 'click') THEN 'progress' WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'error' ELSE 'created' END AS event, value FROM events)"
LAST = f"WITH {JOBS}, held AS (SELECT job_id, seq, ts, event FROM je QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)"


@query(f"{LAST} SELECT * FROM held")
def keyed_upsert(s, d):
    """Every job's last event from a keyed table that was written in two halves of the log."""
    return job_rows(s, d).read()


@query(f"{LAST} SELECT held.* FROM held JOIN (SELECT DISTINCT c_custkey FROM customer) ON c_custkey = job_id")
def point_read(s, d):
    """The jobs of the customers' numbers, looked up by key."""
    return job_rows(s, d).get_all(A.table(s, d, "customer").select("c_custkey"))


def job_log(s, d):
    return A.job_events(A.table(s, d, "events"))


@query(f"WITH {JOBS} SELECT job_id, CASE arg_max(event, (ts, seq)) FILTER (event IN ('complete', 'error')) WHEN 'complete' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, count(*) FILTER (event = 'progress') AS progress, count(*) AS n_events FROM je GROUP BY 1")
def job_latest(s, d):
    return S.job_view(job_log(s, d))


def told(s, d):
    """Job events with a page, a stage and a message of their own."""
    log = job_log(s, d)
    stage = F.element_at(F.array(*map(F.lit, ("extract", "tables", "chunk"))), (F.col("seq") % 3 + 1).cast("int"))
    return log.withColumns({"page": F.col("seq") % 21, "total": F.lit(20), "stage": stage, "message": F.concat(F.lit("e"), F.col("seq").cast("string"))})


@query(f"""WITH {JOBS}, e AS (SELECT *, seq % 21 AS page, 20 AS total, CASE seq % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'tables' ELSE 'chunk' END AS stage, epoch_us(ts) AS us FROM je),
o AS (SELECT *, coalesce(sum(CASE WHEN event IN ('complete', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
f AS (SELECT *, lead(us) OVER w AS nxt, last_value(CASE WHEN event = 'progress' AND (stage = 'tables' OR page % 5 = 0 OR page = total) THEN page END IGNORE NULLS) OVER w AS stored
  FROM o WHERE before = 0 WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)),
k AS (SELECT *, unnest(range(CASE WHEN event IN ('complete', 'error') OR nxt IS NULL THEN 1 ELSE greatest((nxt - us - 1) // 21600000000, 0) + 1 END)) AS k FROM f)
SELECT job_id, CAST(seq AS BIGINT) AS seq, k, CASE WHEN k > 0 THEN 'keepalive' ELSE event END AS event, make_timestamp(us + k * 21600000000) AS at_,
  CASE event WHEN 'complete' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, CAST(CASE WHEN event = 'complete' THEN total ELSE stored END AS BIGINT) AS page,
  CAST(CASE WHEN event = 'complete' THEN total WHEN stored IS NOT NULL THEN total END AS BIGINT) AS total,
  CASE WHEN event = 'error' THEN (CASE WHEN stage = 'chunk' THEN 'Chunking failed: ' ELSE '' END) || 'e' || seq END AS error FROM k""")
def job_feed(s, d):
    """Events, keepalives after six hours of silence, and stored states of every job up to its end."""
    return S.job_feed(told(s, d), 21600).withColumnRenamed("at", "at_")


@query(f"WITH {JOBS}, g AS (SELECT job_id, seq, CAST(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY job_id ORDER BY ts, seq) AS BIGINT) AS gap_s FROM je) SELECT * FROM g WHERE gap_s > 43200")
def idle_gaps(s, d):
    return S.idle_gaps(job_log(s, d), 43200)


@query(f"WITH {JOBS} SELECT job_id, seq FROM je WHERE NOT (ts < (SELECT max(ts) FROM je) - INTERVAL 604800 SECONDS AND event IN ('complete', 'error'))")
def ttl_purge(s, d):
    log = job_log(s, d)
    as_of = log.agg(F.max("ts").alias("t")).first()["t"]
    return S.purge(log, "ts", F.lit(as_of), 604800, F.col("event").isin("complete", "error")).select("job_id", "seq")


def requests(s, d):
    return A.table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT key, seq, i, true AS admitted, [tm] AS kept FROM r WHERE i = 1 UNION ALL
  SELECT r.key, r.seq, r.i, len(list_filter(f.kept, lambda x: x > r.tm - 86400)) < 2, CASE WHEN len(list_filter(f.kept, lambda x: x > r.tm - 86400)) < 2 THEN list_append(list_filter(f.kept, lambda x: x > r.tm - 86400), r.tm) ELSE list_filter(f.kept, lambda x: x > r.tm - 86400) END
  FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1) SELECT key, seq, admitted FROM f""")
def rate_limiter(s, d):
    return S.admit(requests(s, d), 2, 86400.0)


@query("WITH k AS (SELECT doc_id, sha256(text || '|{\"size\":2000}') AS key FROM documents), c AS (SELECT key FROM k WHERE doc_id % 4 = 0 AND doc_id % 8 = 0) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM c)")
def cache_antijoin(s, d):
    k = A.table(s, d, "documents").select("doc_id", T.cache_key(F.concat("text", F.lit("|")), F.lit('{"size":2000}')).alias("key"))
    at = F.when(F.col("doc_id") % 8 == 0, F.expr("timestamp'2024-01-04 23:00:00'")).otherwise(F.expr("timestamp'2024-01-01 00:00:00'"))
    cache = k.where("doc_id % 4 = 0").withColumn("created_at", at)
    return S.misses(k, cache, F.expr(AS_OF), 86400)


@query("SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations")
def token_stream_prefix(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return A.table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " ").alias("so_far"))


@query(f"WITH {JOBS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event, count(*) AS n, round(sum(value), 4) AS total FROM je GROUP BY 1, 2")
def tumbling_counts(s, d):
    return J.tumbling(job_log(s, d))


@query(f"WITH {JOBS}, w AS (SELECT event, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start FROM je) SELECT window_start, event, count(*) AS n FROM w GROUP BY 1, 2")
def sliding_counts(s, d):
    return J.sliding(job_log(s, d))


@query(f"WITH {JOBS}, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS st FROM je WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)), b AS (SELECT *, sum(st) OVER (PARTITION BY job_id ORDER BY ts, seq) AS g FROM a) SELECT job_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM b GROUP BY job_id, g")
def session_windows(s, d):
    return J.sessions(job_log(s, d))
