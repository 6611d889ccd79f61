"""Document tables as positioned blocks, lines, sections of conversations, vectors and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout phenomena that plain prose lacks, planted between the real lines, which all stay whole. A page has eight blocks:
#: a header and a footer (``h`` = 1, two documents in three), ``r`` real lines (number ``j``, ``m`` of them on this page) and
#: a planted line after the first. ``s`` is the kind of block; the same expressions serve both engines.
HELD = "s = 1 OR (j = 0 AND (s = 2 OR h = 1))"
PLACE = "CASE s WHEN 0 THEN 0 WHEN 1 THEN h + j + CASE WHEN j > 0 THEN 1 ELSE 0 END WHEN 2 THEN h + 1 ELSE h + m + 1 END"
TRIGGER = """CASE
 WHEN s = 0 AND d % 3 = 0 THEN 'Acme Report Header'
 WHEN s = 3 AND d % 3 = 0 THEN 'Acme Footer Line'
 WHEN s = 0 THEN CASE (d + 5 * p) % 8
   WHEN 0 THEN concat(p + 1, '.', p % 3 + 1, ' Title ', substr(line, 1, 20)) WHEN 1 THEN concat('Chapter ', p + 1)
   WHEN 2 THEN 'II. Second part' WHEN 3 THEN 'Introduction' WHEN 4 THEN concat('# ', substr(line, 1, 30))
   WHEN 5 THEN 'RESULTS TABLE' WHEN 6 THEN concat(p + 1, ' Background of it') ELSE concat('On ', substr(line, 1, 50)) END
 WHEN s = 3 THEN CASE (d + 5 * p) % 4
   WHEN 0 THEN concat('Page ', p + 1, ' of 9') WHEN 1 THEN concat(p + 1, ' / 9') WHEN 2 THEN 'FULLSCREEN' ELSE concat('FL. ', p + 1) END
 WHEN s = 2 THEN CASE d % 5
   WHEN 0 THEN '| a | b |' WHEN 1 THEN 'of' WHEN 2 THEN concat('[', p + 1, '] note ', substr(line, 1, 40))
   WHEN 3 THEN 'References' ELSE concat('Smith, J. Work (2001) ', substr(line, 1, 20)) END
 WHEN j = 0 THEN CASE d % 4 WHEN 0 THEN concat('- ', line) WHEN 1 THEN concat('1) ', line) WHEN 2 THEN concat('a. ', line) ELSE line END
 ELSE line END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, line): every line of every document, numbered from 0."""
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def blocks(docs: DataFrame) -> DataFrame:
    """Positioned text blocks: every line of every document and planted ones, eight a page, in two columns (left even, right odd)."""
    rows = docs.select("doc_id", "source", F.split("text", "\n").alias("all")).withColumn("n", F.size("all"))
    at = rows.select("doc_id", "source", "n", F.posexplode("all").alias("k", "line"), F.col("doc_id").alias("d"))
    at = at.withColumn("h", F.expr("if(d % 3 < 2, 1, 0)")).withColumn("r", 7 - 2 * F.col("h"))
    at = at.withColumn("p", F.expr("cast(k div r as int)")).withColumn("j", F.col("k") % F.col("r")).withColumn("m", F.least("r", F.col("n") - F.col("p") * F.col("r")))
    at = at.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(HELD)
    at = at.withColumn("i", F.col("p") * 8 + F.expr(PLACE)).withColumn("text", F.expr(TRIGGER))
    size = F.when(F.length("text") < 25, 18.0).when(F.length("text") < 60, 14.0).otherwise(11.0)
    bold = (F.length("text") < 25) & (F.col("d") % 2 == 0)
    even = F.col("i") % 2 == 0
    return at.select(
        "doc_id", "source", F.col("i").alias("block_no"), F.col("p").alias("page"), F.lit("text").alias("type"), "text",
        size.alias("font_size"), F.when(bold, "Test-Bold").otherwise("Test-Regular").alias("font"),
        F.when(even, 50.0).otherwise(320.0).alias("x0"), (72.0 + 80 * (F.col("i") % 8)).alias("y0"),
        F.when(even, 290.0).otherwise(560.0).alias("x1"), (138.0 + 80 * (F.col("i") % 8)).alias("y1"),
    )


def page_fragments(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, fragment) of the headings, paragraphs, list items and footers of raw pages."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li|footer)>.*?</(?:h1|p|li|footer)>"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    return rows.select("page_id", "pos", F.regexp_extract("raw", r"^<([a-z0-9]+)>", 1).alias("tag"), F.regexp_extract("raw", r"(?s)^<[a-z0-9]+>(.*)</[a-z0-9]+>$", 1).alias("fragment"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """(namespace, id, vec, rowid): embeddings as entries of a vector store, in double precision."""
    return embeddings.select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").alias("rowid"))


def messages(conversations: DataFrame) -> DataFrame:
    """(session_id, seq, role, content, created_at): hour conv_id and minute turn after 2024-01-01."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int), 0)")
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), at.alias("created_at"))


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, seq, ts, event): user sessions seen as jobs."""
    kind = F.when(F.col("event_type").isin("view", "click"), "progress").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("created")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), "value")
