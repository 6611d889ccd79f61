"""Queries over the document tools and their parsed answers, with their DuckDB twins."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..sources import adapters as A
from . import api, tools
from . import oracle_base as O
from .queries_blocks import blocks
from .queries_rest import CLASS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def headings(s, d):
    rows = B.classify(blocks(s, d)).where("is_heading")
    return rows.select("doc_id", "block_no", F.coalesce("heading_level", F.lit(4)).alias("level"), "text")


#: Answers as models give them: fenced, bare, without some keys, without JSON, and broken.
ANSWERS = """SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{"category": "contrato", "confidence": 0.5, "reason": "' || source || '"}' || chr(10) || '```'
  WHEN 1 THEN '{"category": "carta", "people": "' || lang || '"}' WHEN 2 THEN 'It is a letter.' WHEN 3 THEN '{broken}'
  ELSE '{"reason": "none", "confidence": "high"}' END AS answer FROM documents"""
PARSED = rf"""answers AS ({ANSWERS}), found AS (SELECT doc_id, answer, nullif(regexp_extract(regexp_replace(answer, '```(json)?', '', 'g'), '\{{.*\}}', 0, 's'), '') AS body FROM answers),
parsed AS (SELECT doc_id, answer, CASE WHEN json_valid(body) THEN body END AS body FROM found)"""


def answers(s, d) -> DataFrame:
    fenced = F.concat(F.lit('Here it is:\n```json\n{"category": "contrato", "confidence": 0.5, "reason": "'), F.col("source"), F.lit('"}\n```'))
    kinds: list[Column] = [
        fenced, F.concat(F.lit('{"category": "carta", "people": "'), F.col("lang"), F.lit('"}')), F.lit("It is a letter."),
        F.lit("{broken}"), F.lit('{"reason": "none", "confidence": "high"}'),
    ]
    return A.table(s, d, "documents").select("doc_id", F.get(F.array(*kinds), (F.col("doc_id") % 5).cast("int")).alias("answer"))


@query(f"""WITH {PARSED} SELECT doc_id, CASE WHEN body IS NULL THEN '{tools.UNREAD_CATEGORY}' ELSE body ->> '$.category' END AS category,
  CASE WHEN body IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(body ->> '$.confidence' AS DOUBLE) END AS confidence,
  CASE WHEN body IS NULL THEN '{tools.UNREAD_REASON}' ELSE body ->> '$.reason' END AS reason FROM parsed""")
def answer_categories(s, d):
    return answers(s, d).select("doc_id", tools.read_category(F.col("answer")).alias("c")).select("doc_id", "c.*")


@query(f"""WITH {PARSED} SELECT doc_id, body ->> '$.people' AS people, CASE WHEN body IS NULL THEN '{tools.UNREAD_ENTITIES}' END AS error,
  CASE WHEN body IS NULL THEN answer END AS raw FROM parsed""")
def answer_entities(s, d):
    e = answers(s, d).select("doc_id", tools.read_entities(F.col("answer")).alias("e"))
    return e.select("doc_id", F.try_element_at("e.entities", F.lit("people")).alias("people"), "e.error", "e.raw")


@query(f"""WITH {CLASS}, k AS (SELECT doc_id, block_no, repeat('  ', CAST(coalesce(heading_level, 4) AS INTEGER) - 1) || '- ' || substr({O.trim('text')}, 1, 80) AS line,
  row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k FROM classified WHERE is_heading)
SELECT doc_id, string_agg(line, chr(10) ORDER BY block_no) AS toc FROM k WHERE k <= 30 GROUP BY 1""")
def document_contents(s, d):
    return tools.contents(headings(s, d))


@query()
def document_tool_results(s, d):
    """What each of the six tools gives, as JSON rows (tool, result)."""
    parts = api.extract(blocks(s, d))
    # What several tools read is made once and kept on the disks of the executors.
    for name in ("blocks", "text"):
        parts[name].persist(StorageLevel.DISK_ONLY)
    registry = tools.document_tools(parts, api.load(parts["chunks"], "corpus").persist(StorageLevel.DISK_ONLY))
    asked = {"search_document": {"query": "data"}, "summarize_document": {"style": "bullets"}}
    results = [registry.call(name, **asked.get(name, {})) for name in registry.handlers]
    shown = [r.select(F.lit(name).alias("tool"), F.to_json(F.struct("*")).alias("result")) for name, r in zip(registry.handlers, results, strict=True)]
    out = shown[0]
    for more in shown[1:]:
        out = out.unionByName(more)
    return out
