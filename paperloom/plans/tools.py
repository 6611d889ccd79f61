"""The six document tools: tables of a corpus in, one row a document out; answers of a model are parsed, with a defined fallback.

Prompts hold the first characters of a text only, as many as a model is asked to read; tables keep every document.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import analysis as X
from ..operators import blocks as B
from ..operators import chunks as C
from . import api

#: The categories of a document, and what stands for an answer that cannot be read.
CATEGORIES = ("relatorio_financeiro", "contrato", "artigo_cientifico", "fatura", "manual_tecnico", "apresentacao", "currículo", "carta", "outro")
UNREAD_CATEGORY, UNREAD_REASON, UNREAD_ENTITIES = "outro", "Falha ao classificar", "Falha ao extrair entidades"


def contents(headings: DataFrame, cap: int = 30) -> DataFrame:
    """(doc_id, toc): a document's first ``cap`` headings (doc_id, block_no, level, text), a line each, indented by level."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)).cast("int"))
    line = F.concat(indent, F.lit("- "), F.substring(T.strip(F.col("text")), 1, 80))
    rows = headings.withColumn("k", k).where(F.col("k") <= cap).withColumn("line", line)
    return rows.groupBy("doc_id").agg(C.ordered_text("block_no", "line", "\n").alias("toc"))


def summarize(texts: DataFrame, headings: DataFrame, provider: str = "hash", max_length: int = 500, style: str = "paragraph") -> DataFrame:
    """(doc_id, summary) of every text; where a document has headings, its contents stand before its text."""
    if style not in ("paragraph", "bullets"):
        raise ValueError(f"unknown style {style!r}")
    form = "one paragraph" if style == "paragraph" else "bullet points"
    ask = F.lit(f"Summarize the document in {form} of at most {max_length} characters. Keep its main points and figures.\n")
    text = F.coalesce("text", F.lit(""))
    with_contents = F.concat(ask, F.lit("Contents:\n"), F.col("toc"), F.lit("\nText:\n"), F.substring(text, 1, 12_000))
    rows = texts.join(contents(headings), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce(with_contents, F.concat(ask, F.substring(text, 1, 8000))).alias("prompt"))
    return P.ask(rows, provider, out="summary").drop("prompt")


def read_category(answer: Column) -> Column:
    """struct<category, confidence, reason> of a classifier's answer; an answer without readable JSON is 'outro' at 0."""
    said = T.json_from_text(answer, "map<string,string>")
    item = lambda key: F.try_element_at(said, F.lit(key))
    found = F.struct(item("category").alias("category"), item("confidence").try_cast("double").alias("confidence"), item("reason").alias("reason"))
    unread = F.struct(F.lit(UNREAD_CATEGORY).alias("category"), F.lit(0.0).alias("confidence"), F.lit(UNREAD_REASON).alias("reason"))
    return F.when(said.isNull(), unread).otherwise(found)


def classify(texts: DataFrame, provider: str = "hash") -> DataFrame:
    """(doc_id, category, confidence, reason) of every text, by a model's answer."""
    ask = F.lit(f"Classify the document as one of {', '.join(CATEGORIES)}. Answer with JSON of category, confidence and reason only.\n")
    rows = texts.select("doc_id", F.concat(ask, F.substring(F.coalesce("text", F.lit("")), 1, 3000)).alias("prompt"))
    return P.ask(rows, provider).select("doc_id", read_category(F.col("answer")).alias("c")).select("doc_id", "c.*")


def read_entities(answer: Column) -> Column:
    """struct<entities, error, raw> of an answer: a map from kind to JSON text, or an error with the raw answer."""
    said = T.json_from_text(answer, "map<string,string>")
    return F.struct(said.alias("entities"), F.when(said.isNull(), UNREAD_ENTITIES).alias("error"), F.when(said.isNull(), answer).alias("raw"))


def entities(texts: DataFrame, provider: str = "hash", schema: str | None = None) -> DataFrame:
    """(doc_id, entities, error, raw) of every text: what ``schema`` (JSON) names, or people, companies, amounts, dates and numbers."""
    wanted = f"the entities of this JSON schema: {schema}" if schema else "people, companies, amounts of money, dates and document numbers"
    ask = F.lit(f"Extract from the text {wanted}. Answer with JSON only.\n")
    rows = texts.select("doc_id", F.concat(ask, F.substring(F.coalesce("text", F.lit("")), 1, 4000)).alias("prompt"))
    return P.ask(rows, provider).select("doc_id", read_entities(F.col("answer")).alias("e")).select("doc_id", "e.*")


def analyze(blocks: DataFrame, headings: DataFrame, provider: str = "hash", budget: int = 8000) -> DataFrame:
    """(doc_id, n_blocks, n_headings, analysis) of classified blocks: a model's answer to contents, counts and budgeted sections."""
    sizes = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if("is_heading").alias("n_headings"))
    rows = sizes.join(contents(headings), "doc_id", "left").join(X.analysis_sections(blocks, budget), "doc_id", "left")
    part = lambda title, c: F.concat(F.lit(f"\n{title}:\n"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    ask = F.concat(
        F.lit("Analyse the document: summary, key points, sections, references, quality."),
        part("Blocks", "n_blocks"), part("Headings", "n_headings"), part("Contents", "toc"), part("Sections", "context"),
    )
    return P.ask(rows.select("doc_id", "n_blocks", "n_headings", ask.alias("prompt")), provider, out="analysis").drop("prompt")


def document_structure(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, toc, sections, n_headings, n_fonts, layout): contents, authored sections in order, and counts of a document's blocks."""
    fields = ("section", "heading", "page", "char_count", "block_count")
    parts = B.authored_sections(blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sections"))
    rows = X.structure(blocks).drop("n_sections").join(contents(headings), "doc_id", "left").join(parts, "doc_id", "left")
    nothing = F.array().cast(parts.schema["sections"].dataType)
    return rows.select("doc_id", F.coalesce("toc", F.lit("")).alias("toc"), F.coalesce("sections", nothing).alias("sections"), "n_headings", "n_fonts", "layout")


def table_summaries(tables: DataFrame, cap: int = 20) -> DataFrame:
    """(doc_id, tables array<struct<index, rows, preview>>): the first ``cap`` tables (doc_id, k, md) of a document, numbered from 0.

    A table has a row for every line of its trimmed text; the preview is its first 200 characters. A null text is empty.
    """
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    md = F.coalesce("md", F.lit(""))
    one = F.struct(F.col("index"), F.size(F.split(T.strip(md), "\n")).alias("rows"), F.substring(md, 1, 200).alias("preview"))
    rows = tables.withColumn("index", index).where(F.col("index") < cap)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("tables"))


def counted(rows: DataFrame | None, name: str, documents: DataFrame) -> DataFrame:
    """(doc_id, name): how many of ``rows`` (doc_id) each of ``documents`` has; none at all where there is no such table."""
    if rows is None:
        return documents.withColumn(name, F.lit(0).cast("long"))
    return documents.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def structure_report(
    blocks: DataFrame, headings: DataFrame, tables: DataFrame | None = None, quality: DataFrame | None = None, annotations: DataFrame | None = None,
    links: DataFrame | None = None, fonts: int = 10,
) -> DataFrame:
    """(doc_id, toc, sections, layout, fonts, tables, quality, n_annotations, n_links): a document's whole structure as one row.

    ``toc`` has every heading's level (0 if null), first line and page, without those that are boilerplate; ``sections`` are
    `blocks.authored_sections`; ``layout`` counts the text blocks of each type, "unknown" if null; ``fonts`` are the most
    frequent ones, ties to the one seen first; ``tables`` as in `table_summaries`. Documents without a part have an empty
    array or 0 there, and a null quality. Each part is one aggregate by document.
    """
    documents = blocks.select("doc_id").distinct()
    line = lambda n: F.substring(F.substring_index(T.strip(F.coalesce("text", F.lit(""))), "\n", 1), 1, n)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    listed = headings.withColumn("title", line(80)).where(~F.lower("title").isin(*T.BOILERPLATE_HEADINGS))
    listed = listed.groupBy("doc_id").agg(ordered("block_no", F.coalesce("level", F.lit(0)).alias("level"), F.col("title").alias("text"), "page").alias("toc"))
    listed = listed.withColumn("toc", F.transform("toc", lambda h: h.dropFields("block_no")))
    texts = blocks.where("type = 'text'")
    parts = B.authored_sections(texts).groupBy("doc_id").agg(ordered("section", "heading", "page", "char_count", "block_count").alias("sections"))
    kinds = texts.groupBy("doc_id", F.coalesce("layout_type", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("doc_id").agg(ordered("kind", "n").alias("layout"))
    used = texts.where("font <> ''").groupBy("doc_id", "font").agg(F.count("*").alias("n"), F.min("block_no").alias("seen"))
    used = used.groupBy("doc_id").agg(ordered((-F.col("n")).alias("_less"), "seen", "font", "n").alias("fonts"))
    used = used.withColumn("fonts", F.transform(F.slice("fonts", 1, fonts), lambda f: f.dropFields("_less", "seen")))
    out = documents
    for part in (listed, parts, kinds, used, None if tables is None else table_summaries(tables)):
        out = out if part is None else out.join(part, "doc_id", "left")
    if tables is None:
        out = out.withColumn("tables", F.lit(None).cast("array<struct<index:int,rows:int,preview:string>>"))
    for name in ("toc", "sections", "layout", "fonts", "tables"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    scored = documents.withColumn("quality", F.lit(None).cast("double")) if quality is None else quality.select("doc_id", F.col("overall").alias("quality"))
    out = out.join(scored, "doc_id", "left")
    for rows, name in ((annotations, "n_annotations"), (links, "n_links")):
        out = out.join(counted(rows, name, documents), "doc_id")
    return out


def document_tools(parts: dict[str, DataFrame], store: DataFrame, provider: str = "hash") -> P.Tools:
    """The registry of all six tools over what `api.extract` and `api.load` gave; an unknown name raises ValueError."""
    blocks, headings, text = parts["blocks"], parts["headings"], parts["text"]

    def search(query: str) -> DataFrame:
        asked = store.sparkSession.createDataFrame([(0, query)], "base long, query string")
        return api.chat_context(store, asked, provider)

    tools = P.Tools()
    tools.register("search_document", search)
    tools.register("summarize_document", partial(summarize, text, headings, provider))
    tools.register("classify_document", partial(classify, text, provider))
    tools.register("analyze_document", partial(analyze, blocks, headings, provider))
    tools.register("extract_structure", partial(document_structure, blocks, headings))
    tools.register("map_arguments", partial(api.mindmaps, text, headings, provider))
    return tools
