"""Named pipelines: what a service over these operators would call. Each is a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import render as R
from ..operators import retrieval as V
from ..operators import state as S
from ..streaming import jobs as J
from .config import PipelineConfig


def clean_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): blocks without page furniture joined in order, hyphens and orphans repaired, notation rebuilt, boilerplate dropped."""
    blocks = B.by_document(blocks)
    kept = B.without_edges(blocks, B.frequent_edges(blocks, 0.6, trim=False))
    text = kept.groupBy("doc_id").agg(C.ordered_text("block_no", "text", "\n").alias("text"))
    text = C.orphan_merge(text.withColumn("text", T.repair_hyphens(F.col("text"))))
    return text.select("doc_id", T.drop_boilerplate(T.strip(T.rebuild_math(F.col("text")))).alias("text"))


def extract(blocks: DataFrame, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """Blocks, headings, text, chunks, quality and the rendering that ``config`` asks for, as lazy tables of one corpus."""
    labelled = B.classify(blocks)
    kept = labelled.where("not is_noise")
    text = clean_text(blocks)
    shown = {"markdown": lambda: R.markdown(kept.withColumn("table_md", F.lit(None).cast("string"))), "semantic_html": lambda: R.html(kept), "text": lambda: text}[config.output_format]()
    headings = kept.where("is_heading").select("doc_id", "block_no", F.coalesce("heading_level", F.lit(4)).alias("level"), "text", "page")
    return {"blocks": kept, "headings": headings, "text": text, "chunks": C.postprocess(C.semantic_chunks(kept, config.chunk_size), config.min_chunk_tokens), "quality": B.quality(labelled, text), "output": shown}


def chunk(blocks: DataFrame | None, texts: DataFrame, config: PipelineConfig = PipelineConfig(), change_points: bool = False) -> DataFrame:
    """(doc_id, index, text, page, section, heading, depth, tokens, start_char, end_char): the chunks of every document, post-processed.

    Documents of ``texts`` that have blocks are cut by section, or with ``change_points`` into segments by headings or
    changes of their features, packed where over the size; documents without blocks, or without segments, by size.
    """
    by_size = lambda t: C.fallback_chunks(t, config.chunk_size, config.chunk_overlap)
    if blocks is None:
        return C.postprocess(by_size(texts), config.min_chunk_tokens)
    if change_points:
        made = C.packed(C.hybrid_segments(texts.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi"), blocks), "seg_no", config.chunk_size)
        bare = blocks.join(made.select("doc_id").distinct(), "doc_id", "left_anti")
        made = made.unionByName(C.semantic_chunks(bare, config.chunk_size))
    else:
        made = C.semantic_chunks(blocks, config.chunk_size)
    rest = by_size(texts.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("depth", F.lit(0))
    return C.postprocess(made.unionByName(rest, allowMissingColumns=True), config.min_chunk_tokens)


def load(chunks: DataFrame, namespace: str, provider: str = "hash") -> DataFrame:
    """Chunks as entries of a vector store: (namespace, id, text, vec, page, heading, rowid)."""
    rows = chunks.select("text", "page", "heading", F.col("doc_id").alias("_d"), F.col("index").alias("_i"))
    out = P.embed(rows, provider).withColumn("namespace", F.lit(namespace))
    return out.select("namespace", F.concat_ws(":", F.col("_d").cast("string"), F.col("_i").cast("string")).alias("id"), "text", "vec", "page", "heading", F.xxhash64("_d", "_i").alias("rowid"))


def index_chunks(chunks: DataFrame, vectors: DataFrame, namespace: str, metadata: DataFrame | None = None) -> DataFrame:
    """Chunks (doc_id, index, text) and vectors (doc_id, index, vec) made elsewhere as entries (namespace, id, text, vec, metadata, rowid).

    They meet on document and index, one row each on both sides; a chunk without a vector and a vector without a chunk are left
    out. ``metadata`` (doc_id, index, metadata) is JSON; an entry without any tells its index.
    """
    at = ["doc_id", "index"]
    rows = chunks.select(*at, "text").join(vectors.select(*at, "vec"), at)
    rows = rows.join(metadata.select(*at, "metadata"), at, "left") if metadata is not None else rows.withColumn("metadata", F.lit(None).cast("string"))
    told = F.coalesce("metadata", F.to_json(F.struct(F.col("index").alias("chunk_index"))))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":chunk_"), F.col("index").cast("string"))
    return rows.select(F.lit(namespace).alias("namespace"), name.alias("id"), "text", "vec", told.alias("metadata"), F.xxhash64(*at).alias("rowid"))


def chat_context(store: DataFrame, questions: DataFrame, provider: str = "hash", k: int = 5) -> DataFrame:
    """(base, context) for questions (base, query): expanded, searched, fused, and put together."""
    variants = P.expand(questions, provider).withColumn("query_no", F.col("base") * 1000 + F.col("query_no"))
    q = P.embed(variants, provider, text="variant", out="qvec").select("query_no", F.lit(None).cast("string").alias("namespace"), "qvec")
    hits = V.search(store, q, 2 * k).withColumn("base", F.floor(F.col("query_no") / 1000))
    return V.context(V.fuse(hits, k).join(store.select("id", "text", "page", "heading"), "id"))


def document_status(events: DataFrame) -> DataFrame:
    return S.job_view(events)


def document_chunks(chunks: DataFrame, page: int, per_page: int) -> DataFrame:
    return S.page_of(chunks, ["index"], page, per_page, "doc_id")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"))


def prompts(texts: DataFrame, task: str, cut: int = 8000) -> DataFrame:
    """(doc_id, prompt) for summarize, classify, extract or mindmap."""
    heads = {"summarize": "Summarize the document:", "classify": "Name the document's type as JSON:", "extract": "List the entities as JSON:", "mindmap": "Give the document's argument map as JSON:"}
    if task not in heads:
        raise ValueError(f"unknown task {task!r}")
    return texts.select("doc_id", F.concat(F.lit(heads[task] + "\n"), F.substring("text", 1, cut)).alias("prompt"))


def mindmaps(texts: DataFrame, headings: DataFrame, provider: str = "hash") -> DataFrame:
    """(doc_id, map): the provider's argument map, or the outline where its answer holds none."""
    answer = P.ask(prompts(texts, "mindmap"), provider)
    data = T.json_from_text(F.col("answer"), R.MAP_SCHEMA)
    found = answer.select("doc_id", F.when(data["topicos"].isNotNull(), R.mindmap(data)).alias("found"))
    return found.join(R.outline(headings), "doc_id", "left").select("doc_id", F.coalesce("found", "outline", F.lit("# Documento")).alias("map"))


def first_entries(store: DataFrame, n: int = 100) -> DataFrame:
    """A namespace's first ``n`` entries in insertion order: what a zero vector finds."""
    k = F.row_number().over(Window.partitionBy("namespace").orderBy("rowid"))
    return store.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def watch_documents(stream: DataFrame, sink: str, checkpoint: str):
    """Chunks of every new document of a stream, batch by batch."""
    from ..sources import adapters as A

    return J.run_pipeline(stream, sink, lambda batch: extract(A.blocks(batch))["chunks"], checkpoint)
