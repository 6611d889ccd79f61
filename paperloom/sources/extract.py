"""Document sources: uploaded files through pluggable parsers, and the tables, images, notes and OCR text that parsers yield.

No parser is bundled; a provider is any callable from file bytes to rows, run batch by batch on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import text as T

Parser = Callable[[bytes], list[dict]]


class Document(Protocol):
    """An opened file: its metadata, its number of pages, and the spans of one page, numbered from 0.

    ``links(page)``, if it has one, gives the page's links as dicts of uri and box (x0, y0, x1, y1).
    """

    page_count: int
    metadata: dict

    def spans(self, page: int) -> list[dict]: ...


#: From a file's bytes and its password or None to a document; raises for files that are broken or locked.
Opener = Callable[[bytes, str | None], Document]

SPANS = "path string, page int, block_no int, line_no int, span_no int, text string, size double, font string"
#: Names of annotation codes, from 0 on, and of external layout categories.
ANNOTATIONS = (
    "text", "link", "free_text", "line", "square", "circle", "polygon", "poly_line", "highlight", "underline", "squiggly", "strikeout", "stamp",
    "caret", "ink", "file_attachment", "sound", "movie", "widget", "screen", "printer_mark", "trap_net", "watermark", "3d", "redact",
    "projection", "rich_media", "web_video",
)
CATEGORIES = {
    "Title": "heading", "Header": "header", "Footer": "footer", "Table": "table", "Figure": "figure", "ListItem": "list_item", "Formula": "formula",
    "PageBreak": "page_break", "FigureCaption": "caption", "TableCaption": "caption", "NarrativeText": "paragraph", "UncategorizedText": "text",
}


def scan_files(spark: SparkSession, path: str, max_bytes: int = 50 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Files under ``path`` as (path, length, content), and those refused as (path, error): other suffixes and over ``max_bytes``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return validate(files, max_bytes)


def validate(files: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    error = F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") > max_bytes, "too large").when(F.col("length") == 0, "empty")
    rows = files.withColumn("error", error)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def parse(files: DataFrame, parser: Parser) -> DataFrame:
    """Text spans (SPANS) of each file, in parallel over files; a file that fails yields no rows here and one in `failures`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    rows = [{"path": path, **r} for r in parser(content)]
                except Exception:  # noqa: BLE001  a broken file is data, reported by failures()
                    continue
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names)

    return files.select("path", "content").mapInPandas(run, SPANS)


SPAN = "struct<page:int,block_no:int,line_no:int,span_no:int,text:string,size:double,font:string>"
LINK = "struct<page:int,uri:string,x0:double,y0:double,x1:double,y1:double>"
READ = (
    f"path string, share int, shares int, pages int, metadata map<string,string>, spans array<{SPAN}>, links array<{LINK}>, "
    "failures array<struct<page:int,error:string>>"
)


def read_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of READ as one batch."""
    struct = lambda **k: pa.list_(pa.struct(list(k.items())))
    i, s, f = pa.int32(), pa.string(), pa.float64()
    spans = struct(page=i, block_no=i, line_no=i, span_no=i, text=s, size=f, font=s)
    kinds = (s, i, i, i, pa.map_(s, s), spans, struct(page=i, uri=s, x0=f, y0=f, x1=f, y1=f), struct(page=i, error=s))
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[4] = [None if m is None else list(m.items()) for m in columns[4]]
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_documents(files: DataFrame, opener: Opener, share_bytes: int = 4 << 20, max_pages: int = 500) -> DataFrame:
    """The columns of READ: one row for each share of the pages of ``files`` (path, length, content and, if need be, password).

    A file has a share for every ``share_bytes`` of it; the shares of one file are parsed by different tasks, which open it
    once each. Files of one share stay with the task that read them; only larger ones travel. Spans and failures come from
    the same pass: a file that does not open, or has no or over ``max_pages`` pages, has one failure with a null page, in its first share; a page that fails
    has its own. Write the result once and take `documents_of`, `spans_of` and `failures_of` from it. Null contents and
    lengths count as empty files.
    """
    names = [c.split(":")[0] for c in SPAN.removeprefix("struct<").removesuffix(">").split(",")]
    asked = ["path", "content", "password", "share", "shares"]

    def share(path: str, content: bytes | None, password: str | None, k: int, n: int) -> tuple:
        try:
            opened = opener(bytes(content or b""), password)
            pages, about = opened.page_count, {str(a): "" if b is None else str(b) for a, b in opened.metadata.items()}
        except Exception as e:  # noqa: BLE001  a broken file is data
            return path, k, n, None, None, [], [], [(None, f"{type(e).__name__}: {e}")] if k == 0 else []
        if not 0 < pages <= max_pages:
            return path, k, n, pages, about, [], [], [(None, "too many pages" if pages else "empty")] if k == 0 else []
        spans, links, failed = [], [], []
        for page in range(pages * k // n, pages * (k + 1) // n):
            try:
                found = [tuple({"page": page, **s}.get(c) for c in names) for s in opened.spans(page)]
                linked = opened.links(page) if hasattr(opened, "links") else []
                links += [(page, x.get("uri") or "", *map(float, x.get("box") or (0, 0, 0, 0))) for x in linked]
                spans += found
            except Exception as e:  # noqa: BLE001
                failed.append((page, f"{type(e).__name__}: {e}"))
        return path, k, n, pages, about, spans, links, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for path, content, password, k, n in zip(*(b[c] for c in asked), strict=True):
                held.append(share(path.as_py(), content.as_py(), password.as_py(), k.as_py(), n.as_py()))
                size += min(len(content.as_py() or b""), share_bytes)
                if size >= 4 << 20 or len(held) == 1000:
                    yield read_batch(held)
                    held, size = [], 0
            if held:
                yield read_batch(held)

    rows = files if "password" in files.columns else files.withColumn("password", F.lit(None).cast("string"))
    rows = rows.withColumn("shares", F.greatest(F.lit(1), F.ceil(F.coalesce("length", F.lit(0)) / share_bytes)).cast("int"))
    whole = rows.where("shares = 1").withColumn("share", F.lit(0))
    parts = rows.where("shares > 1").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).repartition("path", "share")
    return whole.select(*asked).mapInArrow(run, READ).unionByName(parts.select(*asked).mapInArrow(run, READ))


def documents_of(read: DataFrame) -> DataFrame:
    """(path, pages, metadata) of the files that opened."""
    return read.where("share = 0 and pages is not null").select("path", "pages", "metadata")


def spans_of(read: DataFrame) -> DataFrame:
    """The columns of SPANS of every page that could be read."""
    return read.select("path", F.inline("spans"))


def links_of(read: DataFrame) -> DataFrame:
    """(path, page, uri, x0, y0, x1, y1) of every link; one without an address has an empty uri, one without a box four zeros."""
    return read.select("path", F.inline("links"))


def failures_of(read: DataFrame) -> DataFrame:
    """(path, page, error): a null page stands for the whole file."""
    return read.select("path", F.inline("failures"))


def progress_of(read: DataFrame) -> DataFrame:
    """(path, share, page, total, stage): the last page of each share as a progress event of `operators.state.job_feed`."""
    last = F.floor(F.col("pages") * (F.col("share") + 1) / F.col("shares"))
    return read.where("pages > 0").select("path", "share", last.cast("long").alias("page"), F.col("pages").cast("long").alias("total"), F.lit("pages").alias("stage"))


class TextFile:
    """A plain-text document: pages of ``lines`` lines. ``%locked <password>`` as its first line locks it, ``%broken`` breaks it."""

    lines = 40

    def __init__(self, content: bytes, password: str | None):
        first, _, rest = content.decode().partition("\n")
        locked = first.startswith("%locked ")
        if first == "%broken":
            raise ValueError("broken file")
        if locked and password is None:
            raise ValueError("password needed")
        if locked and first != f"%locked {password}":
            raise ValueError("wrong password")
        self.text = (rest if locked else content.decode()).split("\n")
        self.page_count = -(-len(self.text) // self.lines)
        self.metadata = {"encrypted": str(locked).lower(), "lines": len(self.text)}

    def spans(self, page: int) -> list[dict]:
        lo = page * self.lines
        return [{"block_no": lo + i, "line_no": 0, "span_no": 0, "text": t, "size": 11.0, "font": "Text"} for i, t in enumerate(self.text[lo : lo + self.lines])]


def failures(files: DataFrame, parser: Parser) -> DataFrame:
    """(path, error) of files that ``parser`` refuses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    parser(content)
                except Exception as e:  # noqa: BLE001
                    out.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def span_runs(spans: DataFrame, line: list[str]) -> DataFrame:
    """Spans as runs (``line``, span_no, text, ends, size, font): those that stand one after another in a batch and in a line, with the first one's size and font.

    ``line`` names the columns that tell a line; ``ends`` are the places in the text, in characters, where its spans end.
    """
    rest = [*line, "span_no", "size", "font"]
    rows = spans.select(*line, F.col("span_no").cast("long").alias("span_no"), F.coalesce("text", F.lit("")).alias("text"), "size", "font")
    out = StructType([*rows.schema.fields]).add("ends", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            goes_on = np.ones(n - 1, dtype=bool)
            for name in [*line, "span_no"]:
                c = b.column(name)
                before = pc.add(c[:-1], 1) if name == "span_no" else c[:-1]
                goes_on &= pc.fill_null(pc.equal(c[1:], before), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            sizes = np.diff(np.append(starts, n))
            chars = np.cumsum(pc.utf8_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = chars - np.repeat(np.append(0, chars)[starts], sizes)
            held = pa.array(np.append(starts, n), pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(held, b.column("text")), "")
            first = {name: b.column(name).take(pa.array(starts)) for name in rest}
            first |= {"text": text, "ends": pa.ListArray.from_arrays(held, pa.array(ends, pa.int32()))}
            yield pa.RecordBatch.from_arrays([first[name] for name in out.names], names=out.names)

    return rows.mapInArrow(run, out)


def span_blocks(spans: DataFrame, key: str = "path", copy: str | None = None, strip: bool = True) -> DataFrame:
    """Spans as blocks (key, page, block_no, text, n_chars, font_size, font): lines joined by newlines; the first span's font.

    White space at a block's ends goes and blank blocks are dropped, unless ``strip`` is False. ``copy`` names a column that
    tells apart, and orders, lines of equal number, as of a repeated document. Spans are shuffled once, in the runs in which
    their batches hold them; where runs of a line meet each other's numbers, they are taken apart into spans again.
    """
    line = ["line_no", *([copy] if copy else [])]
    place, order = [key, "page", "block_no"], [*line, "span_no", "text"]
    head = F.expr("substring(text, 1, ends[0])")
    first = F.min_by(F.struct("size", "font"), F.struct(*line, "span_no", head, "size", "font"))
    block = span_runs(spans, [*place, *line]).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(*order, "ends"))).alias("s"), first.alias("first"))
    same = lambda x, y: reduce(Column.__and__, (x[c].eqNullSafe(y[c]) for c in line))
    before = lambda i: F.get("s", i - 1)
    last = lambda x: x["span_no"] + F.size(x["ends"]) - 1
    met = F.exists(F.transform("s", lambda x, i: (i > 0) & same(x, before(i)) & ~F.coalesce(x["span_no"] > last(before(i)), F.lit(False))), lambda x: x)
    cut = lambda x, i: F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
    spans_of = lambda x: F.transform(x["ends"], lambda e, i: F.struct(*(x[c].alias(c) for c in line), (x["span_no"] + i).alias("span_no"), F.substr(x["text"], cut(x, i) + 1, e - cut(x, i)).alias("text"), F.array(e - cut(x, i)).alias("ends")))
    block = block.withColumn("s", F.when(met, F.array_sort(F.flatten(F.transform("s", spans_of)))).otherwise(F.col("s")))
    said = F.transform("s", lambda x, i: F.concat(F.when((i > 0) & ~same(x, before(i)), "\n").otherwise(""), x["text"]))
    text = F.array_join(said, "")
    out = block.select(*place, (T.strip(text) if strip else text).alias("text"), F.bround(F.col("first.size"), 1).alias("font_size"), F.col("first.font").alias("font"))
    return (out.where("text <> ''") if strip else out).withColumn("n_chars", F.length("text"))


def page_guard(blocks: DataFrame, key: str, max_pages: int = 500, documents: DataFrame | None = None) -> DataFrame:
    """(key, pages, error): documents with too many pages, and those of ``documents`` (key) that have no block at all: empty."""
    pages = blocks.groupBy(key).agg((F.max("page") + 1).alias("pages"))
    if documents is not None:
        pages = documents.select(key).distinct().join(pages, key, "left").select(key, F.coalesce("pages", F.lit(0)).alias("pages"))
    return pages.withColumn("error", F.when(F.col("pages") > max_pages, "too many pages").when(F.col("pages") < 1, "empty")).where("error is not null")


def needs_ocr(blocks: DataFrame, key: str, least: int = 50) -> DataFrame:
    """(key, page): pages with fewer than ``least`` characters of text."""
    return blocks.groupBy(key, "page").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") < least).select(key, "page")


def ocr_text(lines: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(key, page, text) of recognised lines (key, page, line_no, text, conf) above a confidence."""
    held = lines.where(F.col("conf") > least).groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return held.select(key, "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def provided(rows: DataFrame, provider: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """What ``provider`` makes of each row (given as a dict), as rows of ``schema``, in parallel and batch by batch.

    The hook for tables (a file's rows of path, page, md, bbox and accuracy), for OCR of pages that `needs_ocr` finds and
    for external layout models. A row that fails gives none; the provider is called once a row.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[dict] = []
            for row in b.to_dict("records"):
                try:
                    out += provider(row)
                except Exception:  # noqa: BLE001  one broken row must not end the job
                    continue
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def with_ocr_blocks(blocks: DataFrame, recognised: DataFrame, key: str = "doc_id", least: int = 50) -> DataFrame:
    """``blocks`` and a block of type ocr for each of their pages with little text that ``recognised`` (key, page, text) holds."""
    pages = needs_ocr(blocks, key, least).join(recognised.select(key, "page", "text"), [key, "page"])
    last = blocks.groupBy(key).agg((F.max("block_no") + 1).alias("_from"))
    at = F.col("_from") + F.row_number().over(Window.partitionBy(key).orderBy("page")) - 1
    made = pages.join(last, key).select(key, "page", at.cast(blocks.schema["block_no"].dataType).alias("block_no"), F.lit("ocr").alias("type"), "text")
    return blocks.unionByName(made, allowMissingColumns=True)


def unite(texts: DataFrame, tables: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """One stream of a document's blocks: texts (key, block_no, …), then tables (key, page, md, …), then images (key, page, image_no, …).

    ``block_no`` goes on after the texts' last; tables stand by page and ``k`` (their number), images by page and number.
    Columns that a kind lacks are null there.
    """
    last = texts.groupBy(key).agg((F.max("block_no") + 1).alias("_from"))
    both = tables.withColumn("type", F.lit("table")).withColumn("_n", F.col("k"))
    both = both.unionByName(images.withColumn("type", F.lit("image")).withColumn("_n", F.col("image_no")), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("type"), "page", "_n")) - 1
    both = both.withColumn("_place", place).join(last, key, "left")
    both = both.withColumn("block_no", (F.coalesce("_from", F.lit(0)) + F.col("_place")).cast(texts.schema["block_no"].dataType)).drop("_place", "_from", "_n")
    return texts.withColumn("type", F.lit("text")).unionByName(both, allowMissingColumns=True)


def first_confident(results: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Of results by several backends (keys, priority, text, conf), the first with mean confidence ``least`` or more; else ("", 0)."""
    ok = F.col("conf") >= least
    best = F.min_by(F.struct("text", "conf"), F.when(ok, F.col("priority")))
    return results.groupBy(*keys).agg(best.alias("b")).select(*keys, F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"))


def first_non_empty(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of table extractions by several methods (keys, priority, tables array), all of the first method that found any."""
    found = F.min_by("tables", F.when(F.size("tables") > 0, F.col("priority")))
    return results.groupBy(*keys).agg(found.alias("tables"))


def images(rows: DataFrame, key: str, cap: int = 20, max_pixels: int = 2_000_000) -> DataFrame:
    """The first ``cap`` images a document under ``max_pixels``, as base64."""
    k = F.row_number().over(Window.partitionBy(key).orderBy("page", "image_no"))
    small = rows.where(F.col("width") * F.col("height") < max_pixels).withColumn("k", k).where(F.col("k") <= cap)
    return small.select(key, "page", "image_no", "width", "height", F.base64("data").alias("data"))


def annotation_name(code: Column) -> Column:
    """The name of an annotation code; unknown ones are "unknown"."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, ANNOTATIONS)), code + 1), F.lit("unknown"))


def category(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), name), F.lit("text"))


def polygon_box(points: Column) -> Column:
    """The bounding box of array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def blank_columns(profile: DataFrame, key: str, least: float = 0.01, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(key, x): middles of blank runs at least ``least`` of the width wide and between ``low`` and ``high`` of it.

    ``profile`` is (key, ink): ink per pixel column.
    """
    px = profile.select(key, F.size("ink").alias("w"), F.posexplode("ink").alias("x", "v"))
    w = Window.partitionBy(key).orderBy("x")
    blank = px.where("v = 0").withColumn("g", F.col("x") - F.row_number().over(w))
    runs = blank.groupBy(key, "w", "g").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b")).withColumn("mid", (F.col("a") + F.col("b")) / 2)
    return runs.where((F.col("b") - F.col("a") >= F.col("w") * least) & F.col("mid").between(F.col("w") * low, F.col("w") * high)).select(key, F.col("mid").alias("x"))
