"""Markdown, HTML and outline renderings of blocks, one string a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks as B
from .chunks import ordered_text


def rows_to_markdown(rows: Column, rule: bool = True) -> Column:
    """array<array<string>> as a bar table, with a rule under the first of several rows."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |")))
    if not rule:
        return F.array_join(lines, "\n")
    dash = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.when(F.size(lines) >= 2, F.concat(F.slice(lines, 1, 1), F.array(dash), F.slice(lines, 2, F.size(lines)))).otherwise(lines), "\n")


def table_to_html(md: Column) -> Column:
    """A bar table as table rows: the first one's cells as th, rules left out."""
    rows = F.transform(F.split(T.strip(md), "\n"), lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    rows = F.filter(rows, lambda x: ~(x["r"].startswith("|") & x["r"].contains("---")))
    cells = lambda r: F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|")
    tag = lambda x, t: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(x["r"]), lambda c: F.concat(F.lit(f"<{t}>"), T.escape_html(T.strip(c)), F.lit(f"</{t}>"))), ""), F.lit("</tr>"))
    html = F.transform(rows, lambda x: F.when(x["i"] == 0, tag(x, "th")).otherwise(tag(x, "td")))
    many = F.concat(F.lit("<thead>"), F.element_at(html, 1), F.lit("</thead><tbody>"), F.array_join(F.slice(html, 2, F.size(html)), ""), F.lit("</tbody>"))
    return F.when(F.size(html) > 1, many).otherwise(F.concat(F.lit("<tbody>"), F.array_join(html, ""), F.lit("</tbody>")))


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``blocks`` with ``table_md``: the k-th table text (doc_id, k, md) of the document at its k-th table block."""
    k = F.sum((F.col("type") == "table").cast("int")).over(B._so_far()) - 1
    rows = blocks.withColumn("_k", F.when(F.col("type") == "table", k).cast("int"))
    held = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "md"))).alias("_tables"))
    # Texts numbered without gaps lie at their place; else they are looked for.
    own, found = F.get("_tables", F.col("_k")), F.get(F.filter("_tables", lambda t: t["k"] == F.col("_k")), F.lit(0))
    md = F.when(F.col("_k").isNotNull(), F.when(own["k"] == F.col("_k"), own["md"]).otherwise(found["md"]))
    return rows.join(held, "doc_id", "left").withColumn("table_md", md).drop("_k", "_tables")


def parts_of(order: str, text: str) -> Column:
    """An aggregate: the group's texts that are not null, with their places, for `in_order`."""
    return F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("at"), F.col(text).alias("said"))))


def in_order(parts: str | Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["said"]), sep)


def said_note() -> Column:
    """Whether a row is a text block and a footnote; see `blocks.footnotes`."""
    return F.coalesce((F.col("type") == "text") & B.is_footnote(), F.lit(False))


def said_reference() -> Column:
    """Whether a row is a text block and a reference, all blocks of its document being there; see `blocks.references_after_heading`."""
    return F.coalesce((F.col("type") == "text") & B.is_reference(F.col("type") == "text"), F.lit(False))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings with ``#``, lists, quotes, tables and images in order; page furniture left out.

    A quotation puts an empty line before the next heading, table or image.
    """
    text, kind = F.col("text"), F.col("type")
    skip = ~F.col("is_heading") & ~F.col("is_list_item") & F.col("layout_type").isin("header", "footer")
    quote = (kind == "text") & ~F.col("is_heading") & ~F.col("is_list_item") & text.startswith(">")
    ends = F.col("is_heading") | kind.isin("table", "image")
    rows = blocks.withColumn("shown", ~F.coalesce(skip, F.lit(False))).withColumn("state", F.when(F.col("shown"), F.when(quote, True).when(ends, False)))
    before = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.last("state", ignorenulls=True).over(before), F.lit(False)))
    wrap = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    body = (
        F.when(kind == "table", wrap(F.col("table_md"))).when(kind == "image", wrap(F.concat(F.lit("![Imagem - p."), F.col("page").cast("string"), F.lit("]()"))))
        .when(F.col("is_heading"), wrap(F.concat(F.repeat(F.lit("#"), F.coalesce("heading_level", F.lit(1))), F.lit(" "), text)))
        .when(F.col("is_list_item"), F.concat(F.when(F.col("list_type") == "bullet", "- ").otherwise("1. "), text))
        .when(quote | text.startswith("```"), wrap(text)).otherwise(text)
    )
    part = F.when(F.col("open") & ends, F.concat(F.lit("\n\n"), body)).otherwise(body)
    rows = rows.withColumn("part", F.when(F.col("shown"), part))
    line = F.concat(F.lit("- "), T.strip(text))
    rows = rows.withColumn("note", F.when(said_note(), line)).withColumn("ref", F.when(said_reference(), line))
    out = rows.groupBy("doc_id").agg(*(parts_of("block_no", c).alias(c) for c in ("part", "note", "ref"))).where(F.size("part") > 0)
    tail = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n---\n**{title}:**\n"), in_order(c, "\n"))).otherwise("")
    return out.select("doc_id", F.concat(T.strip(in_order("part", "\n\n")), tail("note", "Notas de rodapé"), tail("ref", "Referências")).alias("markdown"))


def html(blocks: DataFrame) -> DataFrame:
    """(doc_id, html): an article of headings, paragraphs, quotes, code, lists, and tables and images as figures, then notes and references.

    A run of list items is one list of its first one's kind; ``table_md`` (see `with_tables`), width and height may be absent.
    """
    for name, kind in (("table_md", "string"), ("width", "int"), ("height", "int")):
        blocks = blocks if name in blocks.columns else blocks.withColumn(name, F.lit(None).cast(kind))
    skip = ~F.col("is_heading") & ~F.col("is_list_item") & F.col("layout_type").isin("header", "footer")
    rows = blocks.withColumn("shown", ~F.coalesce(skip, F.lit(False))).withColumn("is_list_item", F.coalesce(F.col("is_list_item") & ~F.col("is_heading"), F.lit(False)))
    rows = B.list_runs(rows, F.col("shown"))
    page, text = F.concat(F.lit(' data-page="'), F.col("page").cast("string"), F.lit('"')), T.escape_html(F.col("text"))
    h = F.coalesce("heading_level", F.lit(1)).cast("string")
    item = F.concat(F.lit("<li>"), text, F.lit("</li>"))
    figure = lambda *inside: F.concat(F.lit("<figure"), page, F.lit(">"), *inside, F.lit("</figure>"))
    size = lambda n: F.concat(F.lit(f'{n}="'), F.coalesce(n, F.lit(0)).cast("string"), F.lit('"'))
    image = figure(F.lit('<img src="" alt="Imagem p.'), F.col("page").cast("string"), F.lit('" '), size("width"), F.lit(" "), size("height"), F.lit("/>"))
    one = (
        F.when(F.col("type") == "table", figure(F.lit("<table>"), table_to_html(F.col("table_md")), F.lit("</table>"))).when(F.col("type") == "image", image)
        .when(F.col("is_heading"), F.concat(F.lit("<h"), h, page, F.lit(">"), text, F.lit("</h"), h, F.lit(">"))).when(F.col("is_list_item"), item)
        .when(F.col("text").startswith("> "), F.concat(F.lit("<blockquote"), page, F.lit("><p>"), T.escape_html(F.substr("text", F.lit(3))), F.lit("</p></blockquote>")))
        .when(F.col("text").startswith("```"), F.concat(F.lit("<pre><code"), page, F.lit(">"), T.escape_html(F.regexp_replace("text", "^`+|`+$", "")), F.lit("</code></pre>")))
        .otherwise(F.concat(F.lit("<p"), page, F.lit(">"), text, F.lit("</p>")))
    )
    rows = rows.withColumn("part", F.when(F.col("shown"), one)).withColumn("g", F.coalesce(F.col("run"), -F.col("block_no") - 1))
    line = F.concat(F.lit("<p>"), T.escape_html(T.strip(F.col("text"))), F.lit("</p>"))
    rows = rows.withColumn("note", F.when(said_note(), line)).withColumn("ref", F.when(said_reference(), line)).withColumn("at", F.when(F.col("part").isNotNull(), F.col("block_no")))
    joined = in_order(parts_of("block_no", "part"), "\n")
    runs = rows.groupBy("doc_id", "g").agg(
        F.min("at").alias("at"), joined.alias("part"), F.min_by("list_type", "at").alias("kind"), F.max("run").alias("run"), *(parts_of("block_no", c).alias(c) for c in ("note", "ref"))
    )
    style = F.when(F.col("kind") == "bullet", "ul").otherwise("ol")
    runs = runs.withColumn("part", F.when(F.col("run").isNotNull(), F.concat(F.lit("<"), style, F.lit(">\n"), "part", F.lit("\n</"), style, F.lit(">"))).otherwise(F.col("part")))
    runs = runs.withColumn("part", F.when(F.col("at").isNotNull(), F.col("part")))
    out = runs.groupBy("doc_id").agg(parts_of("at", "part").alias("part"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("note", "ref"))).where(F.size("part") > 0)
    section = lambda c, name, title: F.when(
        F.size(c) > 0, F.concat(F.lit(f'\n<hr/><section class="{name}">\n<h2>{title}</h2>\n'), in_order(c, "\n"), F.lit("\n</section>"))
    ).otherwise("")
    body = F.concat(in_order("part", "\n"), section("note", "footnotes", "Notas de rodapé"), section("ref", "references", "Referências"))
    return out.select("doc_id", F.concat(F.lit('<article class="document">\n'), body, F.lit("\n</article>")).alias("html"))


def outline(headings: DataFrame) -> DataFrame:
    """(doc_id, outline): every heading (doc_id, block_no, level, text), by the first 80 characters of its first line, as nested marks under a title."""
    line = F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), F.substring(F.substring_index(T.strip(F.col("text")), "\n", 1), 1, 80))
    return headings.withColumn("line", line).groupBy("doc_id").agg(F.concat(F.lit("# Documento\n"), ordered_text("block_no", "line", "\n")).alias("outline"))


#: Marks of argument kinds and relations.
ICONS = {"conceito": "📘", "argumento": "⚡", "exemplo": "📌", "contra-argumento": "⚠️", "conclusao": "✅"}
ARROWS = {"suporta": "→", "contrasta": "⇝", "exemplifica": "⇒", "conclui": "⇛"}
MAP_SCHEMA = "titulo string, tese_central string, topicos array<struct<nome:string,tipo:string,descricao:string,subtopicos:array<struct<nome:string,tipo:string,descricao:string>>>>, relacoes array<struct<de:string,para:string,tipo:string>>"


def mindmap(data: Column) -> Column:
    """A parsed argument map (MAP_SCHEMA) as nested headings."""
    pick = lambda m, key, d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key), F.lit(d))
    nothing = F.array().cast("array<string>")
    more = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(mark), c))).otherwise(nothing)
    sub = lambda s: F.concat(F.array(F.concat(F.lit("### "), pick(ICONS, F.coalesce(s["tipo"], F.lit("conceito")), "📄"), F.lit(" "), F.coalesce(s["nome"], F.lit("")))), more(s["descricao"], "#### "))
    topic = lambda t: F.concat(F.array(F.concat(F.lit("## "), pick(ICONS, F.coalesce(t["tipo"], F.lit("conceito")), "📄"), F.lit(" "), F.coalesce(t["nome"], F.lit("Tópico")))), more(t["descricao"], "### "), F.coalesce(F.flatten(F.transform(t["subtopicos"], sub)), nothing))
    rel = lambda r: F.concat(F.lit("### "), F.coalesce(r["de"], F.lit("?")), F.lit(" "), pick(ARROWS, F.coalesce(r["tipo"], F.lit("suporta")), "→"), F.lit(" "), F.coalesce(r["para"], F.lit("?")), F.lit(" ("), F.coalesce(r["tipo"], F.lit("suporta")), F.lit(")"))
    head = F.array(F.concat(F.lit("# "), F.coalesce(data["titulo"], F.lit("Documento"))))
    thesis = F.when(F.coalesce(data["tese_central"], F.lit("")) != "", F.array(F.lit("## Tese Central"), F.concat(F.lit("### "), data["tese_central"]))).otherwise(nothing)
    rels = F.when(F.coalesce(F.size(data["relacoes"]), F.lit(0)) > 0, F.concat(F.array(F.lit("## 🔗 Relações Argumentativas")), F.transform(data["relacoes"], rel))).otherwise(nothing)
    return F.array_join(F.concat(head, thesis, F.coalesce(F.flatten(F.transform(data["topicos"], topic)), nothing), rels), "\n")
