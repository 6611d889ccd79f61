import oracle

from paperloom.operators import blocks as B
from paperloom.operators import render as R
from paperloom.plans import catalogue
from test_blocks import SF, planned, small_blocks

KINDS = "doc_id long, block_no int, page int, type string, text string, is_heading boolean, heading_level int, is_list_item boolean, list_type string, layout_type string"


def rows(spark):
    item = lambda i, t, kind="bullet": (1, i, 0, "text", t, False, None, True, kind, "list_item")
    plain = lambda i, t, layout="paragraph", kind="text": (1, i, 0, kind, t, False, None, False, None, layout)
    return spark.createDataFrame(
        [item(0, "- a"), plain(1, "Foot (2001)", "footer"), item(2, "1) b", "ordered"), plain(3, None, None, "table"), plain(4, None, None, "table"), plain(5, "References"), plain(6, "Doe, J. (1999)", "footer"), plain(7, "[1] note")],
        KINDS,
    )


def test_parts_notes_and_references_come_in_one_pass(spark):
    tables = spark.createDataFrame([(1, 0, "| x |"), (1, 5, "| far |")], "doc_id long, k int, md string")
    b = R.with_tables(rows(spark), tables)
    html, = (r.html for r in R.html(b).collect())
    assert html.startswith('<article class="document">\n<ul>\n<li>- a</li>\n<li>1) b</li>\n</ul>\n<figure data-page="0"><table><tbody><tr><th>x</th></tr></tbody></table></figure>\n<p')
    assert html.count("<p>Doe, J. (1999)</p>") == 1 and "Foot" not in html and html.count("<p>[1] note</p>") == 1
    md, = (r.markdown for r in R.markdown(b).collect())
    assert md == "- - a\n\n1. 1) b\n\n\n| x |\n\n\nReferences\n\n[1] note\n\n---\n**Notas de rodapé:**\n- [1] note\n\n---\n**Referências:**\n- Doe, J. (1999)"


def test_table_texts_with_gaps_in_their_numbers(spark):
    tables = spark.createDataFrame([(1, 1, "second"), (1, 7, "none")], "doc_id long, k int, md string")
    got = R.with_tables(rows(spark), tables).where("type = 'table'").orderBy("block_no").collect()
    assert [r.table_md for r in got] == [None, "second"]


def test_blocks_are_classified_and_hashed_once(spark):
    tables = spark.createDataFrame([(1, 0, "| x |")], "doc_id long, k int, md string")
    for render in (R.html, R.markdown):
        assert planned(spark, render(R.with_tables(B.classify(small_blocks(spark)), tables))) == (1, 0)


def test_outline_holds_every_heading(spark, tmp_path):
    heads = spark.createDataFrame([(1, i, i % 7, f" h{i} \nmore") for i in range(45)] + [(2, 0, None, "x" * 90)], "doc_id long, block_no int, level int, text string")
    one, two = (r.outline for r in R.outline(heads).orderBy("doc_id").collect())
    assert one == "\n".join(["# Documento"] + ["#" * min(i % 7 + 1, 6) + f" h{i} " for i in range(45)]) and two == "# Documento\n###### " + "x" * 80
    for name in oracle.TABLES:
        if name != "documents":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    texts = ["\n".join(f"{i}. heading {i}" if i % 3 else "word " * 40 for i in range(n)) for n in (1, 30, 31, 90)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert oracle.compare(spark, str(tmp_path), catalogue.QUERIES["outline"], catalogue.ORACLES["outline"]) is None
    longest = max(catalogue.QUERIES["outline"](spark, str(tmp_path)).collect(), key=lambda r: len(r.outline)).outline.split("\n")
    assert sum(" heading " in x for x in longest) == 60
