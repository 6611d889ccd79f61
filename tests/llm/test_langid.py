import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    rest = docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang", *(F.lit(None).cast("string").alias(c) for c in ("declared", "host", "suffix")))
    out = langid.identify(rest, half.select("text", "lang"))
    n, right, kept = out.agg(F.count("*"), F.sum((F.col("text_language") == F.col("lang")).cast("int")), F.sum(F.col("kept").cast("int"))).first()
    assert right / n >= 0.96 and kept / n >= 0.99


def test_pages(spark):
    pages = langid.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")).withColumn("asked", F.regexp_extract("declared", "..", 0))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(pages, docs.select("text", "lang"))
    n, right = out.agg(F.count("*"), F.sum((F.col("language") == F.col("asked")).cast("int"))).first()
    assert n == 250 and right / n >= 0.95


def test_evidence_decides_short_texts(spark):
    train = [("the cat and the dog went there with them " * 5, "en"), ("der hund und die katze gingen nicht dorthin " * 5, "de")] * 20
    labelled = spark.createDataFrame(train, "text string, lang string")
    text = "hotel"
    rows = [(1, text, "de", None, None), (2, text, "en", None, None), (3, text, None, "a.example", "de"), (4, "###", "de", None, None), (5, None, "de", "h", "de"), (6, "", None, None, None), (7, "und die katze nicht", "en", None, None), (7, "und die katze nicht", "en", None, None), (None, "the dog there", None, None, None), (9, "der hund und die katze gingen " * 20000, "en", None, None)]
    rows += [(100 + i, "der hund und die katze", None, "viele", None) for i in range(40)] + [(8, text, None, "viele", None)]
    rows += [(200 + i, "the cat and the dog", None, "many", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string").withColumn("language", F.lit("x")).drop("language")
    got = {r.doc_id: (r.language, r.kept) for r in langid.identify(docs, labelled).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and got[3][0] == "de" and got[8][0] == "de" and got[9] == ("de", True)
    assert got[4] == got[5] == got[6] == ("und", False)
    assert langid.identify(docs, labelled).count() == len(rows)
    assert langid.identify(docs.limit(0), labelled).count() == 0
    assert {r.kept for r in langid.identify(docs, labelled.limit(0)).collect()} == {False}


def test_stage_keeps_columns_and_rejects_gibberish(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "### 123 $$$", "en", "src1", 11), (10**6 + 1, None, None, None, None), (10**6 + 2, "xqzj vkwq zzxq qqjx " * 30, "en", "src1", 600)], docs.schema)
    out = langid.keep_identified(docs.unionByName(extra))
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert not ids & {10**6, 10**6 + 1, 10**6 + 2} and len(ids) >= 0.99 * docs.count()


def test_every_label_has_a_model(spark):
    codes = [a + b for a in "abcdefghij" for b in "klmnopqr"]
    rows = [(f"{c}{c[::-1]}x {c}{c}z " * 20, c) for c in codes for _ in range(2)]
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("source", F.lit("src0"))
    names, logs = langid.train(docs.select("text", "lang"))
    assert names == sorted(codes) and logs.shape[1] == 81
    out = langid.identify(langid.document_evidence(docs), docs.select("text", "lang"), models=(names, logs)).collect()
    assert all(r.language == codes[r.doc_id // 2] and r.kept for r in out) and len(out) == 160


def test_query_labels_documents_and_pages(spark):
    from paperloom.llm import queries

    out = queries.op4_fused_language_id(spark, SF)
    got = {(r["table"], r.d, r.p, r.n) for r in out.groupBy("table").agg(F.count("doc_id").alias("d"), F.count("page_id").alias("p"), F.count("*").alias("n")).collect()}
    n, p = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    assert got == {("documents", n, 0, n), ("pages", 0, p, p)}


def brute(rows, names, logs, temper=0.3, trust=0.9, suffix_trust=0.7, kappa=20.0, keep=0.5):
    """The whole fusion row by row in numpy: rows of (text, declared, host, suffix)."""
    size, cut = len(names) + 1, langid.Trigrams()
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    start = np.array([math.log(0.999 / len(names))] * len(names) + [math.log(0.001)])
    lls = []
    for text, *_ in rows:
        ids = [i for part in cut.ids(text) for i in part.tolist()]
        lls.append(sum(logs[i].astype(float) for i in ids) * temper if ids else None)
    posts = [None if x is None else soft(x + start) for x in lls]
    zero = np.zeros(size)
    whole = sum((p for p in posts if p is not None), zero)
    top = (whole + 1 / size) / (whole.sum() + 1)
    over = lambda c, parent: (c + kappa * parent) / (c.sum() + kappa)
    by_suffix, by_host, of_host = {}, {}, {}
    for (_, _, host, suffix), p in zip(rows, posts, strict=True):
        if p is not None and suffix is not None:
            by_suffix[suffix] = by_suffix.get(suffix, zero) + p
        if p is not None and host is not None:
            by_host[host] = by_host.get(host, zero) + p
            of_host[host] = max(filter(None, [of_host.get(host), suffix]), default=None)
    by_suffix = {s: over(c, top) for s, c in by_suffix.items()}
    by_host = {h: over(c, by_suffix.get(of_host[h], top)) for h, c in by_host.items()}

    def said(tag, trusted):
        if tag not in names:
            return zero
        out = np.full(size, math.log((1 - trusted) / max(1, len(names) - 1)))
        out[names.index(tag)], out[-1] = math.log(trusted), math.log(1 / max(2, len(names)))
        return out

    out = []
    for (_, declared, host, suffix), ll, p in zip(rows, lls, posts, strict=True):
        if ll is None:
            out.append(("und", None, False, "und"))
            continue
        prior = by_host.get(host, by_suffix.get(suffix, top))
        q = soft(ll + np.log(np.maximum(prior, 1e-9)) + said(langid.primary_of(declared or ""), trust) + said(langid.SUFFIX_LANGUAGE.get(suffix), suffix_trust))
        label = [*names, "und"]
        language = label[int(q.argmax())]
        out.append((language, q.max(), language != "und" and q.max() >= keep, label[int(p.argmax())]))
    return out


def fused(spark, asked, key):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = langid.train(docs.select("text", "lang"))
    held = asked.select(key, "text", "declared", "host", "suffix").collect()
    want = brute([tuple(r)[1:] for r in held], *models)
    got = {r[key]: r for r in langid.identify(asked, docs.select("text", "lang"), models=models).collect()}
    assert len(got) == len(held)
    for r, (language, posterior, kept, text_language) in zip(held, want, strict=True):
        g = got[r[key]]
        assert (g.language, g.kept, g.text_language) == (language, kept, text_language)
        assert g.posterior is None if posterior is None else abs(g.posterior - posterior) < 1e-9


def test_fusion_equals_brute_force_on_pages(spark):
    fused(spark, langid.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")), "page_id")


def test_fusion_equals_brute_force_on_documents(spark):
    fused(spark, langid.document_evidence(spark.read.parquet(f"{SF}/documents.parquet")), "doc_id")


def test_short_mixed_evidence_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["la", "the", "und ist", "hotel", "", None, "le chat"][rng.integers(7)], [None, "en", "DE-at", "xx"][rng.integers(4)], [None, "a", "b.de", "c.fr"][rng.integers(4)], [None, "de", "fr", "zz"][rng.integers(4)]) for i in range(400)]
    fused(spark, spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string"), "doc_id")


def test_attach_beyond_the_broadcast_size(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [None, "hot", "a", "zz"][i % 4]) for i in range(40)], "doc_id long, host string")
    table = spark.createDataFrame([("hot", [1.0], 10), ("a", [2.0], 1)], "host string, prior array<double>, _rows long")
    plain = sorted(map(str, langid.attach(rows, table, "host", hot=5).collect()))
    monkeypatch.setattr(langid, "small", lambda df: df)
    assert sorted(map(str, langid.attach(rows, table, "host", hot=5).collect())) == plain and len(plain) == 40


def test_stage_carries_columns_of_any_name_and_type(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    odd = docs.withColumn("_mark", F.lit(1)).withColumn("a", F.lit("x")).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("ll", F.lit(2.0))
    out = langid.keep_identified(odd)
    assert out.columns == odd.columns and out.count() == langid.keep_identified(docs).count() >= 290
    twice = langid.keep_identified(docs.unionByName(docs))
    assert twice.count() == 2 * langid.keep_identified(docs).count()
    assert langid.keep_identified(odd.limit(0)).count() == 0


def test_tags_name_their_whole_language(spark):
    tags = ["fil", "FI", "fi-FI", "gsw", "EN-US", "en_gb", " eng", "deu", "", None, "zh-Hant-TW"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = [r.p for r in df.select(langid.primary(F.col("tag")).alias("p")).collect()]
    assert got == ["fil", "fi", "fi", "gsw", "en", "en", "en", "de", "", None, "zh"]
    assert got[:-2] == [langid.primary_of(t) for t in tags[:-2]]
    pages = spark.createDataFrame([(1, "http://a.de", '<html lang="gsw-CH">'), (2, "http://a.de", "<html lang=fil>"), (3, None, "<html lang='E'>"), (4, None, None)], "page_id long, url string, html string")
    assert [r.declared for r in langid.page_evidence(pages).orderBy("page_id").collect()] == ["gsw-CH", "fil", None, None]


def test_labels_meet_declared_tags_by_language(spark):
    names = ["EN-US", "en-GB", "fi", "fil"]
    df = spark.createDataFrame([("en-GB",), ("fil",), ("eng",), ("xx",), (None,)], "tag string")
    got = [r.e for r in df.select(langid.evidence(langid.primary(F.col("tag")), names, 0.9).alias("e")).collect()]
    shared, other = [math.log(0.45)] * 2, math.log(0.05)
    want = [[*shared, other, other, math.log(0.25)], [math.log(0.1 / 3)] * 3 + [math.log(0.9), math.log(0.25)], [*shared, other, other, math.log(0.25)], [0.0] * 5, [0.0] * 5]
    assert [[round(x, 9) for x in r] for r in got] == [[round(x, 9) for x in r] for r in want]


def test_hundreds_of_labels(spark):
    docs = spark.range(900).selectExpr("concat('word', id % 300, ' ', repeat(char(97 + id % 26), 5)) AS text", "concat('l', id % 300) AS lang")
    asked = spark.createDataFrame([(1, "word aaaaa", "l26", "h", None), (2, None, "l1", None, None)], "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: r.language for r in langid.identify(asked, docs).collect()}
    assert got == {1: "l26", 2: "und"}
