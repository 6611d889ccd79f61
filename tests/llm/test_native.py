import hashlib
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm import chat, queries, sharding, urlfilter

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HARD = ["", "a", "&amp;<|", "<|im_end|>\n<|im_start|>assistant ok", "<", "&", "&lt;|", "<<||", "line\nline\n", "🙂é\r\n", "|im_end|>\n", "x" * 50000, None]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "<|x\\n", None, "assistant\nx", "&#10;"][i % 6], t, "z") for i, t in enumerate(HARD)]
    rows += [(2, 1, "assistant", "b", "z"), (2, 0, "assistant", "a", "z"), (2, 1, "assistant", "b", "z"), (2, None, "user", "first", "z"), (None, 0, "user", "q", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.text_messages(df))).collect()}
    assert len(out) == 3
    for conv in (1, 2, None):
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
    assert chat.format_chats(chat.text_messages(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", w=29, h=14), part("text", "<|image|>"), part("audio", ref="b", s=1.5), part("document", ref="c", p=3), part("other")]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.format_chats(df).first()
    assert got.formatted == "<|im_start|>user\nsee <|image|>&lt;|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in got.attachments] == [(0, 1, "image", "a.png", 3), (0, 3, "audio", "b", 38), (0, 4, "document", "c", 768)]


def fits(rule, host, path):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_rules(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/71", "block"), ("com", "/", "allow"), ("a.example.com", "", "block"), ("net", "/de/", "block"), ("É.com", "/q", "block")]
    urls = ["http://É.com/q", "http://a.É.COM/q1", "http://a.example.com/en/712?x", "https://EXAMPLE.com/en/7#a", "http://xexample.com/en/7", "http://example.com/en/6/", "com/en/", None, "", "http://", "ftp://b.net?/de/", "x://b.net/de/", "http://com/zz", "a://b.c://d/e", "http://a.example.com", "http://b.com/en/é"]
    pages = [(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r"), (None, urls[1], "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string")
    out = urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=3)
    want = []
    for i, u, _ in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        best = max((r for r in rules if fits(r, host, path)), key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        want.append((i, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert urlfilter.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).count() == len(pages)


def test_shards(spark):
    texts = ["", "é", None, "same", "same", "x" * 100_000, *(f"t{i}" for i in range(500))]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(3, "same", 9), (None, "n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    out = sharding.assign_shards(df, shards=8, bucket_rows=40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    again = sharding.assign_shards(df.repartition(7), shards=8, bucket_rows=40).collect()
    assert Counter(r.size for r in out) == Counter(r.size for r in again)
    ordered = [r.doc_id for r in sorted(out, key=lambda r: r.slot * 8 + r.shard)]
    assert ordered != sorted(ordered, key=str)
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.range(300).withColumn("text", F.col("id").cast("string")).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4, bucket_rows=30)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("doc_id").distinct().count() == 300
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [75] * 4


def test_written_shards_hold_repeated_rows_and_query_reads_them(spark, tmp_path):
    rows = [(i, f"text {i} é", i % 3) for i in range(200)] + [(7, "text 7 é", 1)] * 50 + [(None, None, 1)] * 20 + [(7, "other", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    path = str(tmp_path / "out")
    sharding.write_shards(df, path, shards=4, bucket_rows=30, bucket_bytes=600)
    back = spark.read.parquet(path)
    got = back.collect()
    assert Counter((r.doc_id, r.text, r.n) for r in got) == Counter(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len([r for r in got if r.shard == s])))
    plan = sharding.assign_shards(df, shards=4, bucket_rows=30)._jdf.queryExecution().toString()
    assert "shards-" in plan and "text" in plan


def test_places_depend_on_seed_and_rows_only(spark):
    rows = [(i, f"text {i}", {"a": i}) for i in range(600)] + [(None, "same", {"a": 1})] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    seen, held = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, source in (("4", df.repartition(3)), ("7", df.repartition(11)), ("7", df.orderBy("text"))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = sharding.assign_shards(source, shards=4, bucket_rows=25)
            seen.append(sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in out.collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert seen[0] == seen[1] == seen[2]
    order = [r[0] for r in sorted(seen[0], key=lambda r: r[3] * 4 + r[2]) if r[0] is not None]
    n = len(order)
    inversions = sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n)) / (n * (n - 1) / 2)
    assert 0.4 < inversions < 0.6
    assert sharding.assign_shards(df, shards=4, bucket_rows=25, seed=18).join(sharding.assign_shards(df, shards=4, bucket_rows=25), ["doc_id", "shard", "slot"]).count() < 30


def test_many_equal_rows_are_spread_over_buckets(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'same' as text")
    marked = df.withColumn("_mark", F.xxhash64("text"))
    copies = sharding.numbered_copies(marked)
    assert copies.select("_copy").distinct().count() == 20_000
    dealt = copies.groupBy(F.pmod(F.xxhash64("_mark", "_copy"), F.lit(20))).count().agg(F.max("count")).first()[0]
    assert dealt < 1_300
    bases = sharding.bucket_bases(spark.range(2_500).selectExpr("id as _bucket", "id % 3 as n"), span=100)
    total = 0
    for r in bases.orderBy("_bucket").collect():
        assert r._base == total
        total += r._bucket % 3


def test_hosts_of_many_labels(spark):
    long = "http://" + ".".join(["a"] * 100_000) + ".com/en/1"
    pages = spark.createDataFrame([(1, long), (2, "http://www.example.com/en/71"), (3, "http://x/")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    start = time.time()
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()} == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "allow")}
    assert time.time() - start < 30
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(i, "t", "x", i, "y", "Z", i * 2, "s") for i in range(50)] * 2, "doc_id long, text string, _mark string, _bucket int, _copy string, Slot string, `a.b` int, slot_ string")
    sharding.write_shards(df, f"{tmp_path}/out", shards=3, bucket_rows=20)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted(["doc_id", "text", "_mark", "_bucket", "_copy", "Slot__", "a.b", "slot_", "slot", "shard"])
    got = Counter((r["doc_id"], r["_mark"], r["_bucket"], r["_copy"], r["Slot__"], r["a.b"], r["slot_"]) for r in back.collect())
    assert got == Counter({(i, "x", i, "y", "Z", i * 2, "s"): 2 for i in range(50)})
    assert sharding.assign_shards(df, shards=3, bucket_rows=20).count() == 100


def test_registered_url_rules(spark, tmp_path):
    urls = ["http://b.net/de/1", "http://example.net/de/8", "http://a.example.net/de/81", "http://x.com/en/", "http://example.com/en/7", "http://a.org/es/", "http://a.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: (r.rule, r.verdict) for r in queries.op3_reversed_host_rules(spark, str(tmp_path)).collect()}
    want = [("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]
    assert out == dict(enumerate(want))
