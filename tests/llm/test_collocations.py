import numpy as np
import oracle
from pyspark.sql import functions as F

from paperloom.llm import collocations, queries
from paperloom.llm.collocations import QuotientFilter

SQL = queries.ORACLES["op12_quotient_filter_phrases"]


def small_filter(seed, n=500, others=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(1, 2**64, n, np.uint64)[rng.integers(0, n // 3, 3 * n)] for _ in range(1)] + [rng.integers(1, 4, 3 * n).astype(np.uint64) for _ in range(others)]


def counted(filters):
    out = {}
    for f in filters:
        for key, n in zip(zip(*(c.tolist() for c in f.columns()), strict=True), f.count.tolist(), strict=True):
            out[key] = out.get(key, 0) + n
    return out


def test_filters_lose_nothing():
    for others in (1, 2, 3):
        cols = small_filter(others, others=others)
        f = QuotientFilter.of_grams(cols)
        want = {}
        for key in zip(*(c.tolist() for c in cols), strict=True):
            want[key] = want.get(key, 0) + 1
        assert counted([f]) == want
        assert len(f) == len(want) and (np.diff(f.head.astype(object)) >= 0).all()


def test_filters_are_written_and_read_alike():
    f = QuotientFilter.of_grams(small_filter(4))
    f.count[:3] = [254, 255, 10**12]
    for top in (0, 1, 5):
        of = (f.head >> np.uint64(64 - top)).astype(int) if top else np.zeros(len(f), int)
        parts = [f.part(*np.searchsorted(of, [s, s + 1])) for s in range(1 << top)]
        back = [QuotientFilter.from_bytes(p.to_bytes(top)) for p in parts if len(p)]
        assert counted(back) == counted([f])
    crowded = QuotientFilter(np.arange(600, dtype=np.uint64), [np.ones(600, np.uint64)], np.ones(600, np.int64))
    assert counted([QuotientFilter.from_bytes(crowded.to_bytes(0))]) == counted([crowded])


def test_merged_filters_add_up():
    filters = [QuotientFilter.of_grams(small_filter(seed % 3)) for seed in range(6)]
    assert counted([QuotientFilter.merged(filters)]) == counted(filters)


def test_keys_that_share_their_head():
    head, rest = np.array([7, 7, 7, 3, 7], np.uint64), [np.array([1, 2, 1, 5, 2], np.uint64)]
    f = QuotientFilter.of(head, rest, np.array([1, 10, 100, 1000, 10000]))
    assert (f.head.tolist(), f.rest[0].tolist(), f.count.tolist()) == ([3, 7, 7], [5, 1, 2], [1000, 101, 10010])


def compare(spark, tmp_path, rows):
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for t in oracle.TABLES:
        if t != "documents":
            spark.range(0).write.parquet(f"{tmp_path}/{t}.parquet")
    return oracle.compare(spark, str(tmp_path), queries.QUERIES["op12_quotient_filter_phrases"], SQL)


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    texts = [None, "", " .. ", "A b a B a b", "x y z. x y z, x y", "é è é è", "a\tb\x0bc\x0cd", "p q r s t " * 40, "w " * 300, "a b", "  a b  "]
    rows = [(i, texts[i % len(texts)], ["en", None, "und", "DE"][i % 4]) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"key": F.lit(1), "a": F.lit("x"), "tokens": F.lit(2), "score": F.lit(None).cast("int")})
    assert compare(spark, tmp_path, made) is None


def test_query_equals_sql_on_documents(spark):
    assert oracle.compare(spark, "/root/testdata/sf0.01", queries.QUERIES["op12_quotient_filter_phrases"], SQL) is None


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_a_saturated_bit_set_changes_nothing(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, collocations.mine(rows, least=5).collect()))
    monkeypatch.setattr(collocations, "bit_set", lambda hashes: np.full(1024, 2**64 - 1, np.uint64))
    assert sorted(map(tuple, collocations.mine(rows, least=5).collect())) == want
