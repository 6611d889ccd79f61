import os

import oracle
import pytest

from paperloom.operators import state as S
from paperloom.operators import tables as K
from paperloom.plans import api, catalogue

LOG = "id string, ts long, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, path, buckets=8):
    return K.KeyedTable(spark, str(path), spark.createDataFrame([], LOG).schema, "id", ("ts",), buckets)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_equal_the_latest_of_the_log(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert rows(t.read()) == [] and rows(t.get("a")) == []
    log = [(f"k{i}", 1, "old") for i in range(40)] + [(None, 1, None), ("", 1, "empty"), ("k0", 1, "old")]
    more = [("k3", 2, "new"), ("k3", 0, "late"), ("k99", 5, None), (None, 2, "null key")]
    t.upsert(spark.createDataFrame(log, LOG), 0)
    before = files(tmp_path)
    for _ in range(2):  # a repeated write leaves the same table
        t.upsert(spark.createDataFrame(more, LOG), 1)
        assert rows(t.read()) == rows(S.latest(spark.createDataFrame(log + more, LOG), "id", "ts"))
    t.upsert(spark.createDataFrame([], LOG), 2)
    touched = {r[0] for r in spark.createDataFrame(more, LOG).select(t.bucket_of(K.F.col("id"))).collect()}
    assert before <= files(tmp_path)
    assert {f.split("bucket=")[1].split("/")[0] for f in files(tmp_path) - before} == {str(b) for b in touched}
    want = rows(t.read())
    assert t.vacuum() == len(touched) and rows(t.read()) == want


def test_point_reads_open_one_bucket(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(f"k{i}", i, "v") for i in range(60)], LOG), 0)
    assert rows(t.get_all(spark.createDataFrame([("k1",), ("k1",), ("k59",), ("no",)], "k string"))) == [("k1", 1, "v"), ("k59", 59, "v")]
    plan = t.get("k7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [EqualNullSafe(id,k7)" in plan
    own = spark.range(1).select(t.bucket_of(K.F.lit("k7"))).first()[0]
    for f in files(tmp_path):
        if f"bucket={own}/" not in f:
            with open(f, "wb") as out:
                out.write(b"not parquet")
    assert rows(t.get("k7")) == [("k7", 7, "v")]


def test_columns_of_the_layout_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        K.KeyedTable(spark, str(tmp_path), spark.createDataFrame([], "id int, Bucket int").schema, "id", ())
    with pytest.raises(ValueError):
        K.KeyedTable(spark, str(tmp_path), spark.createDataFrame([], "id int").schema, "id", ("ts",))


def test_a_stream_of_upserts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    log = [(f"k{i % 7}", i, str(i)) for i in range(30)]
    for part in (log[:12], log[12:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = K.run_upserts(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), t, str(tmp_path / "c"))
        q.awaitTermination()
    assert rows(t.read()) == rows(S.latest(spark.createDataFrame(log, LOG), "id", "ts"))


def test_chunks_meet_their_vectors_on_the_index(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, None), (3, 0, "no vector")], "doc_id long, index int, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, None), (4, 0, [3.0])], "doc_id long, index int, vec array<double>")
    got = {r.id: (r.text, r.vec, r.metadata) for r in api.index_chunks(chunks, vectors, "n").collect()}
    assert got == {"1:chunk_0": ("a", [1.0], '{"chunk_index":0}'), "1:chunk_1": ("b", [2.0], '{"chunk_index":1}'), "2:chunk_0": (None, None, '{"chunk_index":0}')}
    assert api.index_chunks(chunks.limit(0), vectors, "n").count() == 0


@pytest.mark.parametrize("name", ["keyed_upsert", "point_read", "session_history", "index_chunks"])
def test_queries(spark, name):
    assert oracle.compare(spark, "/root/testdata/sf0.001", catalogue.QUERIES[name], catalogue.ORACLES[name]) is None
