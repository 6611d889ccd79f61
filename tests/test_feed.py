"""The job feed: the stream with processing-time timers and expiring state, and its batch twin."""

import datetime
import json
import time

from paperloom.operators import state as S
from paperloom.streaming import feed, jobs

SCHEMA = "job_id long, seq long, ts timestamp, event string, page int, total int, stage string, message string"
T0 = datetime.datetime(2024, 1, 1)


def event(job, seq, second, kind, page=None, total=None, stage=None, message=None):
    return (job, seq, T0 + datetime.timedelta(seconds=second), kind, page, total, stage, message)


LOG = [
    event(1, 1, 0, "created"), event(1, 2, 10, "progress", 1, 10, "pages"), event(1, 3, 105, "progress", 5, 10, "pages"), event(1, 4, 106, "progress", 6, 10, "pages"),
    event(1, 5, 107, "progress", 7, 10, "tables"), event(1, 6, 108, "complete", None, 10), event(1, 7, 400, "progress", 8, 10, "pages"),
    event(2, 1, 0, "created"), event(2, 2, 30, "error", stage="chunk", message="no text"), event(2, 3, 31, "complete", None, 4),
    event(3, 1, 0, "progress", 3, 3, "pages"), event(3, 2, 61, "error", stage="extract", message=None), event(4, 1, 0, "created"),
]


def test_batch_feed(spark):
    got = sorted((r.job_id, r.seq, r.k, r.event, (r["at"] - T0).total_seconds(), r.status, r.page, r.total, r.error) for r in S.job_feed(spark.createDataFrame(LOG, SCHEMA), 30).collect())
    assert got == [
        (1, 1, 0, "created", 0, "processing", None, None, None), (1, 2, 0, "progress", 10, "processing", None, None, None),
        *((1, 2, k, "keepalive", 10 + 30 * k, "processing", None, None, None) for k in (1, 2, 3)),
        (1, 3, 0, "progress", 105, "processing", 5, 10, None), (1, 4, 0, "progress", 106, "processing", 5, 10, None), (1, 5, 0, "progress", 107, "processing", 7, 10, None),
        (1, 6, 0, "complete", 108, "done", 10, 10, None),
        (2, 1, 0, "created", 0, "processing", None, None, None), (2, 2, 0, "error", 30, "error", None, None, "Chunking failed: no text"),
        (3, 1, 0, "progress", 0, "processing", 3, 3, None), (3, 1, 1, "keepalive", 30, "processing", 3, 3, None), (3, 1, 2, "keepalive", 60, "processing", 3, 3, None),
        (3, 2, 0, "error", 61, "error", 3, 3, ""), (4, 1, 0, "created", 0, "processing", None, None, None),
    ]


def put(folder, name, rows):
    """A file appears whole."""
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    text = "\n".join(json.dumps(dict(zip(keys, [x.isoformat() if isinstance(x, datetime.datetime) else x for x in r], strict=True))) for r in rows)
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def test_stream_feed_equals_batch_and_keeps_alive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = feed.job_feed_stream(spark.readStream.schema(SCHEMA).json(str(source)), idle_s=2, ttl_s=20)
    q = stream.writeStream.format("memory").queryName("job_feed_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def until(ok, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            assert q.exception() is None
            rows = spark.table("job_feed_rows").collect()
            if ok(rows):
                return rows
            time.sleep(0.5)
        raise AssertionError([tuple(r) for r in rows])

    try:
        put(source, "a.json", [r for r in LOG if r[1] == 1])
        rows = until(lambda rows: sum(r.event == "keepalive" for r in rows if r.job_id == 1) >= 2)
        assert all(r.seq is None and r.status == "processing" for r in rows if r.event == "keepalive")
        put(source, "b.json", [r for r in LOG if r[1] > 1])
        rows = until(lambda rows: any(r.status == "done" for r in rows))
        told = lambda rows: sorted((r.job_id, r.seq, r.event, r.status, r.page, r.total, r.error) for r in rows if r.event != "keepalive")
        assert told(rows) == told(S.job_feed(spark.createDataFrame(LOG, SCHEMA), 30).collect())
        time.sleep(3)
        again = spark.table("job_feed_rows").collect()
        assert {r.job_id for r in again[len(rows) :]} <= {4}  # ended jobs are silent, the one left is kept alive
        put(source, "c.json", [event(2, 9, 500, "progress", 5, 5, "pages")])
        time.sleep(3)
        assert not any(r.seq == 9 for r in spark.table("job_feed_rows").collect())
        time.sleep(20)  # the state of job 2 has expired by now, so it starts anew
        put(source, "d.json", [event(2, 10, 600, "progress", 5, 5, "pages")])
        rows = until(lambda rows: any(r.seq == 10 for r in rows))
        assert [(r.status, r.error) for r in rows if r.seq == 10] == [("processing", None)]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_admission_state_expires(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(["a", "b"][i % 2] if i < 40 else "c", i, T0 + datetime.timedelta(seconds=3 * i)) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, seq long, ts timestamp")
    want = sorted(map(tuple, S.admit(df, 2, 10).collect()))
    for i in range(4):
        df.where(f"seq div 20 = {i}").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    jobs.run_to_table(jobs.admit_stream(stream, 2, 10, late="1 minute"), "admitted_rows", "append", str(tmp_path / "c"))
    assert sorted(map(tuple, spark.table("admitted_rows").collect())) == want
