"""Jobs, sessions, caches and admission as tables: append logs, latest-per-key views, and ordered folds."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key of an append log: what upserts would have left. Partial aggregation, no sort of a key's rows."""
    rest = F.struct(*[F.col(c) for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select(key, "_r.*")


def job_view(events: DataFrame) -> DataFrame:
    """(job_id, status, progress, n_events): terminal events decide the status, progress events count."""
    done = F.max_by("event", F.when(F.col("event").isin("complete", "error"), F.struct("ts", "seq")))
    status = F.when(done == "complete", "done").when(done == "error", "error").otherwise("processing")
    return events.groupBy("job_id").agg(status.alias("status"), F.sum((F.col("event") == "progress").cast("long")).alias("progress"), F.count("*").alias("n_events"))


TERMINAL = ("complete", "error")
#: Fixed value: what an error of the second stage begins with.
CHUNKING = "Chunking failed: "
FEED = "seq long, k long, event string, at timestamp, status string, page long, total long, error string"


def job_feed(events: DataFrame, idle_s: float = 30) -> DataFrame:
    """(job_id, columns of FEED) of a log of job events (job_id, seq, ts, event, page, total, stage, message).

    A job's events by time and number up to its first terminal one (``k`` = 0), each with what the job has stored by then:
    its status, the last page told with stage `tables`, as a multiple of five or as the last one, and the error, which
    names the second stage. Every ``idle_s`` seconds of silence before the next event are a keepalive (``k`` = 1, 2, ...),
    with the number and the state of the event before. What follows a terminal event is not told.
    """
    job = Window.partitionBy("job_id").orderBy("ts", "seq")
    upto, before = job.rowsBetween(Window.unboundedPreceding, 0), job.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event").isin(*TERMINAL)).over(before), F.lit(False))
    rows = events.withColumn("_ended", ended).where("not _ended").withColumn("_next", F.lead("ts").over(job))
    told = (F.col("event") == "progress") & ((F.col("stage") == "tables") | (F.col("page") % 5 == 0) | (F.col("page") == F.col("total")))
    stored = F.last(F.when(F.coalesce(told, F.lit(False)) & F.col("page").isNotNull(), F.struct("page", "total")), ignorenulls=True).over(upto)
    done, failed = F.col("event") == "complete", F.col("event") == "error"
    page = F.when(done, F.coalesce(F.col("total"), F.col("_stored.page"))).otherwise(F.col("_stored.page"))
    error = F.when(failed, F.concat(F.when(F.col("stage") == "chunk", CHUNKING).otherwise(""), F.coalesce("message", F.lit(""))))
    idle = int(idle_s * 1_000_000)
    waits = F.when(done | failed | F.col("_next").isNull(), F.lit(0)).otherwise(F.floor((F.unix_micros("_next") - F.unix_micros("ts") - 1) / idle))
    rows = rows.withColumn("_stored", stored).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(waits.cast("long"), F.lit(0)))))
    return rows.select(
        "job_id", F.col("seq").cast("long").alias("seq"), "k", F.when(F.col("k") > 0, "keepalive").otherwise(F.col("event")).alias("event"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("k") * idle).alias("at"), F.when(done, "done").when(failed, "error").otherwise("processing").alias("status"),
        page.cast("long").alias("page"), F.when(done, page).otherwise(F.col("_stored.total")).cast("long").alias("total"), error.alias("error"),
    )


def idle_gaps(events: DataFrame, seconds: int) -> DataFrame:
    """(job_id, seq, gap_s): events that follow ``seconds`` or more of silence of their job; each would be a keepalive."""
    gap = F.col("ts").cast("long") - F.lag(F.col("ts").cast("long")).over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    return events.withColumn("gap_s", gap).where(F.col("gap_s") > seconds).select("job_id", "seq", "gap_s")


def purge(rows: DataFrame, created: str, as_of: Column, seconds: int, closed: Column | None = None) -> DataFrame:
    """``rows`` without those older than ``seconds`` at ``as_of`` (of those that are ``closed``, if given)."""
    old = F.col(created) < as_of - F.make_dt_interval(secs=F.lit(float(seconds)))
    return rows.where(~(old & closed) if closed is not None else ~old)


def admit(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """(key, seq, admitted): a request passes if fewer than ``limit`` admitted ones of its key lie within ``window_s`` before it.

    Rejected requests leave no trace, so this is an ordered fold: keys are hashed to tasks and sorted, and a task holds only the
    admitted times of the key it is at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, deque()
        for batch in batches:
            out = []
            for k, t in zip(batch["key"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if k != key:
                    key, kept = k, deque()
                while kept and kept[0] <= t - window_s:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["seq"], pa.array(out, pa.bool_())], names=["key", "seq", "admitted"])

    rows = requests.select("key", "seq", (F.unix_micros("ts") / 1e6).alias("at")).repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInArrow(run, f"key {requests.schema['key'].dataType.simpleString()}, seq long, admitted boolean")


def session_view(messages: DataFrame) -> DataFrame:
    """(session_id, created_at, updated_at, n_messages) of a message log."""
    return messages.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("n_messages"))


def history(messages: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """The oldest (or newest) ``n`` messages of each session, by time and then number."""
    order = [F.desc("created_at"), F.desc("seq")] if newest else ["created_at", "seq"]
    return messages.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def session_history(messages: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """(session_id, created_at, updated_at, n_messages, seq, role, content): sessions joined with their ``history``."""
    told = history(messages, n, newest).select("session_id", "seq", "role", "content")
    return session_view(messages).join(told, "session_id")


def page_of(rows: DataFrame, order: list[str], page: int, per_page: int, key: str | None = None) -> DataFrame:
    """One page (from 1) of ``rows`` in each key's order, with total_pages."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1, per_page is 1..100")
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("total_pages", F.ceil(F.count("*").over(w) / per_page).cast("int"))
    return rows.where(F.col("_k").between((page - 1) * per_page + 1, page * per_page)).drop("_k")


def misses(requests: DataFrame, cache: DataFrame, as_of: Column, ttl_s: int) -> DataFrame:
    """Requests whose key no cache entry younger than ``ttl_s`` holds."""
    fresh = cache.where(F.col("created_at") >= as_of - F.make_dt_interval(secs=F.lit(float(ttl_s))))
    return requests.join(fresh.select("key").distinct(), "key", "left_anti")


def throttle(progress: DataFrame, total: str, page: str, steps: int = 50) -> DataFrame:
    """Progress rows worth telling: each ``total // steps``-th page and the last."""
    return progress.where((F.col(page) % F.greatest(F.lit(1), F.floor(F.col(total) / steps)) == 0) | (F.col(page) == F.col(total) - 1))
