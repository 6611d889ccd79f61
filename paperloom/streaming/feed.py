"""The feed of a job: its events as they come, a keepalive after silence, an end at its terminal event, state with an expiry.

`job_feed` of `operators.state` is the batch twin: the same rows from a whole log, with the log's own times as the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import CHUNKING, FEED, TERMINAL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [c.split()[0] for c in FEED.split(", ")]


class JobFeed(StatefulProcessor):
    """One job's state: (status, page, total, error), kept for ``ttl_s`` seconds after its last event."""

    def __init__(self, idle_s: float, ttl_s: float):
        self.idle_ms, self.ttl_ms = int(idle_s * 1000), int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, page long, total long, error string", self.ttl_ms)

    def _wait(self, now: int) -> None:
        """One timer a job: the silence counts from ``now``."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.idle_ms)

    def _table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["job_id", *NAMES], dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, page, total, error = self.job.get() if self.job.exists() else ("processing", None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).astype(object).itertuples():
            if status != "processing":
                break  # ended: what comes later is not told
            at, of = (None if pd.isna(x) else int(x) for x in (r.page, r.total))
            if r.event == "progress" and at is not None and (r.stage == "tables" or at % 5 == 0 or at == of):
                page, total = at, of
            elif r.event == "complete":
                status, page = "done", of if of is not None else page
                total = page
            elif r.event == "error":
                status, error = "error", (CHUNKING if r.stage == "chunk" else "") + (r.message or "")
            out.append((int(r.seq), 0, r.event, r.ts, status, page, total, error))
        if out:
            self.job.update((status, page, total, error))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status == "processing":
                self._wait(timerValues.getCurrentProcessingTimeInMs())
            yield self._table(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return  # expired: nobody waits for it
        status, page, total, error = self.job.get()
        if status == "processing":
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle_ms)
            yield self._table(key, [(None, 1, "keepalive", pd.Timestamp(now, unit="ms"), status, page, total, error)])

    def close(self) -> None:
        pass


def job_feed_stream(events: DataFrame, idle_s: float = 30, ttl_s: float = 3600) -> DataFrame:
    """(job_id, columns of FEED) of a stream of job events (job_id, seq, ts, event, page, total, stage, message), in append mode.

    The events of a job up to and with its terminal one, complete or error; after ``idle_s`` seconds of processing time
    without one, a keepalive, again and again (its ``seq`` is null). ``status``, ``page``, ``total`` and ``error`` are what the
    job has stored then; see `operators.state.job_feed`. A job is forgotten ``ttl_s`` seconds after its last event, so state
    is bounded by the jobs of that time. Timers and expiry need the RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("job_id", "seq", "ts", "event", *(F.col(c).cast("long").alias(c) for c in ("page", "total")), "stage", "message")
    kind = events.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(JobFeed(idle_s, ttl_s), f"job_id {kind}, {FEED}", "Append", "ProcessingTime")
