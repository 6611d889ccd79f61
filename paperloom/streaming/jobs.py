"""Structured Streaming forms: event-time windows, job states, admission control and sinks.

Every one has a batch twin in `operators.state` or below, and the same rows in both when all input is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event, n, total): counts per event-time window; with ``late``, rows later than that are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event, n) per overlapping window."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """(job_id, session_start, session_end, n): runs of a job's events without a silence of ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("job_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("job_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """The latest status and progress of every job, in update or complete mode."""
    from ..operators.state import job_view

    return job_view(events)


def admit_stream(requests: DataFrame, limit: int, window_s: float, late: str | None = None) -> DataFrame:
    """(key, seq, admitted) of a request stream; the state of a key is the times it admitted within the window.

    With ``late``, requests later than that are dropped and a key's state goes once the watermark has passed its window,
    so state is bounded by the keys of that time; without it keys are kept for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for t in rows["at"]:
            kept = [x for x in kept if x > t - window_s]
            out.append(len(kept) < limit)
            if out[-1]:
                kept.append(t)
        state.update((kept,))
        if late:
            state.setTimeoutTimestamp(max(int((max(kept, default=0) + window_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "admitted": out})

    requests = requests.withWatermark("ts", late) if late else requests
    rows = requests.select("key", "seq", (F.unix_micros("ts") / 1e6).alias("at"), *(["ts"] if late else []))
    kind = requests.schema["key"].dataType.simpleString()
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq long, admitted boolean", "times array<double>", "append", timeout)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """All available rows of ``stream`` into the memory table ``name``."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_pipeline(stream: DataFrame, sink: str, process, checkpoint: str):
    """Each micro-batch of new documents through ``process`` and into Parquet under ``sink``, once a batch number."""

    def write(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
