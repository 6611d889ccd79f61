"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing runs over counts: equal bins are one run, so a plan has a few thousand steps at most, whatever the
number of documents. Each piece then takes its planned slot by joining on its rank within its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBPE, rank_encoder, read_vocabulary, rows_of
from .scratch import materialize, small

PIECES = "piece int, start long, length long, ids binary, part int, nth long"
PLAN = "length long, low long, high long, per_bin long, first_bin long, at long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, low, high, per_bin, first_bin, at) for every rank of every length.

    The pieces of ``length`` with ranks low..high-1 fill bins from ``first_bin`` on, ``per_bin`` to a bin, from offset
    ``at``. Lengths go in falling order; each piece goes where the least room is left that still holds it.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # distinct rooms that some open bin has, rising
    runs: dict[int, list[tuple[int, int]]] = {}  # room: runs of equal bins (first, how many)
    bins = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room = capacity
                first, n = bins, max(1, left // (capacity // length))
                bins += n
            per = min(room // length, left)
            used = min(n, left // per)
            steps.append((length, rank, rank + used * per, per, first, capacity - room))
            rank, left = rank + used * per, left - used * per
            leave(room - per * length, first, used)
            leave(room, first + used, n - used)
    return steps


def pieces(df: DataFrame, vocabulary: str, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids, part, nth): each document's ids and its end mark, cut only if over ``capacity``.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit values, so pieces of a sequence join end to end.
    ``nth`` counts a task's pieces of one length from 0, ``part`` is the task's number.

    Cut documents give full pieces, except that the first takes what is left over. A null text counts as empty and gives
    the end mark alone.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = rank_encoder(ByteBPE(sent.value)), TaskContext.get().partitionId(), Counter()
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            row, piece, start, length, held, nth = [], [], [], [], [], []
            for i, text in enumerate(rows_of(batch, "text")):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    held.append(ids[lo:hi].tobytes())
                    nth.append(seen[hi - lo])
                    seen[hi - lo] += 1
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                names=[key, "piece", "start", "length", "ids", "part", "nth"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, {PIECES}")


def assign(cut: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """``cut`` (key, piece, start, length, part, nth and columns to carry) with sequence_id and offset, without part and nth.

    Only the histogram (at most ``capacity`` rows) comes to the driver, and only the plan, bounded by the capacity, goes
    out. A piece's rank within its length is its ``nth`` in its part plus the pieces of that length in the parts before, so
    no rows are sorted or gathered, however many have one length, null keys or equal texts.
    """
    spark = cut.sparkSession
    rest = [c for c in cut.columns if c not in (key, "piece", "start", "length", "part", "nth")]
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = spark.createDataFrame(plan(histogram, capacity), PLAN)
    rows = cut.join(small(counts.drop("n")), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    slot = F.col("rank") - F.col("low")
    out = rows.join(F.broadcast(steps.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select(
        key, "piece", "start", "length", *rest,
        (F.col("first_bin") + F.floor(slot / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(slot, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(df: DataFrame, vocabulary: str, end: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document of ``df`` in as few sequences of at most ``capacity`` tokens as best-fit decreasing finds.

    Returns (key, piece, start, length, ids_crc32, sequence_id, offset, ids), a row for each piece: a sequence is its
    pieces' ``ids`` (see `pieces`) end to end in order of offset, and ids_crc32 their checksum after the placing. Null and empty texts are
    pieces of one token, the end mark; repeated rows are packed each for itself; null keys stay; other columns are
    ignored; no rows give no rows.
    """
    cut = materialize(pieces(df, vocabulary, end, capacity, key, text), "pieces")
    placed = assign(cut, capacity, key)
    return placed.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")
