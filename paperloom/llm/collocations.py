"""Phrases of two to four words that occur together more than their parts explain, counted in counting quotient filters.

A word's number is a 64-bit hash of its language and itself, checked to be one to one over all words. An n-gram is packed as
its n numbers. A filter permutes the first by a hash of the others, which can be undone, so keys spread evenly and lose
nothing: the high bits of the permuted number are the quotient, its low bits and the other numbers the remainder. Entries lie
in quotient order as one run length a quotient, remainders without their quotients and short counters, so filters of
different tasks merge in one pass.

An n-gram can only reach the least count if the (n-1)-grams in it do, so levels go up from pairs, and each level first asks
a bit set of the level below. False hits of the bit set cost time, not correctness: every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, scratch_path, small_batches
from .shingles import mix

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ODD = np.uint64(0x9E3779B97F4A7C15)
SHARD = "shard long, entries binary"
GRAMS = "key array<bigint>, hash bigint, a bigint"


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of ``columns``."""
    return reduce(lambda h, c: mix(h * ODD + c), columns, np.full(len(columns[0]), len(columns), np.uint64))


class QuotientFilter:
    """Sorted distinct keys of n 64-bit numbers with exact counts; ``head`` is the permuted first number, ``rest`` the others."""

    def __init__(self, head: np.ndarray, rest: list[np.ndarray], count: np.ndarray):
        self.head, self.rest, self.count = head, rest, count

    @classmethod
    def of(cls, head: np.ndarray, rest: list[np.ndarray], count: np.ndarray) -> QuotientFilter:
        """Adds the counts of equal keys up, in any order given."""
        by = np.argsort(head, kind="stable")
        same = lambda: (head[by][1:] == head[by][:-1]) & np.logical_and.reduce([c[by][1:] == c[by][:-1] for c in rest])
        new = ~same()
        if (new & (head[by][1:] == head[by][:-1])).any():  # different keys that share their head
            by = np.lexsort([*rest[::-1], head])
            new = ~same()
        first = np.flatnonzero(np.append(True, new)[: len(head)])
        return cls(head[by][first], [c[by][first] for c in rest], np.add.reduceat(count[by], first) if len(first) else count[:0])

    @classmethod
    def of_grams(cls, columns: list[np.ndarray]) -> QuotientFilter:
        return cls.of(columns[0] ^ hashed(columns[1:]), columns[1:], np.ones(len(columns[0]), np.int64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        if len(filters) == 1:
            return filters[0]
        rest = [np.concatenate(c) for c in zip(*(f.rest for f in filters), strict=True)]
        return cls.of(np.concatenate([f.head for f in filters]), rest, np.concatenate([f.count for f in filters]))

    def __len__(self) -> int:
        return len(self.head)

    def columns(self) -> list[np.ndarray]:
        """The numbers as they were before the permutation."""
        return [self.head ^ hashed(self.rest), *self.rest]

    def part(self, lo: int, hi: int) -> QuotientFilter:
        return QuotientFilter(self.head[lo:hi], [c[lo:hi] for c in self.rest], self.count[lo:hi])

    def to_bytes(self, top: int) -> bytes:
        """The entries, all of whose heads share their ``top`` highest bits, in about one quotient an entry."""
        bits = max(1, min(len(self), 1 << 30).bit_length())
        low = 64 - top - bits
        wide = (low + 7) // 8
        within = (self.head << np.uint64(top)) >> np.uint64(top) if top else self.head
        runs = np.bincount((within >> np.uint64(low)).astype(np.int64), minlength=1 << bits)
        remainder = self.head & np.uint64((1 << low) - 1)
        out = [np.array([len(self), self.head[0] >> np.uint64(64 - top) if top else 0, top, bits, len(self.rest)], "<u8").tobytes()]
        for x in (runs, self.count):  # one byte each, 255 for those listed after
            big = x >= 255
            out += [np.array([big.sum()], "<u8").tobytes(), np.where(big, 255, x).astype(np.uint8).tobytes(), x[big].astype("<i8").tobytes()]
        out.append(np.ascontiguousarray(remainder.astype("<u8")[:, None].view(np.uint8)[:, :wide]).tobytes())
        return b"".join([*out, *(c.astype("<u8").tobytes() for c in self.rest)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        n, high, top, bits, others = np.frombuffer(raw, "<u8", 5).tolist()
        at, counters = 40, []
        for size in (1 << bits, n):
            big = int(np.frombuffer(raw, "<u8", 1, at)[0])
            x = np.frombuffer(raw, np.uint8, size, at + 8).astype(np.int64)
            x[x == 255] = np.frombuffer(raw, "<i8", big, at + 8 + size)
            counters.append(x)
            at += 8 + size + 8 * big
        runs, count = counters
        low = 64 - top - bits
        wide = (low + 7) // 8
        remainder = np.zeros((n, 8), np.uint8)
        remainder[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(n, wide)
        head = remainder.view("<u8")[:, 0] | np.repeat(np.arange(1 << bits, dtype=np.uint64), runs) << np.uint64(low)
        if top:
            head |= np.uint64(high << (64 - top))
        at += n * wide
        return cls(head, [np.frombuffer(raw, "<u8", n, at + 8 * n * i) for i in range(others)], count)


def tokens(text: str, lang: str) -> tuple[Column, Column]:
    """(lang, words and breaks of the text in order)."""
    said = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.regexp_extract_all(said, F.lit(TOKEN), F.lit(0)).alias("tokens")


def number(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


def word_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, a) of all words with the seed under which no two share their id and none has 0."""
    counted = materialize(
        rows.select("lang", F.explode("tokens").alias("word")).where(F.position(F.substring("word", 1, 1), F.lit(BREAKS)) == 0).groupBy("lang", "word").agg(F.count("*").alias("a")),
        "words",
    )
    seed = 0
    while True:
        words = counted.withColumn("id", number(F.col("lang"), F.col("word"), seed))
        if words.groupBy("id").count().where("count > 1 or id = 0").isEmpty():
            return words, seed
        seed += 1


def bit_set(hashes: DataFrame, most: int = 22) -> np.ndarray:
    """A set of bits that has those of all ``hashes`` (column hash): 2**most words of 64 bits, 32 MB, at most."""
    slots = 1 << min(most, max(10, (hashes.count() // 4).bit_length()))
    at = F.shiftrightunsigned("hash", 6).bitwiseAND(slots - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(63).cast("int"))
    got = hashes.groupBy(at.cast("int").alias("slot")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(slots, np.uint64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h >> np.uint64(6)).astype(np.int64) & (len(bits) - 1)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def encoded(rows: DataFrame, frequent: DataFrame, seed: int) -> DataFrame:
    """(ids) of every text, written: the numbers of its words, 0 in place of breaks and of words that are not frequent."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bit_set(frequent.select(F.col("id").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            flat = np.where(among(sent.value, flat.view(np.uint64)), flat, 0)
            of = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.append(True, (flat[1:] != 0) | (flat[:-1] != 0) | (of[1:] != of[:-1]))[: len(flat)]
            offsets = np.append(0, np.cumsum(np.bincount(of[keep], minlength=len(sizes)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep]))], names=["ids"])

    is_break = lambda t: F.position(F.substring(t, 1, 1), F.lit(BREAKS)) > 0
    ids = rows.select(F.transform("tokens", lambda t: F.when(is_break(t), F.lit(0).cast("long")).otherwise(number(F.col("lang"), t, seed))).alias("ids"))
    path = scratch_path(spark, "encoded")
    with small_batches(spark):
        ids.mapInArrow(run, "ids array<bigint>").write.option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
    return spark.read.schema("ids array<bigint>").parquet(path)


def grams(texts: DataFrame, n: int, least: int, below: np.ndarray, shards: int, pending: int = 2_000_000) -> DataFrame:
    """(key, hash, a) of the n-grams that occur ``least`` times or more; ``below`` has the frequent (n-1)-grams, ``shards`` is a power of two."""
    sent = texts.sparkSession.sparkContext.broadcast(below)
    top = shards.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[QuotientFilter] = []
        fresh, room = [], 0

        def settle() -> None:
            if fresh:
                held.append(QuotientFilter.of_grams([np.concatenate(c) for c in zip(*fresh, strict=True)]))
                fresh.clear()
            if len(held) > 1:
                held[:] = [QuotientFilter.merged(held)]

        def given() -> Iterator[pa.RecordBatch]:
            if held and len(held[0]):
                f = held.pop()
                of = (f.head >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(f), np.int64)
                cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(f)]
                for step in range(0, len(cut) - 1, 256):
                    spans = list(zip(cut[step : step + 256], cut[step + 1 : step + 257], strict=False))
                    spans = [(lo, hi) for lo, hi in spans if hi > lo]
                    yield pa.RecordBatch.from_arrays([pa.array([int(of[lo]) for lo, _ in spans], pa.int64()), pa.array([f.part(lo, hi).to_bytes(top) for lo, hi in spans], pa.binary())], names=["shard", "entries"])

        for batch in batches:
            lists = batch["ids"]
            ends = lists.offsets.to_numpy()
            flat = np.insert(lists.flatten().to_numpy(), ends[1:-1] - ends[0], 0).view(np.uint64)
            m = len(flat) - n + 1
            if m < 1:
                continue
            if n == 2:
                at = np.flatnonzero((flat[1:] != 0) & (flat[:-1] != 0))
            else:
                part = hashed([flat[i : len(flat) - n + 2 + i] for i in range(n - 1)])
                live = among(sent.value, part)
                at = np.flatnonzero(live[1:] & live[:-1] & np.logical_and.reduce([flat[i : m + i] != 0 for i in range(n)]))
            fresh.append([flat[at + i] for i in range(n)])
            room += len(at)
            if room >= pending:
                settle()
                room = 0
                if len(held[0]) >= 2 * pending:
                    yield from given()
        settle()
        yield from given()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard; filters of one shard are merged as they come."""
        shard, held, size = None, [], 0

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                f = QuotientFilter.merged(held)
                if len(hit := np.flatnonzero(f.count >= least)):
                    f = QuotientFilter(f.head[hit], [c[hit] for c in f.rest], f.count[hit])
                    cols = f.columns()
                    key = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * n), pa.array(np.stack(cols, axis=1).ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(hashed(cols).view(np.int64)), pa.array(f.count)], names=["key", "hash", "a"])

        for batch in batches:
            for s, raw in zip(batch["shard"].to_pylist(), batch["entries"], strict=True):
                if s != shard:
                    yield from given()
                    shard, held, size = s, [], 0
                held.append(QuotientFilter.from_bytes(raw.as_buffer()))
                size += len(held[-1])
                if len(held) > 1 and size >= 2 * len(held[0]) + pending // 8:
                    held[:] = [QuotientFilter.merged(held)]
                    size = len(held[0])
        yield from given()

    spread = texts.mapInArrow(count, SHARD).repartition("shard").sortWithinPartitions("shard")
    return materialize(spread.mapInArrow(merge, GRAMS), f"grams{n}")


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, x)))))


def mine(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, cover: int = 80, best: int = 2000, longest: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``best`` phrases of every language.

    A-Z are lower-cased; a text is cut at .,;:!? and line ends into pieces and those at spaces and tabs into words. A null
    text is empty, a null language `und`. Phrases of 2 to ``longest`` words with a >= ``least`` occurrences are candidates;
    score = floor(2000000 a / (l + r)) for the cut into two parts with the least of it, the earlier on ties, in decimal
    arithmetic. A candidate inside a longer one with at least ``cover`` percent of its occurrences is dropped. Ties in score
    go to the larger a, then to the phrase that is less in UTF-8. Repeated rows count each; other columns are ignored.
    """
    where, said = tokens(text, lang)
    rows = df.select(where, said)
    words, seed = word_counts(rows)
    frequent = materialize(words.where(F.col("a") >= least), "frequent")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = encoded(rows, frequent, seed)
    counted, below = [frequent.select(F.array("id").alias("key"), "a")], np.zeros(1, np.uint64)
    for n in range(2, longest + 1):
        level = grams(texts, n, least, below, power_of_two(total * (8 * n + 2) / (64 << 20)))
        counted.append(level.select("key", "a"))
        if n < longest:
            below = bit_set(level)
    counts = reduce(DataFrame.union, counted)
    candidates = reduce(DataFrame.union, counted[1:])
    kept = covered(scored(candidates, counts), candidates, cover)
    return ranked(named(kept, frequent), totals, best)


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, a, l, r, score) of every candidate, at its lowest-scoring cut."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("key") - 1)))
    cuts = cuts.withColumns({"first": F.slice("key", 1, F.col("k")), "second": F.slice("key", F.col("k") + 1, F.size("key"))})
    parts = cuts.join(counts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(counts.select(F.col("key").alias("second"), F.col("a").alias("r")), "second")
    over, under = F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")
    score = ((over - over % under) / under).cast("long")  # exact: nothing is left to round
    return parts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("key", "a", "cut.l", "cut.r", "cut.score")


def covered(rows: DataFrame, candidates: DataFrame, cover: int) -> DataFrame:
    """``rows`` without those that lie inside a longer candidate with ``cover`` percent of their occurrences."""
    n = F.size("key")
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("key", i, k)))), lambda s: F.size(s) < n
    )
    longer = candidates.where(n > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    held = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    return rows.join(longer, "key", "left").where(~F.coalesce(held, F.lit(False))).drop("longer")


def named(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with lang and phrase in place of their key."""
    spelled = rows.select("key", F.posexplode("key").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return rows.join(spelled.groupBy("key").agg(F.first("lang").alias("lang"), phrase.alias("phrase")), "key").drop("key")


def ranked(rows: DataFrame, totals: DataFrame, best: int, salts: int = 64) -> DataFrame:
    """The first ``best`` of each language; first within salted parts of a language, so that a large one is ranked by many tasks."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(salts)))
    short = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    whole = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return whole.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
