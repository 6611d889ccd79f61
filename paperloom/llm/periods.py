"""Runs of repeated words: maximal stretches with a period at most half their length.

Periods under 64 are read off directly, word by word. Longer ones go by dyadic scales tau = 16, 32, ...: a scale finds the
periods of 4 tau to 8 tau - 1. A string synchronising set picks positions by the least hash among the windows of tau words
around them, so equal contexts of 2 tau words are picked alike; pairs of picked positions with equal contexts propose
periods. Windows with a period of at most tau / 3 are left out of the choice. They lie in runs of smaller scales, and where
two such regions of one period meet, their lengths and phases propose the periods that the set cannot see.

Every proposal is extended both ways by comparing hashed windows, so nothing is returned that is no run. Words are compared
exactly; windows of two or more are told apart by 64-bit hashes.

Why no run is missed: let a run have the period p of a scale and start at s. If a position picked lies in s .. s + p - 2 tau,
it and the one p later see equal contexts, and the pair is proposed. Otherwise all the root s .. s + p - 1 has a period of at
most tau / 3, and so has its copy; the two maximal regions around them meet at s + p, and every p they allow is proposed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import joined, rows_of
from .shingles import mix

FIRST_SCALE = 16
FAR = np.uint64(2**64 - 1)
FOLD = np.uint64(0x9E3779B97F4A7C15)
NONE = np.zeros((0, 3), np.int64)


def windows(t: np.ndarray, longest: int) -> list[np.ndarray]:
    """At k the hashes of the windows of 2**k words from each position on, up to ``longest`` words."""
    out = [mix(t.astype(np.uint64) * FOLD + np.uint64(1))]
    while 2 << len(out) - 1 <= min(longest, len(t)):
        w, h = 1 << len(out) - 1, out[-1]
        out.append(mix(h[:-w] * FOLD + (h[w:] ^ (h[w:] >> np.uint64(31)))))
    return out


def direct(t: np.ndarray, period: int, least: int) -> np.ndarray:
    """(start, end, period) of the stretches of ``period`` with at least max(least, 2 * period) words."""
    need = max(least, 2 * period) - period
    same = np.flatnonzero(t[period:] == t[:-period])
    if len(same) < need or not (same[need - 1 :] - same[: len(same) - need + 1] == need - 1).any():
        return NONE
    first = np.flatnonzero(np.diff(same, prepend=-2) != 1)
    size = np.diff(first, append=len(same))
    start, size = same[first[size >= need]], size[size >= need]
    return np.stack([start, start + size + period, np.full(len(start), period)], axis=1)


def distinct(runs: np.ndarray) -> np.ndarray:
    """One run for each start and end, of the smallest period; others are its multiples."""
    runs = runs[np.lexsort(runs.T[::-1])]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def picked(h: np.ndarray, tau: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set of scale ``tau``; ``h`` has the hashes of tau words, ``runs`` all runs of smaller periods."""
    inside = np.zeros(len(h) + 1, np.int32)
    calm = runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] - runs[:, 0] >= tau)]
    np.add.at(inside, calm[:, 0], 1)
    np.add.at(inside, calm[:, 1] - tau + 1, -1)
    key = np.where(np.cumsum(inside[:-1]) > 0, FAR, h)
    low, w = key, 1
    while w < tau:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    low = np.minimum(low[: len(key) - tau], key[tau:])
    return np.flatnonzero((low < FAR) & ((key[: len(low)] == low) | (key[tau:] == low)))


def equal_contexts(at: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) for the pairs of equal contexts from 4 tau to 8 tau - 1 apart.

    A context has no period of tau / 3 or less, so at most 24 equal ones start within 8 tau of a position.
    """
    by = np.lexsort((at, context))
    at, context = at[by], context[by]
    places, periods, k = [at[:0]], [at[:0]], 1
    while k < len(at):
        gap = at[k:] - at[:-k]
        near = (context[k:] == context[:-k]) & (gap < 8 * tau)
        if not near.any():
            break
        near &= gap >= 4 * tau
        places.append(at[:-k][near])
        periods.append(gap[near])
        k += 1
    return np.concatenate(places), np.concatenate(periods)


def seams(h: list[np.ndarray], tau: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) for the periods that two meeting regions of one small period allow.

    Regions of a period meet by less than the period, so a region meets only the next one of its period.
    """
    calm = runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] - runs[:, 0] >= 4 * tau)]
    calm = calm[np.lexsort((calm[:, 0], calm[:, 2]))]
    meet = np.flatnonzero((calm[1:, 2] == calm[:-1, 2]) & (calm[1:, 0] <= calm[:-1, 1]))
    places, periods = [calm[:0, 0]], [calm[:0, 0]]
    for (lo, hi, q), (lo2, hi2, _) in zip(calm[meet].tolist(), calm[meet + 1].tolist(), strict=True):
        k = q.bit_length() - 1
        back = q - (1 << k)
        like = np.flatnonzero((h[k][lo : lo + q] == h[k][lo2]) & (h[k][lo + back : lo + back + q] == h[k][lo2 + back]))
        if not len(like):
            continue  # their roots are no rotations of one another
        phase = (lo2 - lo - int(like[0])) % q
        p = np.arange(4 * tau + (phase - 4 * tau) % q, min(8 * tau - 1, hi - lo, hi2 - lo2) + 1, q)
        places.append(hi - p)
        periods.append(p)
    return np.concatenate(places), np.concatenate(periods)


def extended(h: list[np.ndarray], n: int, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, end, period) of the longest stretches of each period around its place."""
    a, b = place.copy(), place + period
    for k in range(len(h) - 1, -1, -1):
        ok = b + (1 << k) <= n
        ok[ok] = h[k][a[ok]] == h[k][b[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
    end, a, b = b, place.copy(), place + period
    for k in range(len(h) - 1, -1, -1):
        ok = a >= 1 << k
        ok[ok] = h[k][a[ok] - (1 << k)] == h[k][b[ok] - (1 << k)]
        a[ok] -= 1 << k
        b[ok] -= 1 << k
    return np.stack([a, end, period], axis=1)


def find_runs(t: np.ndarray, longest: int, least: int = 12) -> np.ndarray:
    """(start, end, period) of all runs of at least max(least, 2 * period) words in the numbers ``t``; ``least`` up to 16.

    ``t`` may hold many texts of at most ``longest`` words, each ended by a number that occurs nowhere else.
    """
    small = range(1, min(4 * FIRST_SCALE, longest // 2 + 1, len(t)))
    runs = distinct(np.concatenate([NONE, *(direct(t, p, least) for p in small)]))
    if longest < 8 * FIRST_SCALE:
        return runs
    h = windows(t, longest)
    for k in range(FIRST_SCALE.bit_length() - 1, len(h) - 2):
        tau = 1 << k
        at = picked(h[k], tau, runs)
        at = at[at < len(h[k + 1])]
        found = [equal_contexts(at, h[k + 1][at], tau), seams(h, tau, runs)]
        place, period = (np.concatenate(x) for x in zip(*found, strict=True))
        new = extended(h, len(t), place, period)
        new = new[new[:, 1] - new[:, 0] >= np.maximum(least, 2 * new[:, 2])]
        runs = distinct(np.concatenate([runs, new]))
    return runs


def runs_of_texts(texts: list[list[bytes]], least: int = 12) -> dict[int, np.ndarray]:
    """Text number to its (start, end, period), for the texts with runs. Texts of like length are searched together."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    classes: defaultdict[int, list[int]] = defaultdict(list)
    for i, words in enumerate(texts):
        if len(words) >= least:
            classes[len(words).bit_length()].append(i)
    out = {}
    for members in classes.values():
        ends = np.cumsum([len(texts[i]) + 1 for i in members])
        t = np.empty(ends[-1], np.int64)
        for i, end in zip(members, ends.tolist(), strict=True):
            t[end - 1 - len(texts[i]) : end - 1] = list(map(number.__getitem__, texts[i]))
        t[ends - 1] = -1 - np.arange(len(members))
        runs = find_runs(t, max(len(texts[i]) for i in members), least)
        of = np.searchsorted(ends, runs[:, 0], "right")
        runs[:, :2] -= np.append(0, ends)[of, None]
        cut = np.flatnonzero(np.diff(of)) + 1
        out |= {members[of[lo]]: runs[lo:hi] for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(of)], strict=True) if hi > lo}
    return out


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, block: int = 8_000_000) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs by start, then period, and its text with each run cut to one period.

    Words are runs of characters other than space and \\t to \\r; ``collapsed`` joins those kept by single spaces. A null,
    empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows and null keys stay; other columns
    are ignored. Nothing is shuffled: a task searches blocks of ``block`` bytes, or one longer text, together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, "text", block):
            texts = [(said or "").encode().split() for said in rows_of(batch, "text")]
            found = runs_of_texts(texts, least)
            listed, kept = [], []
            for i, words in enumerate(texts):
                runs = found.get(i, NONE)
                if len(runs):
                    stay = np.zeros(len(words) + 1, np.int32)
                    np.add.at(stay, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(stay, runs[:, 1], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(stay[:-1]) == 0).tolist()]
                kept.append(b" ".join(words).decode())
                listed.append(runs)
            flat = np.concatenate([NONE, *listed])
            parts = [pa.array(x, pa.int64()) for x in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])]
            struct = pa.StructArray.from_arrays(parts, names=["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, listed)]), pa.int32())
            counts = pa.array([len(w) for w in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"], counts, pa.ListArray.from_arrays(offsets, struct), pa.array(kept, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, n_words bigint, runs {RUN}, collapsed string")


def planted(text: Column, key: Column) -> Column:
    """``text`` with its end repeating in one row of ten by the checksum of the key; null stays null."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    root = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(root, times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, the longest run or nulls, digests of all runs and of the collapsed text) from what `detect` gives."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
