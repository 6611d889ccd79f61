"""Segments and chunks: sections as text, packing, merging, change points.

Ordered folds whose state is small are closed forms over windows (runs and parities) or ``aggregate`` over a document's
array; only the change-point search runs in Python, one document at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from . import blocks as B


def _in(order: str):
    return Window.partitionBy("doc_id").orderBy(order)


def _upto(order: str):
    return _in(order).rowsBetween(Window.unboundedPreceding, 0)


def ordered_text(order: str, text: str, sep: str) -> Column:
    """An aggregate: the group's texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def section_texts(blocks: DataFrame, cut: int | None = 100) -> DataFrame:
    """(doc_id, section, heading, depth, page, text): each heading with the text under it, marked with ``#``; empty ones left out."""
    rows = B.section_ids(blocks, F.col("is_heading")).withColumn("head", F.col("is_heading"))
    title = F.substring(F.substring_index(T.strip(F.col("text")), "\n", 1), 1, cut) if cut else F.col("text")
    body = F.when(~F.col("head") & (T.strip(F.col("text")) != ""), F.col("text"))
    held = rows.select("doc_id", "section", "block_no", "page", F.when(F.col("head"), title).alias("title"), F.when(F.col("head"), F.coalesce("heading_level", F.lit(1))).alias("level"), body.alias("body"))
    out = held.groupBy("doc_id", "section").agg(F.max("title").alias("heading"), F.coalesce(F.max("level"), F.lit(0)).alias("depth"), F.min(F.when(F.col("title").isNotNull() | F.col("body").isNotNull(), F.col("page"))).alias("page"), F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("block_no", "body")))).alias("parts"))
    header = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), "heading", F.lit("\n"))).otherwise("")
    text = T.strip(F.concat(header, F.array_join(F.transform("parts", lambda p: p["body"]), "\n")))
    return out.withColumn("text", text).where("text <> ''").select("doc_id", "section", "heading", "depth", F.coalesce("page", F.lit(0)).alias("page"), "text")


def greedy_pack(text: Column, size: int, sep: str = "\n\n") -> Column:
    """array<struct<text, tokens>>: paragraphs packed in order while the buffer's and the next one's tokens stay within ``size``."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        fits = T.token_count(a["buf"]) + T.token_count(p) <= size
        grow = F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(sep), p).alias("buf"))
        fresh = F.struct(F.array_append(a["out"], a["buf"]).alias("out"), p.alias("buf"))
        return F.when(a["buf"] == "", F.struct(a["out"].alias("out"), p.alias("buf"))).when(fits, grow).otherwise(fresh)

    packed = F.aggregate(F.split(text, sep), state, step, lambda a: F.when(T.strip(a["buf"]) != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]))
    return F.transform(packed, lambda x: F.struct(T.strip(x).alias("text"), T.token_count(x).alias("tokens")))


def fixed_cuts(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters every ``size - overlap``, while more than ``size`` tokens are left; then the rest."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    step = size - overlap
    # The rest after k cuts has length - k * step characters and is cut again while a third of them exceeds size.
    cuts = F.greatest(F.lit(0), F.ceil((F.length(text) - 3 * size - 2) / step)).cast("int")
    whole = F.transform(F.sequence(F.lit(0), cuts), lambda k: F.when(k < cuts, F.substr(text, k * step + 1, F.lit(size))).otherwise(F.substr(text, k * step + 1)))
    return whole


def numbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    """``chunks`` with index, start_char and end_char: running sums of their lengths, document by document."""
    by = Window.partitionBy("doc_id").orderBy(*order)
    end = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("index", F.row_number().over(by) - 1).withColumn("end_char", end).withColumn("start_char", end - F.length("text"))


def semantic_chunks(blocks: DataFrame, size: int = 2000) -> DataFrame:
    """Chunks of classified blocks by section, as `packed` gives them."""
    return packed(section_texts(blocks), "section", size)


def fallback_chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, index, text, tokens, start_char, end_char) of plain texts.

    Oversize paragraphs are cut by characters; the rest is packed while the joined buffer stays within ``size`` tokens, and
    a full buffer's tail of ``overlap`` tokens opens the next.
    """
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        cuts = fixed_cuts(p, size, overlap)
        out, rest = F.concat(a["out"], F.slice(cuts, 1, F.size(cuts) - 1)), F.element_at(cuts, -1)
        joined = F.when(a["buf"] == "", rest).otherwise(F.concat(a["buf"], F.lit("\n\n"), rest))
        carried = T.strip(F.concat(T.tail(a["buf"], overlap), F.lit("\n\n"), rest)) if overlap else rest
        full = (T.token_count(joined) > size) & (a["buf"] != "")
        return F.struct(F.when(full, F.array_append(out, a["buf"])).otherwise(out).alias("out"), F.when(full, carried).otherwise(joined).alias("buf"))

    last = lambda a: F.when(T.strip(a["buf"]) != "", F.array_append(a["out"], T.strip(a["buf"]))).otherwise(a["out"])
    rows = texts.select("doc_id", F.posexplode(F.aggregate(F.split("text", "\n\n"), state, step, last)).alias("k", "text"))
    return numbered(rows.withColumn("tokens", T.token_count(F.col("text"))), ["k"]).select("doc_id", "index", "text", "tokens", "start_char", "end_char")


def merge_tiny(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Chunks below ``least`` tokens joined with the next one, pair by pair; page and depth are the first's, headings the first's that has one.

    A run of small chunks always starts at a pair's head, so the odd places of a run are the heads.
    """
    w = _in("index")
    c = chunks.withColumn("small", F.col("tokens") < least).withColumn("new", F.col("small") & ~F.coalesce(F.lag("small").over(w), F.lit(False)))
    c = c.withColumn("run", F.sum(F.col("new").cast("int")).over(_upto("index")))
    place = F.row_number().over(Window.partitionBy("doc_id", "run", "small").orderBy("index"))
    c = c.withColumn("head", F.col("small") & (place % 2 == 1) & F.lead("index").over(w).isNotNull())
    c = c.withColumn("taken", F.coalesce(F.lag("head").over(w), F.lit(False)))
    nxt = lambda n: F.lead(n).over(w)
    text = F.when(F.col("head"), F.concat("text", F.lit("\n\n"), nxt("text"))).otherwise(F.col("text"))
    named = [n for n in ("heading", "section") if n in chunks.columns]
    c = c.withColumns({"text2": text} | {f"{n}2": F.when(F.col("head"), F.coalesce(n, nxt(n))).otherwise(F.col(n)) for n in named})
    rest = [n for n in ("page", "depth") if n in chunks.columns]
    return c.where("not taken").select("doc_id", "index", F.col("text2").alias("text"), *(F.col(f"{n}2").alias(n) for n in named), *rest, F.when(F.col("head"), T.token_count(F.col("text2"))).otherwise(F.col("tokens")).alias("tokens"))


def dedup_adjacent(chunks: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, k, text, tokens and other columns): each chunk against the last one kept.

    Contained ones go and the longer stays; of others the short lines that the last one has go, and the whole chunk where
    under 30 % of its lines or ``least`` tokens would be left.
    """
    rest = [c for c in chunks.columns if c not in ("doc_id", "index", "text")]
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "text", *rest))).alias("c"))
    kind = held.schema["c"].dataType.elementType.simpleString()
    state = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("last"))

    def step(a: Column, c: Column) -> Column:
        prev, cur = a["last"]["text"], c["text"]
        old, lines = F.split(prev, "\n"), F.split(cur, "\n")
        new = F.filter(lines, lambda x: ~F.array_contains(old, x) | (F.length(T.strip(x)) > 80))
        text = F.array_join(new, "\n")
        fields = {"text": text} | ({"tokens": T.token_count(text)} if "tokens" in rest else {})
        thinned = F.struct(*(fields.get(n, c[n]).alias(n) for n in ("index", "text", *rest)))
        inside = prev.contains(cur) | cur.contains(prev)
        longer = F.struct(a["out"].alias("out"), F.when(F.length(cur) > F.length(prev), c).otherwise(a["last"]).alias("last"))
        drop = (F.size(new) < F.size(lines) * 0.3) | (T.token_count(text) < least)
        put = F.struct(F.array_append(a["out"], a["last"]).alias("out"), thinned.alias("last"))
        return F.when(a["last"].isNull(), F.struct(a["out"].alias("out"), c.alias("last"))).when(inside, longer).when(drop, a).otherwise(put)

    kept = F.aggregate("c", state, step, lambda a: F.when(a["last"].isNotNull(), F.array_append(a["out"], a["last"])).otherwise(a["out"]))
    out = held.select("doc_id", F.posexplode(kept).alias("k", "c"))
    return out.select("doc_id", "k", "c.text", *(F.col("c")[n].alias(n) for n in rest))


def postprocess(chunks: DataFrame, least: int = 50) -> DataFrame:
    """What every chunker ends with: tiny chunks merged, repeats of the one before dropped, then those of mere formatting, numbers anew.

    ``chunks`` has doc_id, index, text, tokens and any of page, heading, section and depth, which stay.
    """
    kept = dedup_adjacent(merge_tiny(chunks, least), least).where(~T.mostly_formatting(F.col("text")))
    rest = [c for c in kept.columns if c not in ("doc_id", "k", "text", "tokens")]
    return numbered(kept, ["k"]).select("doc_id", "index", "text", *rest, "tokens", "start_char", "end_char")


def packed(parts: DataFrame, order: str, size: int) -> DataFrame:
    """(doc_id, index, text, page, section, heading, tokens, depth, start_char, end_char) of ``parts`` (doc_id, order, text, heading, depth, page).

    A part over ``size`` tokens is packed by paragraphs; blank ones go.
    """
    s = parts.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    one = F.array(F.struct(F.col("text"), T.token_count(F.col("text")).alias("tokens")))
    s = s.select("doc_id", F.col(order).alias("s"), "heading", "depth", "page", F.posexplode(F.when(T.token_count(F.col("text")) <= size, one).otherwise(greedy_pack(F.col("text"), size))).alias("k", "c"))
    s = s.select("doc_id", "s", "k", "heading", "depth", "page", "c.text", "c.tokens")
    return numbered(s, ["s", "k"]).select("doc_id", "index", "text", "page", F.col("heading").alias("section"), "heading", "tokens", "depth", "start_char", "end_char")


def islands(rows: DataFrame, starts: Column, order: str, **also: Column) -> DataFrame:
    """Rows joined into the last one that starts an island, as (doc_id, first, text and ``also`` aggregates)."""
    r = rows.withColumn("_s", starts).withColumn("_i", F.sum(F.col("_s").cast("int")).over(_upto(order)))
    return r.groupBy("doc_id", "_i").agg(F.min(order).alias(order), ordered_text(order, "text", "\n\n").alias("text"), *[c.alias(n) for n, c in also.items()]).drop("_i")


def carried(rows: DataFrame, order: str) -> dict[str, Column]:
    """What a joined segment keeps of its parts, for the columns that ``rows`` has: its first part's, but the largest depth, the first heading and the last end."""
    first = {c: F.min_by(c, order) for c in ("page", "start_char", "confidence", "method")}
    rest = {"depth": F.max("depth"), "heading": F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col(order))), "end_char": F.max_by("end_char", order), "n_units": F.sum("n_units")}
    return {n: c for n, c in (first | rest).items() if n in rows.columns}


def merge_short(segments: DataFrame, order: str = "seg_no") -> DataFrame:
    """Segments under 10 words joined to the one before, if the last of 10 or more words before has over 30."""
    n = F.size(T.words_of(F.col("text")))
    rows = segments.withColumn("n", n)
    before = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    big = F.last(F.when(F.col("n") >= 10, F.col("n")), ignorenulls=True).over(before)
    rows = rows.withColumn("starts", ~((F.col("n") < 10) & (F.coalesce(big, F.lit(0)) > 30)))
    return islands(rows, F.col("starts"), order, **carried(segments, order))


def at_risk(segments: DataFrame, order: str = "seg_no", names: Callable[[Column], Column] | None = None) -> DataFrame:
    """``segments`` with at_risk: not the first, refers back (pronoun, article or retrospective opening), and nothing to refer to before.

    ``names`` tells whether a text, the first 200 characters of the segment before, names something; without it none does.
    """
    back = T.has_word(F.col("text"), T.ANAPHORA) | T.starts_looking_back(F.col("text"))
    prev = F.lag("text").over(_in(order))
    if names is None:  # then no text need travel to the next row
        return segments.withColumn("_back", back).withColumn("at_risk", F.coalesce(F.lag(F.col("text").isNotNull()).over(_in(order)), F.lit(False)) & F.col("_back")).drop("_back")
    known = F.coalesce(names(F.substring(prev, 1, 200)), F.lit(False))
    return segments.withColumn("_prev", prev).withColumn("_known", known).withColumn("at_risk", F.col("_prev").isNotNull() & back & ~F.col("_known")).drop("_prev", "_known")


def merge_anaphoric(segments: DataFrame, order: str = "seg_no", names: Callable[[Column], Column] | None = None) -> DataFrame:
    """Segments at risk of losing what they refer to (see `at_risk`) joined to the one before; depth is the largest."""
    rows = at_risk(segments, order, names).withColumn("starts", ~F.col("at_risk")).drop("at_risk")
    return islands(rows, F.col("starts"), order, **carried(segments, order))


def heading_segments(blocks: DataFrame) -> DataFrame:
    """(doc_id, seg_no, text, depth, heading, page): sections with full headings, those that refer back joined."""
    s = section_texts(blocks, cut=None).select("doc_id", F.col("section").alias("seg_no"), "text", "depth", "heading", "page")
    return merge_anaphoric(s)


def orphan_merge(texts: DataFrame) -> DataFrame:
    """(doc_id, text): lines of one to three letters joined to the line before, unless that is empty; a final hyphen goes."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    orphan = T.strip(F.col("text")).rlike("^[A-Za-zÀ-ÿ]{1,3}$")
    prev = F.lag("text").over(_in("i"))
    lines = lines.withColumn("starts", ~orphan | prev.isNull() | (prev == "")).withColumn("t", F.when(~F.col("starts"), T.strip(F.col("text"))).otherwise(F.col("text")))
    lines = lines.withColumn("g", F.sum(F.col("starts").cast("int")).over(_upto("i")))
    held = lines.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("p"))
    joined = F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1)["t"], lambda a, x: F.when(a.endswith("-"), F.concat(F.regexp_replace(a, "-+$", ""), x["t"])).otherwise(F.concat(F.regexp_replace(a, r"\s+$", ""), F.lit(" "), x["t"])))
    return held.select("doc_id", "g", joined.alias("line")).groupBy("doc_id").agg(ordered_text("g", "line", "\n").alias("text"))


def char_budget(rows: DataFrame, order: str, cap: int, least: int, cut: int, budget: int) -> DataFrame:
    """The first ``cap`` rows of a document, those under ``least`` characters skipped, cut to ``cut``, until ``budget`` is spent."""
    r = rows.withColumn("k", F.row_number().over(_in(order))).where((F.col("k") <= cap) & (F.length("text") >= least)).withColumn("text", F.substring("text", 1, cut))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    r = r.withColumn("spent", before)
    stop = F.min(F.when(F.col("spent") > budget, F.col("k"))).over(Window.partitionBy("doc_id"))
    return r.withColumn("stop", stop).where("stop is null or k < stop").drop("k", "spent", "stop")


def wasserstein_cost(x: np.ndarray, n: int, least: int = 3) -> float:
    """Distance between the row-norm distributions of a window's halves, scaled by the window's share of the whole."""
    if len(x) < 2 * least:
        return 0.0
    mid = len(x) // 2
    halves = []
    for part in (x[:mid], x[mid:]):
        mass = np.linalg.norm(part, axis=1)
        mass = np.maximum(mass / (mass.sum() + 1e-10), 1e-10)
        halves.append((np.arange(len(part)) / len(part), mass / mass.sum()))
    at = np.unique(np.concatenate([h[0] for h in halves]))
    cdf = [np.append(0.0, np.cumsum(w))[np.searchsorted(p, at, "right")] for p, w in halves]
    return float((np.abs(cdf[0] - cdf[1])[:-1] * np.diff(at)).sum() * (1 + 10 * len(x) / max(n, 1)))


def wasserstein_costs(rows: DataFrame, order: str, features: list[str]) -> DataFrame:
    """(doc_id, cost): `wasserstein_cost` of the rows of each document (doc_id, order, features) as one window.

    Rows are hashed by document and sorted, and a task holds one document's rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, costs = [], []
        for doc in by_document(batches):
            x = np.column_stack([doc[f].to_numpy() for f in features]).astype(float)
            ids.append(doc["doc_id"][0].as_py())
            costs.append(wasserstein_cost(x, len(x)))
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, doc["doc_id"].type), pa.array(costs, pa.float64())], names=["doc_id", "cost"])
                ids, costs = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, doc["doc_id"].type), pa.array(costs, pa.float64())], names=["doc_id", "cost"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.select("doc_id", order, *features).repartition("doc_id").sortWithinPartitions("doc_id", order)
    return held.mapInArrow(run, f"doc_id {kind}, cost double")


def pelt(x: np.ndarray, penalty: float, least: int = 5) -> list[int]:
    """Ends of the segments of ``x`` with the least squared deviation plus ``penalty`` a segment, each of ``least`` rows or more."""
    n = len(x)
    total = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    square = np.append(0.0, np.cumsum((x * x).sum(axis=1)))
    best, back, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        starts = np.array([s for s in open_ if t - s >= least and best[s] < np.inf])
        if not len(starts):
            continue
        mean = total[t] - total[starts]
        cost = best[starts] + square[t] - square[starts] - (mean * mean).sum(axis=1) / (t - starts) + penalty
        best[t], back[t] = cost.min(), starts[cost.argmin()]
        gone = set(starts[cost - penalty > best[t]].tolist())
        open_ = [s for s in open_ if s not in gone] + [t]
    ends, t = [], n
    while t > 0 and best[t] < np.inf:
        ends.append(t)
        t = back[t]
    return sorted(ends)


def search(x: np.ndarray, penalty: float, least: int, cost) -> list[int]:
    """As `pelt`, for a cost of windows of ``x`` in place of the squared deviation: cost(window, number of all rows)."""
    n = len(x)
    best, back, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        starts = [s for s in open_ if t - s >= least and best[s] < np.inf]
        if not starts:
            continue
        total = [best[s] + cost(x[s:t], n) + penalty for s in starts]
        k = int(np.argmin(total))
        best[t], back[t] = total[k], starts[k]
        gone = {s for s, c in zip(starts, total, strict=True) if c - penalty > best[t]}
        open_ = [s for s in open_ if s not in gone] + [t]
    ends, t = [], n
    while t > 0 and best[t] < np.inf:
        ends.append(t)
        t = back[t]
    return sorted(ends)


#: Costs of a window that change points can be searched with, by name; None is the squared deviation in closed form.
COSTS = {"l2": None, "wasserstein": wasserstein_cost}


def cut_units(x: np.ndarray, max_segments: int, cost=None, penalty: float | None = None) -> list[int]:
    """0, the change points and the number of rows of ``x``: searched again at twice the penalty if there are too many, at 0.3 of it if under three."""
    n = len(x)
    if n < 5:
        return [0, n]
    find = (lambda p: pelt(x, p)) if cost is None else (lambda p: search(x, p, 5, cost))
    ends = find(penalty or n * 0.02)
    if len(ends) > max_segments:
        ends = find((penalty or n * 0.02) * 2)
    elif len(ends) < 3 and penalty is None:
        ends = find(n * 0.02 * 0.3)
    return sorted({0, n, *ends})


def confidence(x: np.ndarray, cuts: list[int], i: int) -> float:
    """1 for the first and last segment, else 1 / (1 + mean variance of the segment's features) within 0.1 and 1."""
    if i == 0 or i >= len(cuts) - 2:
        return 1.0
    part = x[cuts[i] : cuts[i + 1]]
    return float(min(1.0, max(0.1, 1 / (1 + part.var(axis=0).mean())))) if len(part) >= 2 else 0.8


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each document of batches sorted by doc_id; null is a document too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch["doc_id"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut = (np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, len(ids)], strict=True):
            if lo == hi:
                continue
            if held and held[-1]["doc_id"][0].as_py() != batch["doc_id"][lo].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def change_points(units: DataFrame, max_segments: int = 100, cost: str | Callable = "l2", penalty: float | None = None, least_units: int = 1) -> DataFrame:
    """(doc_id, seg_no, text, n_units, confidence, start_char, end_char): runs of units (doc_id, unit_no, text, features) between changes of their features.

    ``cost`` is a name in COSTS or a function of a window's features and the number of all rows. Documents under
    ``least_units`` units are left out. Offsets count the segments' own characters, end to end. Documents are hashed to tasks
    and sorted, and a task holds one document's units at a time.
    """
    score = COSTS[cost] if isinstance(cost, str) else cost
    names = ["doc_id", "seg_no", "text", "n_units", "confidence", "start_char", "end_char"]
    types = [to_arrow_type(units.schema["doc_id"].dataType), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for doc in by_document(batches):
            if doc.num_rows < least_units:
                continue
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in doc["features"].chunks]).reshape(doc.num_rows, -1).astype(float)
            text, cuts = doc["text"].to_pylist(), cut_units(x, max_segments, score, penalty)
            doc_id, end = doc["doc_id"][0].as_py(), 0
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = " ".join(text[lo:hi])
                held.append((doc_id, i, part, hi - lo, confidence(x, cuts, i), end, end + len(part)))
                end += len(part)
            if len(held) >= 1000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    # A number of partitions keeps Spark from joining small ones, as the search takes more time than its bytes tell.
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.select("doc_id", "unit_no", "text", "features").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "unit_no")
    kinds = (units.schema["doc_id"].dataType.simpleString(), "int", "string", "int", "double", "long", "long")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


BUCKETS = 68


def units_of(texts: DataFrame) -> DataFrame:
    """(doc_id, unit_no, text): the stripped lines of ``texts`` that start with ``#`` or have over 20 characters."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_no", "text")).withColumn("text", T.strip(F.col("text")))
    return rows.where(F.col("text").startswith("#") | (F.length("text") > 20))


def word_bucket(word: Column) -> Column:
    """A word's bucket of 68, by a hash that is the same everywhere."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % BUCKETS


def unit_ratios(t: Column) -> list[Column]:
    """Ten features of a unit: length, words, legal words, digits, marks, legal opening, words again, punctuation, number."""
    words = T.words_of(t)
    share = lambda p: F.length(F.regexp_replace(t, p, "")) / F.greatest(F.length(t), F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    opens = F.lower(t).rlike("^(" + "|".join(x.replace(".", r"\.") for x in T.LEGAL_OPENINGS) + ")")
    return [
        F.length(t) / 500, F.size(words) / 100, T.legal_ratio(t), share("[^0-9]"), flag(t.startswith("#")), flag(t.rlike("^(##|# )")), flag(opens),
        F.least(F.greatest(F.size(words), F.lit(1)), F.lit(100)) / 100, share("[^.,;:!?]"), flag(t.rlike(r"^[0-9.]+\s")),
    ]


def unit_features(units: DataFrame) -> DataFrame:
    """``units`` with ``features``: the ten of `unit_ratios`, two zeros, and how often each bucket of words occurs in the first 25 words.

    The words' buckets are one string with a character a word, made once a unit, in which each bucket's character is counted.
    """
    said = F.array_join(F.transform(F.slice(T.words_of(F.col("text")), 1, 25), lambda w: F.char(word_bucket(w) + 48)), "")
    count = lambda t, b: (F.length(t) - F.length(F.replace(t, F.lit(chr(48 + b)), F.lit("")))).cast("double")
    counts = F.element_at(F.transform(F.array(said), lambda t: F.array(*(count(t, b) for b in range(BUCKETS)))), 1)
    return units.withColumn("features", F.concat(F.array(*unit_ratios(F.col("text")), F.lit(0.0), F.lit(0.0)), counts))


def with_depth(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """``segments`` (doc_id, seg_no, text) with depth: the level of the first heading block within the first line, else by its mark or number."""
    first = F.substring_index("text", "\n", 1)
    heads = blocks.where("is_heading").select("doc_id", "block_no", T.strip(F.col("text")).alias("_t"), F.coalesce("heading_level", F.lit(1)).alias("_level"))
    # A document's headings come to its segments as one array, so that segments are made once; of equal ones the first counts.
    heads = heads.where("_t is not null").groupBy("doc_id", "_t").agg(F.min(F.struct("block_no", "_level")).alias("_h"))
    heads = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_h.block_no").alias("at"), F.col("_t").alias("said"), F.col("_h._level").alias("level")))).alias("_heads"))
    level = F.get(F.filter("_heads", lambda h: first.contains(h["said"])), F.lit(0))["level"]
    x = F.col("text")
    marked = F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    rule = F.when(marked > 0, marked).when(F.upper(x).rlike(r"^(CAPÍTULO|TÍTULO|LIVRO|PARTE|SEÇÃO)\s"), 1).when(x.rlike(r"^[0-9]+\.[0-9]+\.\s"), 2).when(x.rlike(r"^[0-9]+\.\s"), 1)
    rule = rule.when(F.substring(x, 1, 60).rlike(r"^[A-Z][a-zá-ú]+(\s[A-Z][a-zá-ú]+){0,3}$"), 1).otherwise(0)
    return segments.join(heads, "doc_id", "left").withColumn("depth", F.coalesce(level, rule).cast("int")).drop("_heads")


SEGMENT = ["doc_id", "seg_no", "text", "depth", "heading", "page", "start_char", "end_char", "confidence", "n_units", "method"]


def change_point_segments(texts: DataFrame, blocks: DataFrame, max_segments: int = 100, cost: str | Callable = "l2", sentences: DataFrame | None = None) -> DataFrame:
    """The columns of SEGMENT for texts (doc_id, text) with five units or more.

    Segments that begin at an unsafe break of ``sentences`` (see `safe_breaks`; without them every break is safe) are joined
    to the one before, then those that refer back; a joined segment keeps its first part's start and confidence.
    """
    s = change_points(unit_features(units_of(texts)), max_segments, cost, least_units=5)
    name = "bcpd_pelt" if cost == "l2" else f"bcpd_pelt_{cost if isinstance(cost, str) else 'custom'}"
    s = with_depth(s.where(T.strip(F.col("text")) != ""), blocks).withColumn("heading", T.heading_guess(F.col("text")))
    s = s.withColumns({"page": F.lit(0), "method": F.lit(name)}).select(*SEGMENT)
    return merge_anaphoric(s if sentences is None else merge_unsafe(s, sentences)).select(*SEGMENT)


def safe_breaks(proposed: DataFrame, sentences: DataFrame, window: int = 200, near: int = 5) -> DataFrame:
    """(doc_id, at, safe, moved) of the ``proposed`` breaks (doc_id, at), with ``sentences`` (doc_id, start, text, tree) parsed.

    A break strictly inside a sentence is unsafe if it lies under ``near`` characters from one of the sentence's own breaks
    (see `break_positions` on its printed ``tree``); ``moved`` is that sentence's next break after it, or its end. Elsewhere
    a break is safe and stays. A null tree parses to nothing: breaks in it are safe and stay. Sentences may come as
    (doc_id, start, size, breaks) instead, with ``breaks`` as `tree_breaks` gives them.

    Sentences are cut at their breaks, and the pieces are indexed by the stretches of ``window`` characters that they touch:
    a break meets only the pieces of its own stretch, and a piece tells all there is to know about it, however long the
    sentence. Breaks and pieces are shuffled once each, by document and stretch.
    """
    from .analysis import tree_breaks

    if "breaks" not in sentences.columns:
        size = F.length("text")
        sentences = sentences.where("tree is not null").select("doc_id", "start", size.alias("size"), tree_breaks(F.col("tree"), size).alias("breaks"))
    held = sentences.where("size > 0").select("doc_id", F.col("start").cast("long").alias("start"), "size", "breaks")
    held = held.select("doc_id", "start", "breaks", F.posexplode(F.concat("breaks", F.array("size"))).alias("k", "to"))
    before = F.get("breaks", F.col("k") - 1)
    # A piece goes from a break, or from behind the sentence's beginning, up to before the next break or the end.
    pieces = held.select(
        "doc_id", (F.col("start") + F.coalesce(before, F.lit(1))).alias("lo"), (F.col("start") + F.col("to")).alias("hi"),
        (F.col("k") > 0).alias("opens"), (F.col("k") < F.size("breaks")).alias("closes"),
    ).where("lo < hi")
    stretch = lambda c: F.floor(c / window)
    index = pieces.withColumn("stretch", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("hi") - 1))))
    asked = proposed.select("doc_id", F.col("at").cast("long").alias("at")).withColumn("stretch", stretch(F.col("at")))
    keys = ["doc_id", "stretch", "at", "n"]  # equal breaks are judged once; dealt by stretch, their rows stay where they are
    asked = asked.repartition("doc_id", "stretch").groupBy(*keys[:3]).agg(F.count("*").alias("n"))
    close = (F.col("opens") & (F.col("at") - F.col("lo") < near)) | (F.col("closes") & (F.col("hi") - F.col("at") < near))
    met = asked.join(index.withColumnsRenamed({"doc_id": "_doc", "stretch": "_stretch"}), F.expr("doc_id = _doc and stretch = _stretch and lo <= at and at < hi"), "left")
    out = met.groupBy(*keys).agg(F.bool_or(close).alias("_unsafe"), F.min("hi").alias("_moved"))
    out = out.select("doc_id", "at", (~F.coalesce("_unsafe", F.lit(False))).alias("safe"), F.coalesce("_moved", "at").alias("moved"), "n")
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def merge_unsafe(segments: DataFrame, sentences: DataFrame, order: str = "seg_no") -> DataFrame:
    """``segments`` (with start_char) without those whose beginning is an unsafe break, which are joined to the one before."""
    judged = safe_breaks(segments.select("doc_id", F.col("start_char").alias("at")).distinct(), sentences)
    rows = segments.join(judged.select("doc_id", F.col("at").alias("start_char"), "safe"), ["doc_id", "start_char"])
    return islands(rows, F.col("safe"), order, **carried(segments, order))


def hybrid_segments(texts: DataFrame, blocks: DataFrame, max_segments: int = 100, cost: str | Callable = "l2") -> DataFrame:
    """(doc_id, seg_no, text, depth, heading, page, confidence, method): segments by headings, for documents without any by change points; short ones merged."""
    by_heading = heading_segments(blocks).withColumn("seg_no", F.col("seg_no").cast("long"))
    rest = texts.join(section_texts(blocks, cut=None).select("doc_id").distinct(), "doc_id", "left_anti")  # joining segments loses no document
    by_change = change_point_segments(rest, blocks, max_segments, cost).withColumn("seg_no", F.col("seg_no").cast("long"))
    shared = ["doc_id", "seg_no", "text", "depth", "heading", "page", "confidence", "method"]
    sure = by_heading.withColumns({"confidence": F.lit(1.0), "method": F.lit("heading")})
    return merge_short(sure).select(*shared).unionByName(merge_short(by_change.withColumn("method", F.lit("change_point"))).select(*shared))
