"""Exact n-gram Jaccard join with set-relation skipping.

After Wang et al., "Leveraging Set Relations in Exact Set Similarity Join" (VLDB 2017). Two relations are used:

* Answer level: sets with equal contents are one class; a class that a verified link ties to a leader takes over the
  leader's component, and pairs inside one component are derived, never compared again.
* Index level: prefixes go into inverted lists ordered by bands of sizes and then by position; lists are skipped whole when
  they lie within one component, and blocks of a list are skipped by size and by position when no pair across them can
  reach the threshold.
  Pairs left are tested on parity bitmaps (Sandes et al., "Bitmap filter", 2017): sets differ in at least as many
  tokens as their bitmaps in bits, so no pair that reaches the threshold is lost.

Prefix order: first tokens that no other component's index holds, then tokens by rising document frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import rows_of
from .graph import connected_components
from .neardup_vectors import _groups
from .scratch import materialize, small
from .shingles import Shingler, mix, overlap

#: Share of the hash space whose tokens are indexed by frequency; larger ones only fill prefixes up, in hash order.
REGION = 0.30
CUT = int(REGION * 2**63)
PERMUTATIONS = 8
BITS = 512


def prefix_length(n: np.ndarray | int, percent: int):
    """Sets that reach the threshold share one of the first so many tokens."""
    return n + (-n * percent) // 100 + 1


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of sizes n and m with 100 * intersection >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


PROFILE = "doc_id long, n long, d1 long, d2 long, mins array<long>, bits array<long>, load array<long>"


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Size, content digests, minimum hashes and parity bitmap of each document's set, and one row a task with its token loads.

    In a row of loads, which alone has ``load``, that tells how many tokens of all `region` s fall to each of 2**16 buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, load = Shingler(width), np.zeros(1 << 16, np.int64)
        odd = [np.uint64(x) for x in np.random.default_rng(9).integers(1, 2**62, PERMUTATIONS) * 2 + 1]
        schema = pa.schema([(c, pa.list_(pa.int64()) if c in ("mins", "bits", "load") else pa.int64()) for c in (f.split()[0] for f in PROFILE.split(", "))])
        for batch in batches:
            n, d1, d2, mins, bits = [], [], [], [], []
            for text in rows_of(batch, "text"):
                s = cut.shingles(text)
                n.append(len(s))
                d1.append(int(s.sum().view(np.int64)) if len(s) else 0)
                d2.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                mins.append([int((s * m).min() >> np.uint64(1)) for m in odd] if len(s) else [])
                odds = np.bincount((s >> np.uint64(20) & np.uint64(BITS - 1)).view(np.int64), minlength=BITS) & 1
                bits.append(np.packbits(odds.astype(np.uint8)).view(np.int64))
                np.add.at(load, region(s, percent)[0] & 0xFFFF, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, schema.field(c).type) for c, x in (("n", n), ("d1", d1), ("d2", d2), ("mins", mins), ("bits", bits))), pa.nulls(len(n), schema.field("load").type)], schema=schema)
        yield pa.RecordBatch.from_pylist([{"load": load.tolist()}], schema=schema)

    return docs.mapInArrow(run, PROFILE)


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, fan: int = 500) -> DataFrame:
    """The distinct pairs (a, b) of document ids whose sets reach the threshold. Only texts that occur in a pair are read again.

    Of a pair's two documents the one in more pairs is its hub. A hub's set goes once to every ``fan`` or so of its partners,
    who meet it in one task, so a document in very many pairs is neither copied for each nor gathered in one place.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held = [cut.shingles(t).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(held, pa.binary())], names=["doc_id", "held"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets_of_hub = None, []
        for batch in batches:
            a, b = [], []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for hub, lane, doc, held in zip(*(part[c].to_pylist() for c in ("hub", "lane", "doc_id", "held")), strict=True):
                    y = np.frombuffer(held, np.uint64)
                    if at != (hub, lane):
                        at, sets_of_hub = (hub, lane), []
                    if doc == hub:
                        sets_of_hub.append(y)
                    elif any(100 * (both := overlap(x, y)) >= percent * (len(x) + len(y) - both) for x in sets_of_hub):
                        a.append(min(hub, doc))
                        b.append(max(hub, doc))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = materialize(pairs.select("a", "b").distinct(), "asked")
    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("k")), "degrees")
    held = materialize(docs.join(small(degree.select("doc_id")), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, held binary"), "sets")
    of = lambda c: degree.select(F.col("doc_id").alias(c), F.col("k").alias(f"k{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    first = (F.col("ka") > F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    rows = rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc_id"), F.greatest("ka", "kb").alias("k"))
    rows = rows.select("hub", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("k") / fan)).cast("int").alias("lane"), "doc_id")
    rows = rows.unionByName(rows.select("hub", "lane", F.col("hub").alias("doc_id")).distinct()).join(held, "doc_id")
    rows = rows.withColumn("mine", F.col("doc_id") != F.col("hub")).repartition("hub", "lane").sortWithinPartitions("hub", "lane", "mine")
    return rows.select("hub", "lane", "doc_id", "held").mapInArrow(test, "a long, b long")


def region(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """A set's tokens below CUT, and the next ones in hash order if those are fewer than its prefix; its size; the tokens below CUT."""
    t = (shingles >> np.uint64(1)).view(np.int64)
    low = int(np.searchsorted(t, CUT))
    return (t[: max(low, prefix_length(len(t), percent))] if len(t) else t), len(t), low


def hot_tokens(docs: DataFrame, loads: DataFrame, width: int, percent: int, limit: int) -> DataFrame | None:
    """(t, df, lo, hi) of the tokens in over ``limit`` sets of ``docs``, with the least and largest component; None without any.

    The limit is four mean buckets at least, so it grows as a task's share does. Only tokens of the buckets whose loads (see
    `profiles`) add up to more are counted one by one, so there are at most one in ``limit`` index rows.
    """
    buckets = loads.where("load is not null").select(F.posexplode("load").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = materialize(buckets, "loads")
    limit = max(limit, int(4 * (buckets.agg(F.avg("n")).first()[0] or 0)))
    buckets = materialize(buckets.where(F.col("n") > limit).select("bucket"), "hot-buckets")
    if buckets.isEmpty():
        return None
    rows = index(docs, width, percent).withColumn("bucket", F.col("t").bitwiseAND(F.lit(0xFFFF)).cast("int")).join(F.broadcast(buckets), "bucket", "left_semi")
    exact = rows.groupBy("t").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return materialize(exact.where(F.col("df") > limit), "hot-tokens")


def index(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(t, node, comp, n, r): a row for each token of a class's `region`; r of the n tokens lie below CUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            node, comp = batch["doc_id"].to_numpy(), batch["comp"].to_numpy()
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens, sizes, low = [], [], []
                for text in part["text"].to_pylist():
                    t, n, r = region(cut.shingles(text), percent)
                    tokens.append(t)
                    sizes.append(n)
                    low.append(r)
                count = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), *(pa.array(np.repeat(np.asarray(x), count)) for x in (node[lo : lo + 256], comp[lo : lo + 256])), *(pa.array(np.repeat(np.array(x, np.int32), count)) for x in (sizes, low))],
                    names=["t", "node", "comp", "n", "r"],
                )

    return docs.mapInArrow(run, "t long, node long, comp long, n int, r int")


def block_pairs(n: np.ndarray, pos: np.ndarray, percent: int, block: int) -> Iterator[tuple[int, int]]:
    """Starts of the blocks of a list, pair by pair and each with itself, that sizes and positions do not rule out.

    Between sets whose sizes differ by more than the threshold no pair links. A common token at place p of one set and q of
    the other leaves them at most the larger size less the places between in common; pos is -1 where unknown.
    """
    starts = np.arange(0, len(n), block)
    least, most = (f.reduceat(n, starts) for f in (np.minimum, np.maximum))
    low, high = (f.reduceat(pos, starts) for f in (np.minimum, np.maximum))
    for i in range(len(starts)):
        rest = slice(i, None)
        keep = (100 * most[i] >= percent * least[rest]) & (100 * most[rest] >= percent * least[i])
        gap = np.maximum(low[rest] - high[i], low[i] - high[rest])
        apart = gap > np.maximum(most[rest], most[i]) - needed(least[rest], least[i], percent)
        keep &= ~(apart & (low[rest] >= 0) & (low[i] >= 0))
        for j in np.flatnonzero(keep):
            yield int(starts[i]), int(starts[i + j])


def _candidates(percent: int, block: int = 128, flush: int = 1_000_000):
    """Pairs across components from lists (t, node, comp, n, pos, bits) sorted by token, band of sizes and position, with their number of common prefix tokens.

    A long list comes as tiles: one for each chunk of it, and one for each two chunks, in which only pairs across them count.
    ``pos`` is -1 where unknown. A list is cut into blocks; a pair of blocks is skipped when its sizes or its positions
    rule every pair out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def emit() -> pa.RecordBatch:
            a, b, ca, cb, need = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((b, a))
            a, b, ca, cb, need = (x[order] for x in (a, b, ca, cb, need))
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            count = np.diff(np.append(first, len(a)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], ca[first], cb[first], need[first], count)], names=["a", "b", "ca", "cb", "need", "c"])

        for group in _groups(batches, ["tile", "t"]):
            node, comp, n, pos, chunk = (group[c].to_numpy().astype(np.int64) for c in ("node", "comp", "n", "pos", "chunk"))
            cross = bool(group["cross"][0].as_py())
            if len(node) < 2 or (comp == comp[0]).all():
                continue
            bits = group["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            for lo, at in block_pairs(n, pos, percent, block):
                x, y = np.nonzero(comp[lo : lo + block, None] != comp[None, at : at + block])
                x, y = x + lo, y + at
                keep = (x < y) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                if cross:
                    keep &= chunk[x] != chunk[y]
                x, y = x[keep], y[keep]
                need = needed(n[x], n[y], percent)
                most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
                keep = (most >= need) | (pos[x] < 0) | (pos[y] < 0)
                x, y, need = x[keep], y[keep], need[keep]
                keep = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * need
                x, y, need = x[keep], y[keep], need[keep]
                rest = np.maximum(n[x] - prefix_length(n[x], percent), n[y] - prefix_length(n[y], percent))
                swap = node[x] > node[y]
                a, b = np.where(swap, y, x), np.where(swap, x, y)
                held.append((node[a], node[b], comp[a], comp[b], need - rest))
                n_held += len(a)
                if n_held >= flush:
                    yield emit()
                    held, n_held = [], 0
        if n_held:
            yield emit()

    return run


def components(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", tile: int = 2_000, hot: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``df``.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the smallest
    doc_id reachable by links. Null, empty and wordless texts have an empty set and link with nothing. Rows that repeat a
    doc_id share its links; a null doc_id takes its class's component, and null if it has none. Other columns are ignored.
    Copies are never expanded into pairs, and no list of documents comes to the driver. Lists of over ``tile`` documents are
    dealt as pairs of chunks, so a task holds two chunks at most; tokens in over ``hot`` sets are counted apart from the
    others, so that no task gets a whole such list.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = materialize(profiles(docs, width, percent), "profiles")
    info = told.where("load is null").drop("load")
    cls = info.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("mins").alias("mins"), F.first("bits").alias("bits"))
    cls = materialize(cls.where("node is not null"), "classes")

    # Answer level: near copies meet under common minima and are compared with the most central of each meeting only, the
    # one whose minima most others share.
    meet = cls.select("node", "n", F.posexplode("mins").alias("j", "low"))
    size = meet.groupBy("j", "low").agg(F.count("*").alias("k")).where("k > 1")
    meet = materialize(meet.join(size, ["j", "low"]), "meetings")
    central = meet.groupBy("node").agg(F.sum("k").alias("score"))
    meet = meet.join(central, "node")
    lead = meet.groupBy("j", "low").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "n")).alias("lead"))
    lead = lead.select("j", "low", (-F.col("lead.minus")).alias("lead"), F.col("lead.n").alias("m"))
    stars = meet.join(lead, ["j", "low"]).where("lead <> node and 100 * least(n, m) >= %d * greatest(n, m)" % percent)
    stars = materialize(stars.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), "stars")
    links = materialize(verify(stars, docs, width, percent), "star-links")
    comps = materialize(connected_components(links), "star-components")

    # Index level: only one document of each class is indexed, under its component so far.
    marks = info.where("doc_id is not null and n > 0").join(cls.where("copies > 1").select("n", "d1", "d2", "node"), ["n", "d1", "d2"])
    marks = marks.where("doc_id <> node").select("doc_id", F.lit(None).cast("long").alias("known"), F.lit(True).alias("copy"))
    marks = marks.unionByName(comps.select(F.col("node").alias("doc_id"), F.col("component").alias("known"), F.lit(False).alias("copy")))
    marks = materialize(marks.groupBy("doc_id").agg(F.max("known").alias("known"), F.min("copy").alias("copy")), "marks")
    once = docs.where("doc_id is not null").join(small(marks), "doc_id", "left").where("copy is null or not copy")
    once = once.select("doc_id", "text", F.coalesce("known", "doc_id").alias("comp"))
    often = hot_tokens(once, told, width, percent, hot)
    by_token = Window.partitionBy("t")
    every = index(once, width, percent)
    shared = every if often is None else every.join(F.broadcast(often.select("t")), "t", "left_anti")
    shared = shared.withColumn("df", F.count("*").over(by_token)).withColumn("lo", F.min("comp").over(by_token)).withColumn("hi", F.max("comp").over(by_token))
    if often is not None:
        shared = shared.unionByName(every.join(F.broadcast(often), "t"))
    shared = materialize(shared.where("lo <> hi").drop("lo", "hi"), "shared")
    in_region = F.col("t") < CUT
    order = Window.partitionBy("node", in_region).orderBy("df", "t")
    placed = shared.withColumn("rank", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy("node", in_region)))
    pos = F.when(in_region, F.col("r") - F.col("of") + F.col("rank") - 1).otherwise(-1).cast("int")
    placed = placed.withColumn("pos", pos).where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    lists = placed.select("t", "node", "comp", "n", "pos", F.ceil(F.col("df") / tile).cast("int").alias("k")).join(cls.select("node", "bits"), "node")
    lists = lists.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lists = lists.withColumn("tile", F.xxhash64("t", F.least("chunk", "other"), F.greatest("chunk", "other"))).withColumn("cross", F.col("chunk") != F.col("other"))
    # Within a narrow band of sizes positions rise, so that blocks far apart are skipped.
    lists = lists.withColumn("band", F.floor(F.log("n") / float(np.log(1.05))))
    lists = lists.drop("k", "other").repartition("tile").sortWithinPartitions("tile", "t", "band", "pos", "node")
    pairs = lists.mapInArrow(_candidates(percent), "a long, b long, ca long, cb long, need long, c long")
    pairs = pairs.groupBy("a", "b", "ca", "cb").agg(F.max("need").alias("need"), F.sum("c").alias("c")).where("c >= need")
    pairs = materialize(pairs, "pairs")

    # Of pairs that would join the same two components, the most promising goes first; what it settles is derived.
    best = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.col("need") - F.col("c"), "a", "b")
    first = materialize(pairs.withColumn("i", F.row_number().over(best)).where("i = 1").select("a", "b"), "first-pairs")
    links = materialize(links.unionByName(verify(first, docs, width, percent)), "links")
    comps = materialize(connected_components(links), "components")
    of = lambda c, name: comps.select(F.col("node").alias(c), F.col("component").alias(name))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    rest = materialize(rest.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"), "rest-pairs")
    if rest.limit(1).count():
        comps = connected_components(links.unionByName(verify(rest, docs, width, percent)))

    cls = cls.join(comps, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    out = info.drop("mins", "bits").join(cls, ["n", "d1", "d2"], "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose doc_id is their component's smallest, columns unchanged; see `components`.

    Rows that repeat a doc_id stay together, rows with a null doc_id all stay. Only ids to drop are joined back.
    """
    found = components(df, width, percent, key, text)
    gone = materialize(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "dropped")
    return df.join(small(gone), key, "left_anti").select(df.columns)
