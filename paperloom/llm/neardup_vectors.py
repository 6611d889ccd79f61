"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. After a random rotation the coordinates are split into
low-dimensional blocks; a pair that close is, in at least one block, within that block's share of the budget. Each block
is joined by range on its coordinates alone, and only the vectors that have a partner there are fetched, once for the
exact verification of the union of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import materialize, small
from .vectors import components_of, matrix, rotate, rotation, usable

WIDTH = 8
#: Coordinates of unit vectors are rounded to this many steps, so that four fit into a long.
SCALE = 32_000
BLOCK_SCHEMA = "node long, cell long, tag long, a long, b long, reach int"
FOUND_SCHEMA = "tile long, node long, tag long"
LOCAL = (1, 2, 3, 4)  # the block coordinates of the grid inside a task; the first is the shuffled grid's
SWEEP = 5


class Plan:
    """Blocks and their reach, in rounded steps, for vectors of one dimension."""

    def __init__(self, dim: int, threshold: float, seed: int = 11):
        self.dim, self.q = dim, rotation(dim, seed)
        self.starts = np.arange(0, dim, WIDTH)
        share = np.diff(np.append(self.starts, dim)) / dim
        budget = (2 - 2 * threshold) * share * (1 + 1e-6) + 1e-12
        # Rounding moves a coordinate's difference by one step at most, and so a block's distance by sqrt(WIDTH).
        self.reach = np.ceil(np.sqrt(budget) * SCALE + np.sqrt(WIDTH)).astype(np.int64)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """The rounded rotated unit vectors of ``x`` as (row, block, coordinate); a last narrower block is filled up with 0."""
        y = x / np.abs(x).max(axis=1, keepdims=True)
        r = np.rint(rotate(y / np.sqrt((y * y).sum(axis=1, keepdims=True)), self.q) * SCALE).astype(np.int64)
        out = np.zeros((len(x), len(self.starts) * WIDTH), np.int64)
        out[:, : self.dim] = r
        return out.reshape(len(x), len(self.starts), WIDTH)


def classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Every row as (vec_id, label, embedding, ok, h1, h2): h1 and h2 name its class of equal vectors under its label."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), components_of(df, "embedding").alias("embedding"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    both = F.struct("label", "embedding")
    return rows.withColumn("ok", ok).withColumn("h1", F.xxhash64(both)).withColumn("h2", F.xxhash64(F.lit(1), both))


def link(df: DataFrame, threshold: float = 0.98, tile: int = 8000, label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null, their vectors have the same length, and their cosine in
    double precision is >= ``threshold``. A row whose label, vec_id or vector is null, or whose vector is zero or holds null or
    non-finite components, links with nothing and is its own component. Equal vectors are compared once, with their
    number as weight. Rows that repeat a vec_id share its links. Other columns are ignored; no rows give no rows. A grid
    cell of more than ``tile`` vectors is split along further coordinates, and one that stays larger is dealt out as pairs
    of chunks, so no task's tile holds more than two chunks.
    """
    rows = materialize(classes(df, label).drop("label", "embedding"), "vectors")
    reps = classes(df, label).where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = materialize(reps.withColumn("dim", F.size("embedding")), "classes")
    with_partner = tiles(reps, threshold, tile).repartition("tile").sortWithinPartitions("tile").mapInArrow(_find(threshold), FOUND_SCHEMA)
    with_partner = small(materialize(with_partner, "partners"))
    fetched = reps.select("node", "mult", "label", "dim", "embedding").join(with_partner, "node")
    found = fetched.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(_verify(threshold), "node long, links long, root long")
    found = materialize(found, "links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = reps.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(comps, "node", "left")
    nodes = nodes.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(nodes, ["h1", "h2"], "left")
    alone = ~F.col("ok")
    out = out.select("vec_id", F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def tiles(reps: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(tile, node, tag, a, b): every block of every vector in the tiles where it can meet a partner.

    Cells are cut along the block's first coordinate, and those over ``tile`` rows along the next ones, one at a time.
    ``tag`` holds the coordinates along which a row lies in the higher of its two cells, its side of a pair of chunks, the
    block and the dimension; see `untag`.
    """
    group = F.xxhash64("label", "dim")
    live = split(materialize(reps.select("node", group.alias("group"), "dim", "embedding").mapInArrow(_blocks(threshold), BLOCK_SCHEMA), "blocks"), 0)
    done = []
    for k in range(1, WIDTH):
        hot = materialize(live.groupBy("cell").count().where(F.col("count") > tile).select("cell"), "hot-cells")
        if hot.isEmpty():
            break
        done.append(live.join(small(hot), "cell", "left_anti"))
        live = split(live.join(small(hot), "cell", "left_semi"), k)
    else:
        n = live.groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / tile).cast("int").alias("n"))
        n = materialize(n, "chunks")
        done.append(live.join(small(n.select("cell")), "cell", "left_anti"))
        dealt = live.join(small(n), "cell").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).cast("long")
        live = dealt.withColumn("tag", F.col("tag").bitwiseOR(F.shiftleft(side, 8))).withColumn("cell", F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")))
    out = live.select("cell", "node", "tag", "a", "b")
    for more in done:
        out = out.unionByName(more.select("cell", "node", "tag", "a", "b"))
    return out.withColumnRenamed("cell", "tile")


def split(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` of `_blocks` in the cells, 2.5 reaches wide along coordinate ``k``, that half their reach touches: one or two."""
    x = F.shiftright(F.shiftleft(F.col("ab"[k // 4]), 48 - 16 * (k % 4)), 48)
    half, width = F.floor((F.col("reach") + 1) / 2), F.floor(F.col("reach") * 2.5)
    low, high = (F.floor((x + F.floor(width / 2) + h) / width) for h in (-half, half))
    both = rows.withColumn("_low", low).withColumn("_c", F.explode(F.sequence(F.col("_low"), high)))
    upper = F.when(F.col("_c") > F.col("_low"), F.lit(1 << k)).otherwise(0).cast("long")
    return both.withColumn("cell", F.xxhash64("cell", F.lit(k), "_c")).withColumn("tag", F.col("tag").bitwiseOR(upper)).drop("_low", "_c")


def _blocks(threshold: float):
    """The blocks of every vector: its first cell (label, dimension and block), its tag and its rounded coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, Plan] = {}
        for whole in batches:
            dims = whole["dim"].to_numpy()
            for dim in np.unique(dims):
                plan = plans.setdefault(int(dim), Plan(int(dim), threshold))
                part = whole.filter(pa.array(dims == dim))
                for lo in range(0, part.num_rows, 2048):
                    batch = part.slice(lo, 2048)
                    x = plan.blocks(matrix(batch["embedding"], int(dim)))
                    n, m = x.shape[:2]
                    packed = np.ascontiguousarray(x.astype("<i2")).view("<i8")
                    block = np.tile(np.arange(m, dtype=np.int64), n)
                    with np.errstate(over="ignore"):
                        cell = np.repeat(batch["group"].to_numpy(), m) ^ (block + 1) * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (np.repeat(batch["node"].to_numpy(), m), cell, block << 16 | int(dim) << 40, packed[:, :, 0].ravel(), packed[:, :, 1].ravel(), np.tile(plan.reach, n).astype(np.int32))],
                        names=["node", "cell", "tag", "a", "b", "reach"],
                    )

    return run


def untag(tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mask, side, block and dimension of tags."""
    return tag & 0xFF, tag >> 8 & 3, tag >> 16 & 0xFFFFFF, tag >> 40


def near_pairs(group: np.ndarray, x: np.ndarray, reach: np.ndarray, tag: np.ndarray, met: list[int] | None = None, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group within reach of each other on ``x`` (row, coordinate), each once, some at a time.

    Rows are dealt on a grid over four coordinates and swept along a fifth. Of the cells that both rows of a pair lie in,
    the lowest counts: there one of them is not in the upper of its two, along every coordinate of both grids.
    ``met`` takes the number of pairs looked at.
    """
    at, g, mask = np.arange(len(group)), group.astype(np.int64), np.zeros(len(group), np.int64)
    side = tag >> 8 & 3
    outer = tag & 0xFF
    half, width = (reach + 1) // 2, reach * 3 // 2 + 1
    for k in LOCAL:
        low, high = ((x[at, k] + width[at] // 2 + h) // width[at] for h in (-half[at], half[at]))
        two = np.flatnonzero(high > low)
        c = np.concatenate([low, high[two]])
        at, g, mask = (np.concatenate([v, v[two]]) for v in (at, g, mask))
        mask[len(low) :] |= 1 << k
        c -= c.min(initial=0)
        g = np.unique(g * (c.max(initial=0) + 1) + c, return_inverse=True)[1]
    order = np.lexsort((x[at, SWEEP], g))
    at, g, mask = at[order], g[order], mask[order]
    key = g * (1 << 18) + x[at, SWEEP]
    stop = np.searchsorted(key, key + reach[at], "right")
    count = np.maximum(stop - np.arange(len(at)) - 1, 0)
    total = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + step, "right")) - 1)
        p = np.repeat(np.arange(lo, hi), count[lo:hi])
        q = np.arange(len(p)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi]) + p + 1
        if met is not None:
            met.append(len(p))
        i, j = at[p], at[q]
        keep = (mask[p] & mask[q] == 0) & (np.abs(x[i, 0] - x[j, 0]) <= reach[i]) & (np.abs(x[i, 6] - x[j, 6]) <= reach[i])
        keep &= (outer[i] & outer[j] == 0) & ((side[i] != side[j]) | (side[i] == 0))
        i, j = i[keep], j[keep]
        d = x[i] - x[j]
        keep = (d * d).sum(axis=1) <= reach[i] ** 2
        yield i[keep], j[keep]
        lo = hi


def _held(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles put together until they hold ``rows`` rows, with a number for each row's tile."""
    held, n = [], 0

    def out() -> tuple[pa.Table, np.ndarray]:
        return pa.concat_tables(held).combine_chunks(), np.repeat(np.arange(len(held)), [t.num_rows for t in held])

    for group in _groups(batches, ["tile"]):
        if group.num_rows < 2:
            continue
        held.append(group)
        n += group.num_rows
        if n >= rows:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _find(threshold: float, met: list[int] | None = None):
    """The rows of sorted tiles that have a partner within their block's reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, Plan] = {}
        for table, group in _held(batches):
            tag = table["tag"].to_numpy()
            _, _, block, dim = untag(tag)
            reach = np.zeros(len(tag), np.int64)
            for d in np.unique(dim).tolist():
                plan = plans.setdefault(d, Plan(d, threshold))
                reach[dim == d] = plan.reach[block[dim == d]]
            x = np.stack([table[c].to_numpy() for c in "ab"], axis=1).view("<i2").astype(np.int64)
            hit = np.zeros(len(tag), bool)
            for i, j in near_pairs(group, x, reach, tag, met):
                hit[i] = hit[j] = True
            yield pa.RecordBatch.from_arrays([table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("tile", "node", "tag")], names=["tile", "node", "tag"]).filter(pa.array(hit))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, Plan] = {}
        for table, group in _held(batches, 8_000):
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                plan = plans.setdefault(dim, Plan(dim, threshold))
                at = np.flatnonzero(dims == dim)
                node, links, root = _tiles(table.take(pa.array(at)).combine_chunks(), group[at], plan, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    return run


def _tiles(table: pa.Table, group: np.ndarray, plan: Plan, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every linked node of some tiles: the links first found there, and the smallest node it reaches within its tile.

    A pair counts in the first block that has it within reach, and there in one cell, hence once overall.
    """
    node, mult, tag = (table[c].to_numpy() for c in ("node", "mult", "tag"))
    block = untag(tag)[2]
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    x = matrix(table["embedding"].combine_chunks(), plan.dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    r = plan.blocks(x)
    n = len(node)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in near_pairs(group, r[np.arange(n), block], plan.reach[block], tag):
        for lo in range(0, len(i), 16_384):
            p, q = i[lo : lo + 16_384], j[lo : lo + 16_384]
            d = r[p] - r[q]
            first = ((d * d).sum(axis=2) <= plan.reach**2).argmax(axis=1) == block[p]
            p, q = p[first], q[first]
            hit = (np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold) & (label[p] == label[q])
            left.append(p[hit])
            right.append(q[hit])
    p, q = np.concatenate(left), np.concatenate(right)
    links = np.bincount(p, mult[q], n) + np.bincount(q, mult[p], n)
    order = np.argsort(node, kind="stable")
    low = np.empty(n, np.int64)
    low[order] = np.arange(n)
    while True:
        least = np.minimum(low[p], low[q])
        new = low.copy()
        for ends in (p, q, order[low[p]], order[low[q]]):
            np.minimum.at(new, ends, least)
        if (new == low).all():
            break
        low = new
    on = np.flatnonzero(links)
    return node[on], links[on].astype(np.int64), node[order[low[on]]]
