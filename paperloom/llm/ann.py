"""Approximate nearest neighbours with randomly rotated one-bit codes.

After Gao and Long, "RaBitQ" (SIGMOD 2024): a unit vector is rotated, each coordinate kept as one sign bit, and the inner
product with a query, itself rounded to four bits a coordinate, is estimated from counts of common bits and one correction
scalar. The estimate's error bound decides which vectors are reranked on their original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .vectors import components_of, matrix, rotation, usable

PLANES = 4


def build_index(df: DataFrame, seed: int = 7) -> DataFrame:
    """(lane, vec_id, dim, code, corr, embedding) for every usable vector of ``df`` (vec_id, embedding), written once.

    ``code`` packs the signs of the rotated unit vector, ``corr`` is the code's inner product with that vector, ``lane``
    numbers the rows. Rows whose vec_id is null or whose vector is null, zero, or holds null or non-finite components get
    no code. Other columns of ``df`` are ignored; repeated rows stay repeated; no rows give an empty index. Nothing is
    fitted: the rotation depends on seed and dimension only.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spins: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(matrix(part["embedding"], dim)) @ spins.setdefault(dim, rotation(int(dim), seed))
                bits = np.packbits(x > 0, axis=1)
                corr = np.abs(x).sum(axis=1) / np.sqrt(dim)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["dim"], pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(corr), part["embedding"]],
                    names=["vec_id", "dim", "code", "corr", "embedding"],
                )

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), components_of(df, "embedding").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    kind = rows.schema["embedding"].dataType.simpleString()
    coded = rows.select("vec_id", F.size("embedding").alias("dim"), "embedding").mapInArrow(encode, f"vec_id long, dim int, code binary, corr double, embedding {kind}")
    return materialize(coded.select(F.monotonically_increasing_id().alias("lane"), "*"), "index")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Codes:
    """The coded vectors of one dimension that a task holds, ready to be searched."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, corr: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs, self.dim = ids, vecs, vecs.shape[1]
        words = np.zeros((len(ids), -(-self.dim // 64) * 8), np.uint8)
        words[:, : codes.shape[1]] = codes
        self.words = np.ascontiguousarray(words.view(np.uint64).T)
        ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.float32)
        error = np.sqrt(np.maximum(0, 1 - corr**2) / max(self.dim - 1, 1))
        self.terms = np.stack([corr, error, ones, np.ones(len(ids))]).astype(np.float32)

    def nearest(self, who: np.ndarray, asked: np.ndarray, k: int, eps: float, seed: int, met: list[int] | None = None, rows: int = 4096, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` nearest to each of ``asked`` found by code, best first; -inf where there are fewer.

        ``met`` takes the numbers of pairs estimated and reranked.
        """
        asked = unit(asked)
        spun = asked @ rotation(self.dim, seed)
        low = spun.min(axis=1)
        step = np.maximum((spun.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
        steps = np.rint((spun - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = []
        for b in range(PLANES):
            bits = np.zeros((len(asked), len(self.words) * 8), np.uint8)
            packed = np.packbits(steps >> b & 1, axis=1)
            bits[:, : packed.shape[1]] = packed
            planes.append(bits.view(np.uint64))
        root = np.sqrt(self.dim)
        # The code's product with the rounded query: scale * common + shift * ones + rest.
        scale, shift = 2 * step / root, 2 * low / root
        rest = -(low * self.dim + step * steps.sum(axis=1)) / root
        blur = eps * step / np.sqrt(12)
        best, found = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)
        floors = best[:, -1].copy()
        both = np.empty((few, rows), np.uint64)
        count, common = np.empty((few, rows), np.uint8), np.empty((few, rows), np.uint16)
        for lo in range(0, len(self.ids), rows):
            words, terms, ids = self.words[:, lo : lo + rows], self.terms[:, lo : lo + rows], self.ids[lo : lo + rows]
            n = len(ids)
            held = unit(self.vecs[lo : lo + rows].astype(np.float64))
            survivors: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(0, len(asked), few):
                sl = slice(at, at + few)
                m = len(who[sl])
                hold, some, sums = both[:m, :n], count[:m, :n], common[:m, :n]
                sums[:] = 0
                for b in reversed(range(PLANES)):
                    np.left_shift(sums, 1, out=sums)
                    for w, word in enumerate(words):
                        np.bitwise_and(planes[b][sl, w, None], word, out=hold)
                        np.bitwise_count(hold, out=some)
                        np.add(sums, some, out=sums)
                if lo == 0:
                    # A first floor: the k-th best of the few that the estimate puts on top.
                    about = (scale[sl, None] * sums + shift[sl, None] * terms[2] + rest[sl, None]) / terms[0]
                    about[who[sl, None] == ids] = -np.inf
                    top = np.argpartition(-about, min(4 * k, n) - 1, axis=1)[:, : 4 * k]
                    exact = np.einsum("ij,ikj->ik", asked[sl], held[top])
                    exact[who[sl, None] == ids[top]] = -np.inf
                    floors[sl] = -np.sort(-exact, axis=1)[:, k - 1] if n >= k else -np.inf
                floor = np.maximum(floors[sl], -2.0)
                need = np.stack([floor, np.full(m, -eps), -shift[sl], -rest[sl] - blur[sl]], axis=1) / scale[sl, None]
                q, c = np.nonzero(sums >= need.astype(np.float32) @ terms - np.float32(1e-3))
                survivors.append((q + at, c))
            q, c = (np.concatenate(x) for x in zip(*survivors, strict=True))
            keep = who[q] != ids[c]
            q, c = q[keep], c[keep]
            if met is not None:
                met += [len(asked) * n, len(q)]
            score = np.empty(len(q))
            for i in range(0, len(q), 4096):
                score[i : i + 4096] = np.einsum("ij,ij->i", asked[q[i : i + 4096]], held[c[i : i + 4096]])
            keep = score >= floors[q] - 1e-9
            q, c, score = q[keep], c[keep], score[keep]
            row = np.concatenate([q, np.repeat(np.arange(len(asked)), k)])
            name, score = np.concatenate([ids[c], found.ravel()]), np.concatenate([score, best.ravel()])
            order = np.lexsort((name, -score, row))
            take = np.searchsorted(row[order], np.arange(len(asked)))[:, None] + np.arange(k)
            best, found = score[order][take], name[order][take]
            floors = best[:, -1].copy()
        return best, found


def search(index: DataFrame, queries: DataFrame, k: int = 5, eps: float = 1.6, seed: int = 7, held_bytes: int = 128 << 20, block: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``index`` by cosine for every row of ``queries``.

    ``queries`` has (vec_id, embedding). A query meets every coded row of its own dimension except those with its own
    vec_id; rows that repeat a vec_id are candidates each, and of queries that share one the smallest vector asks. Index
    rows are dealt by number into chunks of about ``held_bytes``, queries into blocks of about ``block``; a task holds one
    chunk and streams one block past it, so neither side is broadcast or collected. ``eps`` is the error bound in standard
    deviations of the estimate. Ties go to the smaller vec_id; a query with fewer candidates gets them all. No usable
    query or row: no result row.
    """
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = asked.select(F.col("vec_id").cast("long").alias("id"), components_of(queries, "embedding").cast(index.schema["embedding"].dataType).alias("embedding"))
    asked = materialize(asked.groupBy("id").agg(F.min("embedding").alias("embedding")), "queries")
    rows, dim = index.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    chunks = max(1, -(-rows * dim * 8 // held_bytes), min(index.sparkSession.sparkContext.defaultParallelism, -(-rows // 4096)))
    blocks = max(1, -(-asked.count() // block))
    chunk, of = F.pmod(F.xxhash64("lane"), F.lit(chunks)), F.pmod(F.xxhash64("id"), F.lit(blocks))
    coded = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "dim", "code", "corr", "embedding")
    asking = asked.select(of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), "id", F.size("embedding").alias("dim"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("corr"), "embedding")
    both = coded.unionByName(asking).withColumn("tile", (F.col("block") * chunks + F.col("chunk")).cast("int")).drop("block", "chunk")
    both = both.repartitionById(min(blocks * chunks, 20_000), "tile").sortWithinPartitions("tile", "kind", "dim")
    hits = both.mapInArrow(_scan(k, eps, seed), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scan(k: int, eps: float, seed: int):
    """The k best of each tile for its queries; batches hold a tile's coded rows first, then its queries, each by dimension."""

    def codes(parts: list[pa.RecordBatch]) -> Codes:
        t = pa.Table.from_batches(parts).combine_chunks()
        dim = t["dim"][0].as_py()
        flat = t["embedding"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        bits = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return Codes(t["id"].to_numpy(), bits, t["corr"].to_numpy(), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, ready = None, {}, {}
        for batch in batches:
            keys = [batch[c].to_numpy() for c in ("tile", "kind", "dim")]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                now, kind, dim = (int(c[lo]) for c in keys)
                if now != tile:
                    tile, held, ready = now, {}, {}
                part = batch.slice(lo, hi - lo)
                if kind == 0:
                    held.setdefault(dim, []).append(part)
                    continue
                if dim in held:
                    ready[dim] = codes(held.pop(dim))
                if dim not in ready:
                    continue
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    who = some["id"].to_numpy()
                    score, found = ready[dim].nearest(who, matrix(some["embedding"], dim), k, eps, seed)
                    q, j = np.nonzero(score > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(who[q]), pa.array(found[q, j]), pa.array(score[q, j])], names=["query_id", "vec_id", "score"])

    return run
