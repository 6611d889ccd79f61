"""Vector store queries: exact search in blocks of queries, fusion, reranking, context, and statistics of embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _blocks(rows: DataFrame, space: str, block: int = 512) -> DataFrame:
    """``rows`` as blocks of at most ``block`` rows of one namespace, each other column an array; made in the tasks, without a shuffle."""
    import numpy as np
    import pyarrow as pa

    names = [c for c in rows.columns if c != space]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            codes = b[space].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.append(0, np.flatnonzero(np.diff(codes[order])) + 1)
            ends = np.append(starts[1:], len(order))
            cuts = np.concatenate([np.arange(lo, hi, block) for lo, hi in zip(starts, ends, strict=True)])
            offsets = pa.array(np.append(cuts, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, b[c].take(pa.array(order))) for c in names]
            yield pa.RecordBatch.from_arrays([b[space].take(pa.array(order[cuts])), *lists], names=[space, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(space, *names).mapInArrow(run, ", ".join([f"{space} {kinds[space]}", *(f"{c} array<{kinds[c]}>" for c in names)]))


def _scored(met: DataFrame, threshold: float, k: int | None) -> DataFrame:
    """(query_no, id, rowid, score): the hits of blocks of entries (id, rowid, vec) beside blocks of queries (query_no, qvec), one product a pair of blocks.

    A score is the product over the shorter length by both norms, 0 if a norm is 0; NaN counts as the largest, and null
    vectors and those with a null component score nothing. A pair of blocks gives a query's ``k`` best and ties with the last.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["query_no", "id", "rowid"]
    kinds = [f"{c} {met.schema[c].dataType.elementType.simpleString()}" for c in names]

    def by_length(vecs: pa.Array) -> list[tuple]:
        """(places, their vectors as a matrix) of each length."""
        sizes, found = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False), []
        for n in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == n)
            flat = vecs.take(pa.array(at)).flatten()
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
            found.append((at[whole], x[whole], np.sqrt((x[whole] * x[whole]).sum(axis=1))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part = {c: b[c][r].values for c in b.schema.names}
                entries = by_length(part["vec"])
                for qi, q, qn in by_length(part["qvec"]):
                    for vi, v, vn in entries:
                        least = min(q.shape[1], v.shape[1])
                        with np.errstate(all="ignore"):
                            both = np.outer(qn, vn)
                            score = np.where(both == 0, 0.0, q[:, :least] @ v[:, :least].T / both)
                        hit = ~(score < threshold)
                        if k is not None and score.shape[1] > k:
                            ranked = np.where(np.isnan(score), np.inf, score)
                            hit &= ranked >= np.partition(ranked, -k, axis=1)[:, -k, None]
                        x, y = np.nonzero(hit)
                        columns = [part["query_no"].take(pa.array(qi[x])), part["id"].take(pa.array(vi[y])), part["rowid"].take(pa.array(vi[y])), pa.array(score[x, y])]
                        yield pa.RecordBatch.from_arrays(columns, names=[*names, "score"])

    return met.select(*names, "vec", "qvec").mapInArrow(run, ", ".join(kinds) + ", score double")


def _met(store: DataFrame, q: DataFrame, n: int, most: int, named: bool) -> DataFrame:
    """Blocks of ``store`` with the blocks of queries that may ask them: those of their namespace, or all of them.

    Up to ``most`` queries are broadcast. More meet the store in a shuffled join on tiles of its blocks, so that neither a
    frequent namespace nor the whole store is one key; the plan does not grow with their number.
    """
    same = F.col("qns") == F.col("namespace")
    if n <= most:
        return store.join(F.broadcast(_blocks(q.coalesce(1), "qns")), same if named else None, "inner" if named else "cross")
    tiles = 4 * int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.withColumn("tile", F.pmod(F.xxhash64("rowid", "id"), F.lit(tiles)).cast("int"))
    asked = _blocks(q, "qns").withColumn("qtile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    tile = F.col("tile") == F.col("qtile")
    return dealt.join(asked, tile & same if named else tile).drop("tile", "qtile")


def search(store: DataFrame, queries: DataFrame, k: int | None = 5, threshold: float = 0.0, max_queries: int = 10_000) -> DataFrame:
    """(query_no, rank, id, score): per query the ``k`` entries of its namespace with the largest cosine, not below ``threshold``.

    ``queries`` has (query_no, namespace or null for all, qvec); see `_met` for how they meet the store and `_scored` for the
    scores. With ``k`` None all hits are returned, without rank and without a shuffle. Else a task keeps its ``k`` best of a
    query before the shuffle (``k`` up to spark.sql.optimizer.windowGroupLimitThreshold). Scores are rounded to 4 places; ties go by rowid.
    """
    q = queries.select("query_no", F.col("namespace").alias("qns"), F.col("qvec").cast("array<double>").alias("qvec"))
    entries = _blocks(store.select("namespace", "id", "rowid", F.col("vec").cast("array<double>").alias("vec")), "namespace")
    total, named = q.agg(F.count("*"), F.count("qns")).first()
    parts = []
    if named or not total:
        parts.append(_scored(_met(entries, q.where("qns is not null"), named, max_queries, True), threshold, k))
    if total > named:
        parts.append(_scored(_met(entries, q.where("qns is null"), total - named, max_queries, False), threshold, k))
    hits = reduce(DataFrame.unionByName, parts)
    if k is None:
        return hits.select("query_no", "id", F.round("score", 4).alias("score"))
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "rowid")
    ranked = hits.select("query_no", "id", "rowid", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    return ranked.select("query_no", "rank", "id", F.round("score", 4).alias("score"))


def fuse(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits of several query variants (base, query_no, rank, id, score) as one list a base query: first arrival of an id wins."""
    first = Window.partitionBy("base", "id").orderBy("query_no", "rank")
    arrival = Window.partitionBy("base").orderBy("query_no", "rank")
    one = hits.withColumn("i", F.row_number().over(first)).where("i = 1").withColumn("place", F.row_number().over(arrival))
    return one.where(F.col("place") <= k).select("base", "place", "id", "score")


def context(hits: DataFrame, limit: int = 4000) -> DataFrame:
    """(base, context): per hit (base, place, score, page, heading, text) a labelled passage, joined and cut at ``limit``."""
    label = F.concat(F.lit("[Trecho (score: "), F.col("score").cast("string"), F.lit(") [p."), F.col("page").cast("string"), F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(", §"), F.substring("heading", 1, 50))).otherwise(""), F.lit("]]\n"), "text", F.lit("\n"))
    held = hits.select("base", "place", label.alias("p")).groupBy("base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]), "\n").alias("c"))
    return held.select("base", F.when(F.length("c") > limit, F.concat(F.substring("c", 1, limit), F.lit("\n...[cortado]"))).otherwise(F.col("c")).alias("context"))


def rerank(hits: DataFrame, k: int, score: Column | None = None, by: str = "base") -> DataFrame:
    """The ``k`` best of each query's hits (by, place, …) with rank and rerank_score: by ``score``, rounded to four places, ties by place.

    ``score`` is any column over the hits, a model's pandas UDF among them; without one the hits stay in their order.
    """
    rows = hits.withColumn("rerank_score", F.lit(None).cast("double") if score is None else F.round(score, 4))
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("rerank_score"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anisotropy(store: DataFrame) -> DataFrame:
    """(namespace, mean_norm, mean_cosine): length of the mean unit vector and mean pairwise cosine, in closed form from sums."""
    unit = store.where(norm(F.col("vec")) > 0).select("namespace", "id", F.posexplode(F.transform("vec", lambda x: x / norm(F.col("vec")))).alias("i", "x"))
    sums = unit.groupBy("namespace", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("namespace").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    few = F.col("n") < 3
    return out.select("namespace", F.when(few, 1.0).otherwise(F.round(F.sqrt("q") / F.col("n"), 4)).alias("mean_norm"), F.when(few, 1.0).otherwise(F.round((F.col("q") - F.col("n")) / (F.col("n") * F.greatest(F.col("n") - 1, F.lit(1))), 4)).alias("mean_cosine"))


def info_nce(store: DataFrame, temperature: float = 0.05, tile: int = 512) -> DataFrame:
    """(namespace, loss) over whole namespaces (namespace, id, vec): mean -log softmax of each row's similarity to itself among all rows.

    A namespace is cut into tiles of about ``tile`` rows by a hash of the id, its key. Each pair of tiles is one product of two
    small matrices, of which a row keeps its sum of exponentials under the largest possible similarity, 1 / temperature;
    these sums add up over the tiles, so no row meets all others in one place. The work grows with the square of a
    namespace, as the loss itself does. Vectors that are null, of length 0 or shorter than their namespace's longest take no
    part; a namespace of one row loses 0.
    """
    import numpy as np
    import pandas as pd

    rows = store.where(norm(F.col("vec")) > 0).select("namespace", "id", "vec")
    sizes = rows.groupBy(F.col("namespace").alias("_ns")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.max(F.size("vec")).alias("dim"))
    rows = rows.join(sizes, F.col("namespace").eqNullSafe(F.col("_ns"))).where(F.size("vec") == F.col("dim"))
    own, each = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    asking = rows.select("namespace", own.alias("left"), each.alias("right"), F.lit(True).alias("asks"), "id", "vec")
    asked = rows.select("namespace", each.alias("left"), own.alias("right"), F.lit(False).alias("asks"), "id", "vec")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        side = pdf["asks"].to_numpy(bool)
        total = np.exp((x[side] @ x[~side].T - 1) / temperature).sum(axis=1)
        return pd.DataFrame({"namespace": pdf["namespace"][side], "id": pdf["id"][side], "total": total, "own": (x[side] * x[side]).sum(axis=1)})

    kind = store.schema["id"].dataType.simpleString()
    met = asking.unionByName(asked).groupBy("namespace", "left", "right").applyInPandas(product, f"namespace string, id {kind}, total double, own double")
    loss = F.log(F.sum("total")) - (F.max("own") - 1) / temperature
    return met.groupBy("namespace", "id").agg(loss.alias("l")).groupBy("namespace").agg(F.round(F.avg("l"), 4).alias("loss"))


def noisy_copy(store: DataFrame, sigma: float = 0.01, seed: int = 3) -> DataFrame:
    """``store`` with ``noisy``: each vector plus Gaussian noise that depends on id, position and seed only (Box-Muller on hashes)."""
    u = lambda *k: (F.pmod(F.xxhash64("id", *k), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = lambda i: F.sqrt(-2 * F.log(u(i, F.lit(2 * seed)))) * F.cos(u(i, F.lit(2 * seed + 1)) * 6.283185307179586)
    return store.withColumn("noisy", F.transform("vec", lambda x, i: x + noise(i) * sigma))


def condition_number(store: DataFrame, dim: int) -> DataFrame:
    """(namespace, condition): ratio of the largest and smallest singular value of a namespace's vectors of length ``dim``.

    Tasks add up ``dim`` x ``dim`` Gram matrices; a namespace's few matrices then meet, whatever its number of vectors.
    """
    import numpy as np
    import pandas as pd

    def grams(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for ns, part in b.groupby("namespace"):
                x = np.stack(part["vec"].to_numpy())
                total[ns] = total.get(ns, 0) + x.T @ x
        if total:
            yield pd.DataFrame({"namespace": list(total), "gram": [g.ravel() for g in total.values()]})

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        eig = np.linalg.eigvalsh(np.sum(np.stack(pdf["gram"].to_numpy()), axis=0).reshape(dim, dim))
        low = max(float(eig[0]), 0.0)
        return pd.DataFrame({"namespace": [key[0]], "condition": [float(np.sqrt(eig[-1] / low)) if low > 0 else float("inf")]})

    rows = store.where((F.size("vec") == dim) & F.col("namespace").isNotNull()).select("namespace", "vec")
    partial = rows.mapInPandas(grams, "namespace string, gram array<double>")
    return partial.groupBy("namespace").applyInPandas(finish, "namespace string, condition double")
