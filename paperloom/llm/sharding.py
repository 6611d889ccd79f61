"""Two-pass external shuffle of whole records into shards, in DataFrame functions only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two shuffles each bucket in memory
(Spark's ``shuffle`` is a seeded Fisher-Yates). A record's place in the whole order is its bucket's start plus its place
there, and the places are dealt to the shards in turn, so shards differ by one row at most. Seed, rows and bucket sizes
alone decide the order: neither the input's partitions nor the session's shuffle partitions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import materialize, row_bytes, scratch_path, small


def numbered_copies(rows: DataFrame, lane_rows: int = 1_000) -> DataFrame:
    """``rows`` with ``_copy``: 0, and 0, 1, 2 and on among rows that are equal in full (``_mark`` is their hash).

    Only rows that repeat are written and numbered, in lanes of about ``lane_rows``, so many copies are spread too.
    """
    again = materialize(rows.groupBy("_mark").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    if again.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    held = rows.join(small(again), "_mark").withColumn("_at", F.monotonically_increasing_id())
    held = materialize(held.withColumn("_lane", F.pmod(F.xxhash64("_at"), F.ceil(F.col("_n") / lane_rows).cast("long"))), "copies")
    before = Window.partitionBy("_mark").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    base = held.groupBy("_mark", "_lane").agg(F.count("*").alias("_k")).select("_mark", "_lane", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_mark", "_lane").orderBy("_at")) - 1
    copies = held.withColumn("_rank", rank).join(base, ["_mark", "_lane"]).withColumn("_copy", F.col("_rank") + F.col("_base"))
    once = rows.join(small(again.select("_mark")), "_mark", "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    return once.unionByName(copies.select(*once.columns))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame, name: str) -> Column:
    """The column ``name`` in a form that Spark can hash: as JSON where it holds a map."""
    return F.to_json(F.struct(column(name))) if "map<" in df.schema[name].dataType.simpleString() else column(name)


def bucket_bases(counts: DataFrame, span: int = 1_000) -> DataFrame:
    """(_bucket, _base): the rows in buckets before each of ``counts`` (_bucket, n), added up within spans of buckets and then over spans."""
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("_span", F.floor(F.col("_bucket") / span))
    whole = spans.groupBy("_span").agg(F.sum("n").alias("n")).select("_span", upto(Window.orderBy("_span")).alias("_start"))
    within = spans.select("_span", "_bucket", upto(Window.partitionBy("_span").orderBy("_bucket")).alias("_in"))
    return within.join(whole, "_span").select("_bucket", (F.col("_start") + F.col("_in")).alias("_base"))


def freed(df: DataFrame) -> DataFrame:
    """``df`` with columns named slot or shard in any case, which the shards need, renamed with underscores at their end until no other column has the name."""
    taken, names = {c.lower() for c in df.columns} | {"slot", "shard"}, []
    for c in df.columns:
        name = c
        if c.lower() in ("slot", "shard"):
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def write_shards(df: DataFrame, path: str, shards: int = 8, bucket_rows: int = 20_000, seed: int = 17, key: str = "doc_id", bucket_bytes: int = 16 << 20) -> None:
    """Whole rows of ``df`` as Parquet under ``path``/shard=0 and on, with their ``slot``; each file is in slot order; see `freed`.

    A bucket holds about ``bucket_rows`` rows and ``bucket_bytes`` bytes at most, so the number of buckets follows the input.
    A row is known by its content and its number among equal rows, so repeated rows and null keys each get a place of
    their own and many equal rows are spread over the buckets. A bucket's task writes its part of every shard, so no task
    holds a shard. No rows write an empty folder. Columns of any name pass; those of the shards' own names are renamed as
    `freed` says.
    """
    df = freed(df)
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // bucket_rows), -(-total["b"] // bucket_bytes))
    names = [key, *(c for c in df.columns if c != key)]
    whole = F.struct(*map(column, names)).alias("_row")  # so that no name of the rows meets one of ours
    rows = df.select(whole, F.xxhash64(F.lit(seed), *(hashable(df, c) for c in names)).alias("_mark"))
    rows = numbered_copies(rows).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_mark", "_copy"), F.lit(buckets)))
    bases = materialize(bucket_bases(rows.groupBy("_bucket").agg(F.count("*").alias("n"))), "buckets")
    # As many partitions as buckets, sorted: the shuffle's draws depend on a bucket's partition and on those before it there.
    scattered = rows.select("_bucket", "_mark", "_copy", "_row").repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_mark", "_copy")
    held = scattered.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    mixed = held.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_i", "_row")).join(small(bases), "_bucket")
    position = F.col("_base") + F.col("_i")
    out = mixed.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.floor(position / shards).cast("long").alias("slot"), F.pmod(position, F.lit(shards)).cast("int").alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign_shards(df: DataFrame, shards: int = 8, bucket_rows: int = 20_000, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``df``, read from its written shards.

    The shards lie in the shared scratch folder; see `write_shards`. ``size`` is the written text's UTF-8 bytes plus 1 and
    ``text_crc32`` its checksum; a null text counts as none. Shards' counts differ by one at most, and slots run gapless
    from 0 within a shard. No rows give no rows. grown_shard is null under this law, ``rows``.
    """
    path = scratch_path(df.sparkSession, "shards")
    write_shards(df, path, shards, bucket_rows, seed, key, bucket_bytes)
    schema = StructType([*freed(df).schema.fields]).add("slot", "long").add("shard", "integer")
    back = df.sparkSession.read.schema(schema).parquet(path)
    return back.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
