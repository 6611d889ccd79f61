"""Keyed Parquet tables: upserts rewrite only the buckets whose keys changed, and a point read opens one bucket.

A table lies under ``bucket=<hash of the key>/epoch=<number of the write>``. A write adds a new epoch to the buckets it
touches, made of their rows before it and its own; readers take each bucket's last epoch. A write that is repeated, after a
lost driver or by a restarted stream, replaces its own epoch and leaves the same table.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .state import latest

PLACE = ("bucket", "epoch")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that goes when the driver's JVM ends; local mode without it takes a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row a key, the last by ``order``; columns must not be called bucket or epoch.

    ``schema`` is that of the rows. ``buckets`` fixes the layout: aim at files of about 128 MB, as an upsert rewrites whole
    buckets. Null keys are a key like any other. One writer at a time; readers may run beside it.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    order: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self) -> None:
        if taken := [c for c in self.schema.names if c.lower() in PLACE]:
            raise ValueError(f"the table's own columns: {taken}")
        if missing := {self.key, *self.order} - set(self.schema.names):
            raise ValueError(f"no such columns: {sorted(missing)}")

    def bucket_of(self, key: Column) -> Column:
        """The bucket of a key, which is first cast to the table's own type."""
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _files(self) -> DataFrame:
        """The rows of every epoch, with their places; none before the first write."""
        placed = StructType([*self.schema.fields]).add("bucket", IntegerType()).add("epoch", LongType())
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], placed)
        return self.spark.read.schema(placed).parquet(self.path)

    def _current(self, files: DataFrame) -> DataFrame:
        """The rows of the last epoch of each bucket; the epochs come from the folders and are at most one row a bucket."""
        last = files.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
        return files.join(F.broadcast(last), list(PLACE)).select(*self.schema.names, *PLACE)

    def upsert(self, rows: DataFrame, epoch: int) -> None:
        """Put ``rows`` in; of a key's rows, new or held, the last by ``order`` stays. ``epoch`` grows from write to write.

        Of the table only the buckets that ``rows`` fall in are read and written; the list of them is all the driver sees.
        """
        new = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of(F.col(self.key)))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        files = self._files().where(F.col("bucket").isin(touched) & (F.col("epoch") < epoch))
        held = self._current(files).drop("epoch")
        merged = latest(held.unionByName(new).withColumn("_place", F.struct(self.key, "bucket")).drop(self.key, "bucket"), "_place", *self._order())
        out = merged.select("_place.*", *[c for c in self.schema.names if c != self.key]).withColumn("epoch", F.lit(epoch).cast("long"))
        writer = out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PLACE).parquet(self.path)

    def _order(self) -> list[str]:
        return [f"_place.{c}" if c == self.key else c for c in self.order]

    def read(self) -> DataFrame:
        """Every key's row."""
        return self._current(self._files()).select(*self.schema.names)

    def get(self, value) -> DataFrame:
        """The row of one key, or none: the scan is of that key's bucket alone, with the key pushed to its row groups."""
        key = F.lit(value).cast(self.schema[self.key].dataType)
        bucket = self.spark.range(1).select(self.bucket_of(key)).first()[0]
        return self._current(self._files().where(F.col("bucket") == bucket)).where(F.col(self.key).eqNullSafe(key)).select(*self.schema.names)

    def get_all(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in the first column of ``keys``, each once: a hash join on bucket and key."""
        wanted = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias("_key")).distinct()
        wanted = wanted.withColumn("_bucket", self.bucket_of(F.col("_key")))
        held = self._current(self._files())
        on = (F.col("bucket") == F.col("_bucket")) & F.col(self.key).eqNullSafe(F.col("_key"))
        return held.join(wanted, on, "left_semi").select(*self.schema.names)

    def vacuum(self) -> int:
        """Delete the epochs that a later one of their bucket has replaced, and tell how many; no reader may be at them."""
        places = self._files().select(*PLACE).distinct()
        last = places.groupBy("bucket").agg(F.max("epoch").alias("last"))
        old = places.join(last, "bucket").where("epoch < last").select(*PLACE).collect()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        for r in old:
            path = folder(f"{self.path}/bucket={r.bucket}/epoch={r.epoch}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)


def run_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """Each micro-batch of an append log into ``table``, its number the epoch, so that a repeated batch changes nothing."""
    sink = stream.writeStream.foreachBatch(lambda batch, epoch: table.upsert(batch, epoch))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
