"""Tables shared by the driver and every executor, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("paperloom.scratch.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("paperloom.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Arrow batches of at most ``size`` bytes for the jobs run inside; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a reread instead of the whole lineage. The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its strings' and binaries' own, 16 for each element of its arrays and for any other column."""
    quoted = lambda f: "`" + f.name.replace("`", "``") + "`"
    own = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 16 * F.size(c)}
    sizes = [F.greatest(F.coalesce(own[t](quoted(f)), F.lit(0)), F.lit(0)) if (t := f.dataType.typeName()) in own else F.lit(16) for f in df.schema]
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("long"))


def small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows add up to at most ``limit`` bytes (see `row_bytes`); else left to a shuffled join."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df
