"""Operators on lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def line_edges(rows: DataFrame, doc: str, page: str, ratio: float, least_pages: int = 3) -> DataFrame:
    """(doc, place, text, lines): lines in the first or last tenth of a page, one at least, that recur across a document's pages.

    ``rows`` has doc, page, block_no and text. Of the five most frequent, those on max(2, ratio * pages) lines or more.
    """
    part = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    l = rows.select(F.col(doc).alias("_d"), F.col(page).alias("_p"), T.strip(F.col("text")).alias("t"), "block_no")
    l = l.withColumn("n", F.count("*").over(Window.partitionBy("_p"))).withColumn("r", F.row_number().over(Window.partitionBy("_p").orderBy("block_no")))
    sides = F.array_compact(F.array(F.when(F.col("r") <= part, F.lit("header")), F.when(F.col("r") > F.col("n") - part, F.lit("footer"))))
    c = l.where(F.length("t") > 5).select("_d", "_p", "t", F.explode(sides).alias("place")).groupBy("_d", "place", "t").agg(F.count("*").alias("lines"), F.min("_p").alias("seen"))
    pages = rows.groupBy(F.col(doc).alias("_d")).agg(F.countDistinct(page).alias("pages"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("_d", "place").orderBy(F.desc("lines"), "seen", "t"))).where("k <= 5").join(pages, "_d")
    c = c.where((F.col("pages") >= least_pages) & (F.col("lines") >= F.greatest(F.lit(2.0), F.col("pages") * ratio)))
    return c.select(F.col("_d").alias(doc), "place", F.col("t").alias("text"), "lines")
