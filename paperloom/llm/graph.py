"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _hook(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v.

    The minimum of each neighbourhood is a partial aggregate joined back, so a hub is never gathered into one task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    large = large.distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("m"), "u")
    out = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest reachable node.

    Null ends and self links are ignored; repeated links count once. Stops when a round changes nothing.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = materialize(state.where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    while True:
        # Stars only: every node has one neighbour, and no neighbour is itself a spoke.
        sign = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = sign
        state = materialize(_hook(state), "edges")
