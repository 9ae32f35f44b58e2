"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: two long columns. One row ``node``, ``root`` (the smallest node of
    its component) per node that has a link.

    Each round hangs every node's larger neighbours, then its smaller ones, under the
    smallest node it sees, and is written to the staging folder; a component of any
    shape is a star after O(log^2 n) rounds. A star's centre is a hot key of the
    joins only (which adaptive execution splits), never of a window or a collected
    group."""
    a, b = links.columns
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(low.select("u", F.col("m").alias("v")).union(small).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
