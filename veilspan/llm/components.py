"""Connected components over links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _stars(pairs: DataFrame, down: bool) -> DataFrame:
    """One star round over pairs (u, v) that hold every neighbour v of u to be looked at.

    Every neighbour is linked to the smallest one.  Going up (large star) only larger
    neighbours move; going down (small star) the node itself moves too.
    """
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = pairs.join(least, "u")
    if down:
        out = moved.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    else:
        out = moved.where("v > u").select("v", "m")
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Links are only ever aggregated per node with partial sums and joined by node; each round is
    written to the shared folder.  Rounds grow with the logarithm of the longest chain.
    Repeated links and loops (a = b) do no harm; a null end is no link; no links give no rows.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = saved(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _stars(both, down=False)
        edges = saved(_stars(up.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), down=True), "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
