"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.runtime import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node id of each node's component.

    Alternates large-star and small-star steps until nothing changes, which
    takes a number of rounds that grows with the logarithm of the longest
    path; a node of any degree is only ever a group of counted or minimised
    rows. Null ends are left out, loops keep their node as a component of its
    own, repeated and reversed edges count once, an empty table gives no rows.
    """
    pairs = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    live = pairs.where("u <> v")
    before = None
    for _ in range(max_rounds):
        # large star: all greater neighbours of a node point at its smallest neighbour
        both = live.select("u", "v").union(live.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        live = cut(small)
        now = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.join(live.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
