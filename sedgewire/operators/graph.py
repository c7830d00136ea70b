"""Graph operators over edge tables: bounded reach, impact, propagation through cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.operators.components import connected_components
from sedgewire.runtime import cut


def bounded_reach(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(start, node, depth): nodes reached from each start over src -> dst in at most ``depth`` steps, with the fewest steps; starts themselves are left out."""
    step = edges.select("src", "dst").distinct()
    front = starts.select(F.col("node").alias("start")).distinct().select("start", F.col("start").alias("node"))
    seen = [front.select("start", "node", F.lit(0).alias("depth"))]
    for d in range(1, depth + 1):
        met = reduce(DataFrame.unionByName, seen).select("start", "node")
        front = cut(front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct().join(met, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front.select("start", "node", F.lit(d).alias("depth")))
    return reduce(DataFrame.unionByName, seen).where("depth > 0")


def impact(calls: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """(target, symbol, depth, confidence, severity): callers of each target up to ``depth`` calls away."""
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = bounded_reach(back, targets, depth)
    confidence = F.greatest(F.lit(0.05), 1 - 0.2 * (F.col("depth") - 1))
    return reach.select(F.col("start").alias("target"), F.col("node").alias("symbol"), "depth", F.round(confidence, 4).alias("confidence"), F.when(F.col("depth") == 1, "high").when(F.col("depth") == 2, "medium").otherwise("low").alias("severity"))


def impact_scope(severities: DataFrame, key: str) -> DataFrame:
    """(key, n_symbols, n_high, scope) from (key, symbol, severity): how widely a change has to be checked."""
    counts = severities.groupBy(key).agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct(F.when(F.col("severity") == "high", F.col("symbol"))).alias("n_high"), F.bool_or(F.col("severity") == "critical").alias("critical"))
    scope = F.when(F.col("critical") | (F.col("n_high") >= 5) | (F.col("n_symbols") >= 20), "strict").when((F.col("n_high") >= 2) | (F.col("n_symbols") >= 8), "standard").otherwise("quick")
    return counts.select(key, "n_symbols", "n_high", scope.alias("scope"))


def propagate(nodes: DataFrame, calls: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Levels and sets carried from callees to callers: (node, level, items, residual).

    nodes: node, level (int), items (array<string>). Callees are merged into
    callers from the leaves upward. Nodes that never become leaves stand on or
    above a cycle; of these every weakly connected cluster shares its greatest
    level and all its items.
    """
    known = nodes.select("node")
    edges = cut(calls.select("src", "dst").distinct().join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").join(known.withColumnRenamed("node", "src"), "src", "left_semi"))
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("pending"))
    live = cut(nodes.select("node", "level", "items").join(degree, "node", "left").select("node", "level", "items", F.coalesce("pending", F.lit(0)).alias("pending")))
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        leaves = live.where("pending = 0")
        if leaves.isEmpty():
            break
        done.append(leaves.select("node", "level", "items", F.lit(False).alias("residual")))
        given = edges.join(leaves.select(F.col("node").alias("dst"), F.col("level").alias("l"), F.col("items").alias("it")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("l").alias("l"), F.array_distinct(F.flatten(F.collect_list("it"))).alias("it"))
        live = cut(
            live.where("pending > 0").join(given, "node", "left").select(
                "node", F.greatest("level", F.coalesce("l", F.col("level"))).alias("level"), F.when(F.col("it").isNull(), F.col("items")).otherwise(F.array_union("items", "it")).alias("items"), (F.col("pending") - F.coalesce("n", F.lit(0))).alias("pending")
            )
        )
    rest = live.where("pending > 0")
    if not rest.isEmpty():
        inside = edges.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi")
        loops = rest.select(F.col("node").alias("src"), F.col("node").alias("dst"))
        parts = connected_components(inside.unionByName(loops))
        placed = rest.join(parts, "node")
        shared = placed.groupBy("component").agg(F.max("level").alias("level"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        done.append(placed.select("node", "component").join(shared, "component").select("node", "level", "items", F.lit(True).alias("residual")))
    out = reduce(DataFrame.unionByName, done) if done else live.select("node", "level", "items", F.lit(False).alias("residual"))
    return out.select("node", "level", F.array_sort("items").alias("items"), "residual")


def best_relations(edges: DataFrame, by: str, most: int, order: list[Column]) -> DataFrame:
    """Up to ``most`` rows of each key (the feature's own top k), in a total order."""
    from pyspark.sql import Window

    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
