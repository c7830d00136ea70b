"""Parent-child links to hierarchies by tree contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.runtime import store, store_counting, stored

#: Links that one task contracts by itself once no more than these are left.
BLOCK_LINKS = 20_000
#: Ids in the paths of one output batch of such a task.
_BATCH_IDS = 500_000
#: What is known of a link: its node, where it leads to, rounds, its length, the least id on it, the ids on it from below, and its state.
LINK = "node string, parent string, turn int, dist bigint, low string, via array<string>, state string"


def _round(live: DataFrame, with_path: bool) -> DataFrame:
    """One round over the links: rake all leaves, splice out an independent set of unary chain nodes.

    A chain node is spliced if its hash beats that of both neighbours, so no
    two neighbours go at once; the link of its only child, raked or not, then
    leads on to its parent. Every link comes back with its state: live, raked,
    spliced (as it was when its node went), or core, a link of a node to itself.
    """
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.col("turn")), F.col(c))
    children = live.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("child"))
    seen = live.drop("state").join(children.hint("merge"), "node", "left")
    seen = seen.withColumn("state", F.when(F.col("n").isNull(), "raked").when((F.col("n") == 1) & (rank("node") > rank("parent")) & (rank("node") > rank("child")), "spliced").otherwise("live"))
    splices = seen.where("state = 'spliced'").select(
        F.col("child").alias("node"), F.col("parent").alias("s_parent"), F.col("dist").alias("s_dist"), F.col("low").alias("s_low"), F.col("via").alias("s_via"), F.col("node").alias("s_node")
    )
    over = F.col("s_node").isNotNull()
    parent = F.coalesce("s_parent", "parent")
    via = F.when(over, F.concat("via", F.array("s_node"), "s_via")).otherwise(F.col("via")) if with_path else F.col("via")
    return seen.join(splices.hint("merge"), "node", "left").select(
        "node",
        parent.alias("parent"),
        (F.col("turn") + 1).alias("turn"),
        F.when(over, F.col("dist") + F.col("s_dist")).otherwise(F.col("dist")).alias("dist"),
        F.when(over, F.least("low", "s_low")).otherwise(F.col("low")).alias("low"),
        via.alias("via"),
        F.when((F.col("state") == "live") & (parent == F.col("node")), "core").otherwise(F.col("state")).alias("state"),
    )


def _contract_block(node: np.ndarray, parent: np.ndarray, dist: np.ndarray, low: np.ndarray, via: list | None) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """The same rounds over links in memory; vertices are numbers in the order of their ids.

    Returns (rounds, anchor, dist, low): per round the links that went, as
    indexes; the other arrays hold each link's state when it went, a core being
    a link whose anchor is its node. ``via`` is changed in place.
    """
    vertices = int(max(node.max(), parent.max(), low.max())) + 1
    live, rounds, turn = np.arange(len(node)), [], 0
    while True:
        live = live[node[live] != parent[live]]
        if not len(live):
            return rounds, parent, dist, low
        turn += 1
        n = np.bincount(parent[live], minlength=vertices)
        child = np.zeros(vertices, np.int64)
        child[parent[live]] = live  # the only child where there is one
        rank = np.random.default_rng(turn).permutation(vertices)
        v = node[live]
        raked = n[v] == 0
        spliced = (n[v] == 1) & (rank[v] > rank[parent[live]]) & (rank[v] > rank[node[child[v]]])
        for i in live[spliced] if via is not None else ():
            via[child[node[i]]] = [*via[child[node[i]]], node[i], *via[i]]
        gone = live[spliced]
        below = child[node[gone]]
        parent[below], dist[below], low[below] = parent[gone], dist[below] + dist[gone], np.minimum(low[below], low[gone])
        rounds.append(live[raked | spliced])
        live = live[~(raked | spliced)]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract all links of a task to their end and reverse that: each link leads to what is no node of a link any more."""
    block = pa.Table.from_batches(list(batches))
    if not block.num_rows:
        return
    column = lambda c: block[c].to_numpy(zero_copy_only=False)
    names, numbers = np.unique(np.concatenate([column("node"), column("parent"), column("low")]).astype(object), return_inverse=True)
    node, parent, low = (x.copy() for x in np.split(numbers.astype(np.int64), 3))
    dist, vias = column("dist").copy(), block["via"].to_pylist()
    via = None if block["via"].null_count else [[*x] for x in vias]
    rounds, anchor, dist, low = _contract_block(node, parent, dist, low, via)
    link = np.full(len(names), -1)
    gone = np.concatenate(rounds) if rounds else np.zeros(0, np.int64)
    link[node[gone]] = gone
    end, total = anchor.copy(), dist.copy()
    for went in reversed(rounds):  # anchors went later and are known
        on = link[anchor[went]]
        far = on >= 0
        end[went[far]], total[went[far]] = end[on[far]], dist[went[far]] + total[on[far]]
    state = np.where(anchor == node, "core", "raked")
    state[gone] = "raked"
    name = lambda x: x if isinstance(x, str) else names[x]

    def path(i: int) -> list[str]:
        out = [name(x) for x in via[i]]
        while (at := link[anchor[i]]) >= 0:
            out.append(names[anchor[i]])
            i = at
            out.extend(map(name, via[i]))
        return out

    step = len(node) if via is None else max(1, _BATCH_IDS // max(1, int(total.max())))
    for at in range(0, len(node), step):
        some = np.arange(at, min(len(node), at + step))
        paths = [None] * len(some) if via is None else [path(i) if state[i] == "raked" else [] for i in some]
        arrays = [names[node[some]], names[end[some]], np.zeros(len(some), np.int32), total[some], names[low[some]], paths, state[some]]
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()))], names=block.schema.names)


def contract(links: DataFrame, with_path: bool = False, block: int = BLOCK_LINKS, max_rounds: int = 200) -> list[str]:
    """Contract the forest of ``links`` (node, parent; one row per node that has a parent node).

    Each round lessens the links by a constant factor; when at most ``block``
    are left, one task does the remaining rounds by the same rules. Returns the
    folders of the recorded contractions (columns as in ``LINK``), one for each
    round that was a job: what a link leads to is gone in a later one or never.
    Links of state live are not yet done in their round; those of state core
    are left in the end, one for each circle, with its smallest id as low.
    """
    spark = links.sparkSession
    empty = F.array().cast("array<string>") if with_path else F.lit(None).cast("array<string>")
    start = links.select("node", "parent", F.lit(0).alias("turn"), F.lit(1).cast("long").alias("dist"), F.col("node").alias("low"), empty.alias("via"), F.when(F.col("node") == F.col("parent"), "core").otherwise("live").alias("state"))
    path, left = store_counting(start, F.col("state") == "live")
    tables = [path]
    for _ in range(max_rounds):
        if left <= block:
            break
        path, left = store_counting(_round(stored(spark, LINK, tables[-1:]).where("state = 'live'"), with_path), F.col("state") == "live")
        tables.append(path)
    else:
        raise RuntimeError(f"tree contraction did not end within {max_rounds} rounds")
    if left:
        tables.append(store_counting(stored(spark, LINK, tables[-1:]).where("state = 'live'").repartition(1).mapInArrow(_finish, LINK), F.lit(False))[0])
    return tables


def _reversed(spark: SparkSession, tables: list[str], with_path: bool) -> DataFrame:
    """(node, end, dist, via): the recorded contractions undone from the last table to the first, each in one join."""
    undone = "node string, end string, dist bigint, via array<string>"
    done: list[str] = []
    for table in reversed(tables):
        own = stored(spark, LINK, [table]).where("state in ('raked', 'spliced')").select("node", F.col("parent").alias("end"), "dist", "via")
        if done:
            up = stored(spark, undone, done).select(F.col("node").alias("end"), F.col("end").alias("u_end"), F.col("dist").alias("u_dist"), F.col("via").alias("u_via"))
            step = F.col("u_end").isNotNull()
            via = F.when(step, F.concat("via", F.array("end"), "u_via")).otherwise(F.col("via")) if with_path else F.col("via")
            own = own.join(up.hint("merge"), "end", "left").select("node", F.coalesce("u_end", "end").alias("end"), F.when(step, F.col("dist") + F.col("u_dist")).otherwise(F.col("dist")).alias("dist"), via.alias("via"))
        done.append(store_counting(own, F.lit(False))[0])
    return stored(spark, undone, done)


def hierarchy(rows: DataFrame, node: str, parent: str, with_path: bool = False, block: int = BLOCK_LINKS) -> DataFrame:
    """Root, depth and (on request) path of every node of a parent-child table.

    Returns node, root, depth, on_cycle and path (ids from the root to the node,
    null without ``with_path``). A null parent or one that is not in the table
    makes a root. A node whose links lead into a circle has depth -1, the
    smallest id of the circle as root and a null path. ``rows`` must have one
    row for each non-null node; null nodes are left out; an empty table gives
    an empty result; further columns are ignored.

    The links are contracted (``contract``), and the records are undone in
    reverse. Rounds join by merge, so that none keeps a table on the driver.
    """
    nodes = store(rows.where(F.col(node).isNotNull()).select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")))
    links = nodes.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    tables = contract(links, with_path, block)
    at = _reversed(rows.sparkSession, tables, with_path)
    cores = stored(rows.sparkSession, LINK, tables).where("state = 'core'").select(F.col("node").alias("end"), F.col("low").alias("c_low"))
    ends = nodes.select("node").join(at.withColumnRenamed("end", "anchor"), "node", "left").withColumn("end", F.coalesce("anchor", "node"))
    circle = F.col("c_low").isNotNull()
    path = F.when(~circle, F.when(F.col("anchor").isNull(), F.array("node")).otherwise(F.concat(F.array("anchor"), F.reverse("via"), F.array("node")))) if with_path else F.lit(None).cast("array<string>")
    return ends.join(cores, "end", "left").select(
        "node",
        F.coalesce("c_low", "end").alias("root"),
        F.when(circle, F.lit(-1)).otherwise(F.coalesce("dist", F.lit(0))).cast("long").alias("depth"),
        circle.alias("on_cycle"),
        path.alias("path"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """All (node, descendant, distance) pairs from a hierarchy with paths; circles have none."""
    return (
        paths.where(F.col("path").isNotNull())
        .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
        .where("at < depth")
        .select("node", "descendant", (F.col("depth") - F.col("at")).cast("long").alias("distance"))
    )


def ancestors(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, ancestor, depth): ancestors up to ``most`` steps away, with the fewest steps; round a circle a node meets itself.

    ``links``: node, parent, one row per node. The steps double from join to join.
    """
    walk = store(links.where("node is not null and parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")))
    reach = 1
    while reach < most:
        far = walk.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        near = walk.where(F.col("depth") <= most - reach).select(F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        walk = store(walk.unionByName(far.join(near, "via").select("node", "ancestor", "depth")))
        reach = min(2 * reach, most)
    return walk.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
