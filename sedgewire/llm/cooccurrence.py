"""Items that appear together: pair counts by a blocked Gram matrix, against expected marginals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.runtime import store

#: Items of one side of a block, and item occurrences of one record block.
BLOCK_ITEMS, BLOCK_OCCURRENCES = 2048, 262_144
#: Cells of the pair products that one addition handles at once.
_CHUNK = 1 << 22


def _gram(rows: np.ndarray, cols_a: np.ndarray, rows_b: np.ndarray, cols_b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Sum over records of the outer products of two binary sparse item blocks (sorted by record)."""
    out = np.zeros(n_a * n_b, np.int64)
    records = np.intersect1d(rows, rows_b)
    a_lo, a_hi = np.searchsorted(rows, records), np.searchsorted(rows, records, side="right")
    b_lo, b_hi = np.searchsorted(rows_b, records), np.searchsorted(rows_b, records, side="right")
    a_n, b_n = a_hi - a_lo, b_hi - b_lo
    shapes = a_n * (b_n.max() + 1 if len(b_n) else 1) + b_n
    for shape in np.unique(shapes):
        same = np.flatnonzero(shapes == shape)
        x, y = int(a_n[same[0]]), int(b_n[same[0]])
        step = max(1, _CHUNK // (x * y))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            left = cols_a[a_lo[some][:, None] + np.arange(x)]
            right = cols_b[b_lo[some][:, None] + np.arange(y)]
            cells = (left[:, :, None] * n_b + right[:, None, :]).ravel()
            if len(cells) * 8 > len(out):
                out += np.bincount(cells, minlength=len(out))
            else:
                np.add.at(out, cells, 1)
    return out.reshape(n_a, n_b)


def cooccurring(
    baskets: DataFrame,
    group: str,
    basket: str,
    items: str,
    min_count: int = 5,
    min_lift: float = 3.0,
    block_items: int = BLOCK_ITEMS,
    block_occurrences: int = BLOCK_OCCURRENCES,
) -> DataFrame:
    """Pairs of items of a group that share at least ``min_count`` baskets, ``min_lift`` times as many as by chance.

    ``baskets`` has a group, a basket key and an array of items; rows of one
    (group, basket) are one basket, an item counts once in it, null and empty
    items and baskets without items do not count, null groups and baskets are
    left out. With n baskets in the group, c with both items, a and b with the
    one and the other, a pair is kept if c >= min_count and c*n >= min_lift*a*b.
    Returns group, item_a, item_b (a before b), together (c), count_a, count_b,
    n_baskets, lift. Empty tables give no rows; ties and order do not matter.

    Items below ``min_count`` cannot be in a pair and are left out first. The
    rest of a group is split by hash into item blocks and record blocks as its
    size asks for; an item is a number in its block from then on. Blocks that
    meet in some basket make one Gram product for each record block, held in a
    dense array, and only its non-zero cells leave the task; so neither a large
    group nor a large basket is expanded into pair rows, and an occurrence has
    as many copies as its basket has blocks. Baskets are told apart by a 64-bit
    hash inside their group.
    """
    g, r = F.col(group), F.col(basket)
    # one shuffle by basket; the distinct needs no other, and both uses below share it
    occurrences = (
        baskets.where(g.isNotNull() & r.isNotNull())
        .select(g.alias("g"), F.xxhash64(r).alias("r"), F.explode(F.array_distinct(items)).alias("item"))
        .where("item is not null and item <> ''")
        .repartition("g", "r")
        .dropDuplicates(["g", "r", "item"])
    )
    sizes = occurrences.groupBy("g", "r").count().groupBy("g").agg(F.count("*").alias("n"))
    counts = occurrences.groupBy("g", "item").agg(F.count("*").alias("a")).where(F.col("a") >= min_count)
    frequent = counts.groupBy("g").agg(F.count("*").alias("n_items"), F.sum("a").alias("n_occurrences")).join(sizes, "g")
    blocks = frequent.select("g", "n", F.ceil(F.col("n_items") / (0.7 * block_items)).cast("int").alias("item_blocks"), F.ceil(F.col("n_occurrences") / block_occurrences).cast("int").alias("record_blocks"))
    numbered = (
        counts.join(blocks, "g")
        .withColumn("own", F.pmod(F.xxhash64("item"), "item_blocks").cast("int"))
        .withColumn("at", F.row_number().over(Window.partitionBy("g", "own").orderBy("item")) - 1)
    )
    numbered = store(numbered.select("g", "item", F.col("a").cast("int").alias("a"), "n", "own", "at", "record_blocks"))
    placed = occurrences.join(numbered, ["g", "item"]).select("g", "r", "own", "at", "a", "n", "record_blocks")
    # the blocks of a basket meet one another and themselves: (own, other) in order
    meeting = placed.withColumn("met", F.collect_set("own").over(Window.partitionBy("g", "r")))
    spread = meeting.withColumn("other", F.explode("met")).select("g", F.pmod("r", "record_blocks").cast("int").alias("record_block"), "record_blocks", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "at", "a", "n", "r")

    kept = {"min_count": min_count, "min_lift": min_lift}

    def product(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        i, j, whole = key[3], key[4], key[2] == 1
        block = block.sort_values("r", kind="stable")
        sides = []
        for own in (i, j):
            part = block[block["own"] == own]
            index = part["at"].to_numpy().astype(np.int64)
            marginal = np.zeros(int(index.max(initial=-1)) + 1, np.int64)
            marginal[index] = part["a"].to_numpy()
            sides.append((part["r"].to_numpy(), index, marginal))
        (rows_a, cols_a, marg_a), (rows_b, cols_b, marg_b) = sides
        n = int(block["n"].iloc[0])
        gram = _gram(rows_a, cols_a, rows_b, cols_b, len(marg_a), len(marg_b))
        if i == j:
            gram = np.triu(gram, 1)
        if whole:  # all records of the group are here, so the counts are final
            x, y = np.nonzero((gram >= kept["min_count"]) & (gram * n >= kept["min_lift"] * marg_a[:, None] * marg_b[None, :]))
        else:
            x, y = np.nonzero(gram)
        return pd.DataFrame({"g": key[0], "i": i, "j": j, "x": x, "y": y, "c": gram[x, y]})

    products = spread.groupBy("g", "record_block", "record_blocks", "i", "j").applyInPandas(product, "g string, i int, j int, x int, y int, c long")
    summed = products.groupBy("g", "i", "j", "x", "y").agg(F.sum("c").alias("together")).where(F.col("together") >= min_count)
    side = lambda own, at, name, count: numbered.select("g", F.col("own").alias(own), F.col("at").alias(at), F.col("item").alias(name), F.col("a").cast("long").alias(count), *(["n"] if own == "i" else []))
    named = summed.join(side("i", "x", "item_i", "count_i"), ["g", "i", "x"]).join(side("j", "y", "item_j", "count_j"), ["g", "j", "y"])
    named = named.where(F.col("together") * F.col("n") >= min_lift * F.col("count_i") * F.col("count_j"))
    first = F.col("item_i") < F.col("item_j")
    either = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return named.select(
        F.col("g").alias(group), either("item_i", "item_j", "item_a"), either("item_j", "item_i", "item_b"), "together", either("count_i", "count_j", "count_a"), either("count_j", "count_i", "count_b"),
        F.col("n").alias("n_baskets"), F.round(F.col("together") * F.col("n") / (F.col("count_i") * F.col("count_j")), 6).alias("lift"),
    )
