"""Mixing sources to target weights by drawing fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.llm.bpe import TOKENIZERS, encode_column
from sedgewire.runtime import cut, store

#: Tokens of a block, blocks of an output shard, parts of a source (and shards of a chunk) for running sums.
BLOCK_TOKENS, SHARD_BLOCKS, PARTS = 256, 1024, 4096


def source_name(c: Column) -> Column:
    """Lower case, trimmed, ``_`` for ``-``."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def token_blocks(encoded: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """Pack the tokens of each source, documents in pseudorandom order, into blocks.

    ``encoded``: source, doc_id, ids. Returns source, block (from 0), ids,
    n_tokens; only the last block of a source may be short. Running sums are
    taken per part of a source first, so that no source is held by one task.
    """
    keyed = encoded.select("source", "doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.size("ids").cast("long").alias("n")).where("n > 0").withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    parts = keyed.groupBy("source", "part").agg(F.sum("n").alias("part_n"))
    before = parts.select("source", "part", (F.sum("part_n").over(Window.partitionBy("source").orderBy("part")) - F.col("part_n")).alias("part_start"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    starts = keyed.withColumn("upto", F.sum("n").over(inside)).join(before, ["source", "part"]).select("doc_id", (F.col("part_start") + F.col("upto") - F.col("n")).alias("start"))
    size = F.lit(block_tokens).cast("long")
    first, last = F.expr("start div {0}".format(block_tokens)), F.expr("(start + size(ids) - 1) div {0}".format(block_tokens))
    piece = lambda b: F.struct(
        b.alias("block"),
        F.greatest(F.col("start"), b * size).alias("at"),
        F.slice("ids", (F.greatest(F.col("start"), b * size) - F.col("start") + 1).cast("int"), (F.least(F.col("start") + F.size("ids"), (b + 1) * size) - F.greatest(F.col("start"), b * size)).cast("int")).alias("ids"),
    )
    pieces = encoded.where(F.size("ids") > 0).join(starts, "doc_id").select("source", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    packed = pieces.groupBy("source", F.col("p.block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("p.at", "p.ids"))).alias("ps"))
    return packed.select("source", "block", F.flatten(F.col("ps.ids")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


def block_permutation(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed pseudorandom permutation of range(size): a Feistel network with cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            x = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= size
    return out.astype(np.int64)


def slot_totals(shares: np.ndarray, blocks: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, block_tokens: int, total_tokens: int | None) -> np.ndarray:
    """Slots each source gets in all.

    Without a wanted total it is the greatest one at which every source that
    has tokens meets its share (shares are scaled to those sources). With a
    greater one, sources stop at their cap and the rest is shared among the
    others by their weights, until all are exhausted.
    """
    cap = blocks * repeats
    weight = np.where((tokens > 0) & (cap > 0), shares, 0.0)
    if weight.sum() <= 0:
        return np.zeros(len(shares), np.int64)
    weight = weight / weight.sum()
    if total_tokens is None:
        live = weight > 0
        total = int(min((tokens[live] * repeats[live]) / weight[live]) // block_tokens)
    else:
        total = min(total_tokens // block_tokens, int(cap[weight > 0].sum()))
    want, open_, rest = np.zeros(len(shares)), weight > 0, float(total)
    while rest > 1e-9 and open_.any():
        add = rest * np.where(open_, weight, 0) / weight[open_].sum()
        room = cap - want
        given = np.minimum(add, room)
        want, rest, open_ = want + given, rest - given.sum(), open_ & (add < room)
    whole = np.floor(want + 1e-9).astype(np.int64)
    for i in np.argsort(-(want - whole), kind="stable")[: int(round(total - rest)) - int(whole.sum())]:
        whole[i] += whole[i] < cap[i]
    return whole


def _draw(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """Source index of each slot of a shard: multinomial counts, then a shuffle."""
    rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
    return rng.permutation(np.repeat(np.arange(len(weights)), rng.multinomial(slots, weights)))


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    shard_blocks: int = SHARD_BLOCKS,
    total_tokens: int | None = None,
    seed: int = 0,
    vocabulary: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
) -> tuple[DataFrame, DataFrame]:
    """(mix, available): the drawn blocks, and documents and tokens per source.

    mix: shard, slot, source, block, repeat (from 0), ids, n_tokens. Each
    shard's source counts are multinomial; what the totals of all shards are
    over or under their exact value is moved between sources, so shares hold to
    within a block and no block is drawn more than max_repeats times. A null
    text has no tokens; a null source, or one without a target, is in
    ``available`` only; a target without documents gets nothing and the other
    shares grow in proportion; several target rows of one source count once
    (the greatest row); no targets or no documents give an empty mix.
    """
    spark = documents.sparkSession
    named = documents.select("doc_id", "text", source_name(F.col("source")).alias("source"))
    encoded = store(encode_column(named, "text", ["doc_id", "source"], vocabulary, folder))
    available = encoded.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    plan = sorted(wanted.join(available, "source", "left").collect(), key=lambda r: r.source)  # one row per target, a configuration table
    names = [r.source for r in plan]
    tokens = np.array([r.n_tokens or 0 for r in plan], np.int64)
    blocks = -(-tokens // block_tokens)
    totals = slot_totals(np.array([r.target_share for r in plan], float), blocks, tokens, np.array([r.max_repeats for r in plan], np.int64), block_tokens, total_tokens)
    n_slots = int(totals.sum())
    weights = totals / n_slots if n_slots else totals
    n_shards = -(-n_slots // shard_blocks)
    in_shard = lambda shard: min(shard_blocks, n_slots - shard * shard_blocks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(s, i, int(n)) for s in batch["id"] for i, n in enumerate(np.bincount(_draw(s, in_shard(s), weights, seed), minlength=len(names)))], columns=["shard", "s", "n"])

    tasks = max(1, min(n_shards, 4096))
    counts = cut(spark.range(0, n_shards, 1, tasks).mapInPandas(count, "shard long, s int, n long"))
    counts = counts.withColumn("chunk", F.expr(f"shard div {PARTS}"))
    chunks = counts.groupBy("s", "chunk").agg(F.sum("n").alias("chunk_n"))  # running sums of chunks first, so that no source's shards are held by one task
    before = chunks.select("s", "chunk", (F.sum("chunk_n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("chunk_n")).alias("chunk_base"))
    inside = F.sum("n").over(Window.partitionBy("s", "chunk").orderBy("shard")) - F.col("n")
    running = counts.withColumn("inside", inside).join(before, ["s", "chunk"]).select("shard", "s", (F.col("chunk_base") + F.col("inside")).alias("base"))
    bases = running.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "base"))), lambda x: x["base"]).alias("bases"))
    drawn = np.zeros(len(names), np.int64)
    for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect():  # one row per target
        drawn[r.s] = r.n
    over, under = np.maximum(drawn - totals, 0), np.maximum(totals - drawn, 0)
    over_at, under_at = np.cumsum(over) - over, np.cumsum(under)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, base in zip(batch["shard"], batch["bases"]):
                source = _draw(shard, in_shard(shard), weights, seed)
                ordinal = np.zeros(len(source), np.int64)
                for s in range(len(names)):
                    mine = source == s
                    ordinal[mine] = base[s] + np.arange(mine.sum())
                moved = ordinal >= totals[source]
                nth = over_at[source[moved]] + ordinal[moved] - totals[source[moved]]
                to = np.searchsorted(under_at, nth, side="right")
                source[moved] = to
                ordinal[moved] = drawn[to] + nth - (under_at[to] - under[to])
                block = np.zeros(len(source), np.int64)
                repeat = ordinal // np.maximum(blocks[source], 1)
                for s in np.unique(source):
                    for r in np.unique(repeat[source == s]):
                        mine = (source == s) & (repeat == r)
                        block[mine] = block_permutation(ordinal[mine] % blocks[s], int(blocks[s]), seed * 1_000_003 + int(s) * 1009 + int(r))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(source)), "source": np.array(names, object)[source], "block": block, "repeat": repeat})

    slots = bases.mapInPandas(place, "shard long, slot long, source string, block long, repeat long")
    targeted = encoded.join(wanted.select("source"), "source", "left_semi")
    return slots.join(token_blocks(targeted, block_tokens, seed), ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "ids", "n_tokens"), available


def share_report(mix: DataFrame, available: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and reached share of the tokens, tokens available and drawn, most uses of a block."""
    drawn = mix.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), (F.max("repeat") + 1).alias("most_uses"))
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    full = wanted.join(available, "source", "full").join(drawn, "source", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    all_drawn = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per source
    return full.select("source", "target_share", F.round(F.coalesce(F.col("drawn_tokens") / all_drawn, F.lit(0.0)), 6).alias("reached_share"), "max_repeats", number("most_uses"), number("n_documents"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("available_tokens"), number("drawn_tokens"))
