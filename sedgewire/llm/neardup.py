"""Near-duplicate texts by set similarity: token-combination prefixes, then exact verification."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.operators.components import connected_components
from sedgewire.runtime import CACHE_KEYS, store

#: Sets that one signature should stand for, were tokens independent; the longest combinations; signatures of a set beyond which they are shorter.
POSTING, LONGEST, MOST_SIGNATURES = 8, 4, 10_000
_WORD = re.compile(r"[A-Za-z0-9_]+").findall


def word_set(text: str) -> list[int]:
    """Sorted 64-bit hashes of the distinct words of a text (runs of ASCII letters, digits, underscores, in lower case)."""
    return sorted(xxhash.xxh64_intdigest(w) - (1 << 63) for w in {w.lower() for w in _WORD(text)})


def word_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): one row per key that has a text with at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            keys, sets = [], []
            texts = batch.column(text)
            for i, k in enumerate(batch.column(key).to_pylist()):
                if k is None or k in met:
                    continue
                value = texts[i].as_py()
                if value is None:
                    continue
                if len(met) >= 50 * CACHE_KEYS:
                    met.clear()  # repeats are dropped again below
                met.add(k)
                words = word_set(value)
                if words:
                    keys.append(k)
                    sets.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "words"])

    found = rows.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, "key string, words array<bigint>")
    return found.dropDuplicates(["key"])


def longest_combination(n: int, threshold: float, longest: int = LONGEST, most: int = MOST_SIGNATURES) -> int:
    """The longest combinations with which a set of n tokens has at most ``most`` signatures; 1 if none."""
    o = max(1, math.ceil(threshold * n - 1e-9))
    return next((k for k in range(longest, 1, -1) if math.comb(n - o + k, k) <= most), 1)


def prefix_signatures(tokens: list[int], df: list[int], threshold: float, classes: tuple[int, ...], most: int = MOST_SIGNATURES) -> list[int]:
    """Signatures of a set whose tokens are in ascending order of frequency.

    With o the least overlap of a set of n tokens with any similar one, the
    i-th token two similar sets share is among the first n - o + i of either.
    Tokens before the first shared one are not shared, and none after it is
    rarer. So the first shared token, if rare, is itself a common signature,
    else it makes one with the next k - 1 shared ones, k being the number its
    class asks for. Sets that may share fewer than k tokens give their shorter
    combinations too.

    Combinations are the shorter the larger a set, so that none has very many.
    The smaller of two sets decides for both: a set has the signatures by its
    own rule and by those of the smaller sizes that can be similar to it.
    """
    n = len(tokens)
    o = max(1, math.ceil(threshold * n - 1e-9))
    out: list[int] = []
    for rule in range(longest_combination(n, threshold, len(classes) + 1, most), longest_combination(o, threshold, len(classes) + 1, most) + 1):
        for i in range(n - o + 1):
            if df[i] < 2:
                continue
            k = 1 + bisect_left(classes, df[i], 0, rule - 1)
            for size in range(min(k, o), k + 1):
                if i + size <= n:
                    first = tokens[i]
                    out += [hash((rule, first, *rest)) for rest in combinations(tokens[i + 1 : n - o + size], size - 1)] if size > 1 else [hash((rule, first))]
    return out


def token_classes(n_sets: int, posting: int = POSTING, longest: int = LONGEST) -> tuple[int, ...]:
    """Greatest frequencies of tokens indexed alone, in pairs, in triples, ...

    k tokens that are each in f of n sets are together in f^k / n^(k-1) of them
    if independent; the class's bound is the f for which that is ``posting``.
    """
    return tuple(max(posting, int((posting * max(n_sets, 1) ** (k - 1)) ** (1 / k))) for k in range(1, longest))


def similar_sets(sets: DataFrame, threshold: float = 0.8, classes: tuple[int, ...] | None = None, most: int = MOST_SIGNATURES) -> DataFrame:
    """(id_a, id_b, overlap, similarity) of all pairs of distinct sets with Jaccard similarity >= threshold.

    ``sets``: id (bigint, unique), words (array<bigint>, distinct). Exact: the
    signatures lose no pair and every candidate is verified on the whole sets.
    """
    classes = classes or token_classes(sets.count())
    tokens = sets.select("id", F.explode("words").alias("w"))
    frequency = tokens.groupBy("w").agg(F.count("*").alias("df"))
    ordered = tokens.join(frequency, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("t")).select("id", "t.w", "t.df")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids, sizes = [], [], []
            for k, w, df in zip(batch.column("id").to_pylist(), batch.column("w").to_pylist(), batch.column("df").to_pylist()):
                found = prefix_signatures(w, df, threshold, classes, most)
                sigs += found
                ids += [k] * len(found)
                sizes += [len(w)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())], names=["sig", "id", "n"])

    index = store(ordered.mapInArrow(sign, "sig bigint, id bigint, n int"))
    a, b = index.select("sig", F.col("id").alias("id_a"), F.col("n").alias("n_a")), index.select("sig", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    fits = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    candidates = a.join(b, "sig").where((F.col("id_a") < F.col("id_b")) & fits).select("id_a", "id_b").distinct()
    side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("words").alias(f"w_{x}"))
    overlap = F.size(F.array_intersect("w_a", "w_b"))
    checked = candidates.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", overlap.cast("long").alias("overlap"), (F.size("w_a") + F.size("w_b")).cast("long").alias("both"))
    return checked.withColumn("similarity", F.col("overlap") / (F.col("both") - F.col("overlap"))).where(F.col("similarity") >= threshold).select("id_a", "id_b", "overlap", "similarity")


def near_duplicates(rows: DataFrame, key: str, text: str, threshold: float = 0.8, classes: tuple[int, ...] | None = None, most: int = MOST_SIGNATURES) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts of ``rows``.

    members: key, id - texts with the same words have one id (a 64-bit hash of
    the set). links: id_a, id_b, overlap, similarity between different ids.
    Null keys and texts, and texts without a word, have no row; one key counts
    once however often it occurs; an empty table gives empty results; other
    columns are not read.
    """
    members = store(word_sets(rows, key, text).select("key", F.xxhash64("words").alias("id"), "words"))
    sets = members.select("id", "words").dropDuplicates(["id"])
    return members.select("key", "id"), similar_sets(sets, threshold, classes, most)


def pairs_of_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b, similarity), smaller key first: links and equal sets expanded to keys."""
    a, b = members.select(F.col("key").alias("x"), F.col("id").alias("id_a")), members.select(F.col("key").alias("y"), F.col("id").alias("id_b"))
    across = links.join(a, "id_a").join(b, "id_b").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity")
    same = a.join(b, F.col("id_a") == F.col("id_b")).where("x < y").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def groups_of_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group_id, n_links): the group is named by its smallest key; n_links counts links to other word sets."""
    links = store(links.select("id_a", "id_b"))
    parts = connected_components(links, "id_a", "id_b")
    degree = links.select(F.col("id_a").alias("id")).union(links.select("id_b")).groupBy("id").agg(F.count("*").alias("n"))
    placed = members.join(parts.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left").select("key", F.coalesce("component", "id").alias("c"), F.coalesce("n", F.lit(0)).alias("n_links"))
    names = placed.groupBy("c").agg(F.min("key").alias("group_id"))
    return placed.join(names, "c").select("key", "group_id", "n_links")
