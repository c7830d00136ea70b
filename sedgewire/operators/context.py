"""Packing context under a token budget, resolving names, finding concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Token budgets of the capsule modes.
BUDGETS = {"minimal": 4_000, "standard": 12_000, "strict": 24_000}


def pack(items: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, item, form, cost): greedy packing of each key's items in their order.

    items: key, rank, item, full, signature, summary, name - the costs of the
    forms an item can take, null where it has none. Each item takes the best
    form that still fits; one that fits in no form is left out and later,
    smaller ones may still go in, which a running sum cannot express. A key's
    items are folded in one row, so they should be few, as a context's are.
    """
    forms = ("full", "signature", "summary", "name")
    ordered = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "item", *forms))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<item:string,form:string,cost:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        picked = reduce(lambda later, f: F.when(x[f].isNotNull() & (acc["used"] + x[f] <= budget), F.struct(x["item"].alias("item"), F.lit(f).alias("form"), x[f].cast("long").alias("cost"))).otherwise(later), reversed(forms), F.lit(None).cast("struct<item:string,form:string,cost:bigint>"))
        return F.when(picked.isNull(), acc).otherwise(F.struct((acc["used"] + picked["cost"]).alias("used"), F.array_append(acc["out"], picked).alias("out")))

    folded = ordered.select(key, F.aggregate("xs", start, add)["out"].alias("out"))
    return folded.select(key, F.explode("out").alias("o")).select(key, "o.*")


def fit_lines(text: Column, budget: int) -> Column:
    """The whole lines from the start of a text whose token estimates fit a budget."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        cost = F.ceil((F.length(line) + 1) / 4).cast("long")
        fits = acc["open"] & (acc["used"] + cost <= budget)
        return F.when(fits, F.struct((acc["used"] + cost).alias("used"), F.lit(True).alias("open"), F.array_append(acc["out"], line).alias("out"))).otherwise(F.struct(acc["used"].alias("used"), F.lit(False).alias("open"), acc["out"].alias("out")))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, add)["out"], "\n")


def first_source_wins(sources: list[tuple[DataFrame, float]], key: str, score: str) -> DataFrame:
    """Union of scored results; a key keeps its score from the first source that has it, times that source's weight."""
    parts = [df.select(key, F.lit(i).alias("source"), (F.col(score) * w).alias(score)) for i, (df, w) in enumerate(sources)]
    w = Window.partitionBy(key).orderBy("source", F.desc(score))
    return reduce(DataFrame.unionByName, parts).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "source", score)
