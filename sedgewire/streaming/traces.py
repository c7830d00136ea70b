"""Runtime evidence from observed call edges, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share a repeated observation adds, and the most of it.
STEP, MOST = 0.03, 0.10


def observed_confidence(both_resolved: Column, n: Column) -> Column:
    """0.90 if both ends are known, else 0.60, and up to 0.10 more for repeated observation."""
    return F.round(F.when(both_resolved, 0.90).otherwise(0.60) + F.least(F.lit(MOST), F.lit(STEP) * F.log10(n)), 6)


def consecutive(events: DataFrame) -> DataFrame:
    """(caller, callee, at, weight): each event of a user with the one before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select("user_id", F.lag("event_type").over(w).alias("caller"), F.col("event_type").alias("callee"), F.col("ts").alias("at"), F.col("value").alias("weight"))
    return pairs.where("caller is not null")


def merge_observed(static: DataFrame, observed: DataFrame) -> DataFrame:
    """(caller, callee, confidence, origin): static edges seen at run time gain 0.15, unseen ones stay, new ones come in at 0.85 and more."""
    s = static.select("caller", "callee", F.col("confidence").alias("s"))
    o = observed.select("caller", "callee", "n")
    new = F.least(F.lit(1.0), 0.85 + 0.05 * F.log10("n"))
    both = s.join(o, ["caller", "callee"], "full")
    return both.select(
        "caller", "callee", F.round(F.when(F.col("s").isNull(), new).when(F.col("n").isNull(), F.col("s")).otherwise(F.least(F.lit(1.0), F.col("s") + 0.15)), 6).alias("confidence"), F.when(F.col("s").isNull(), "observed").when(F.col("n").isNull(), "static").otherwise("confirmed").alias("origin")
    )


def evidence_boost(n_sources: Column) -> Column:
    return F.least(F.lit(0.30), 0.15 * F.least(n_sources, F.lit(3)))


def stream_counts(spark: SparkSession, folder: str, schema: str, output: str, checkpoint: str) -> None:
    """Read trace files from a folder as they come and keep counts per edge: each micro-batch adds its partial counts.

    A batch's counts are written under its number, so a batch that runs twice
    after a failure replaces its own rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("caller", "callee").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
