"""Sinks: upserts, copy-forward, partition replacement and purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_greatest(stored: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Stored and new rows by key, the one with the greatest ``by`` kept (new ones win ties)."""
    rest = [c for c in stored.columns if c not in keys and c != by]
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(by, "_new", *rest)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in stored.columns if c not in keys]).select(*stored.columns)


def copy_forward(old: DataFrame, old_files: DataFrame, new_files: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of files that are unchanged (path and content hash) in a new snapshot, moved to the new file ids; keys that exist already are left."""
    same = old_files.select(F.col("file_id").alias("old_file_id"), "path", "content_hash").join(new_files.select(F.col("file_id").alias("new_file_id"), F.col("snapshot_id").alias("new_snapshot_id"), "path", "content_hash"), ["path", "content_hash"])
    moved = old.join(same.select("old_file_id", "new_file_id", "new_snapshot_id"), old["file_id"] == F.col("old_file_id")).withColumns({"file_id": F.col("new_file_id"), "snapshot_id": F.col("new_snapshot_id")})
    return moved.select(*old.columns).join(existing.select("snapshot_id", key), ["snapshot_id", key], "left_anti").select(*old.columns)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write rows so that only the partitions they belong to are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def purge_partitions(spark: SparkSession, path: str, partition: str, values: list[str]) -> int:
    """Delete partitions and with them all rows under them; returns how many there were."""
    done = 0
    for value in values:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}")
        done += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return done


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
