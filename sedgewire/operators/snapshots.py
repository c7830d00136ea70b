"""Change events between consecutive full snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per non-null key: the one with the greatest ``version`` (ties: the greatest row)."""
    rest = [c for c in df.columns if c != key]
    pick = F.max(F.struct(version, *[c for c in rest if c != version])).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def snapshot_order(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Complete snapshots that have files, numbered within (repo_id, branch).

    Returns snapshot_id, line (repository and branch as one key), seq (from 1)
    and next_snapshot_id (null for the newest one). A snapshot counts once,
    by its latest delivery; ties in created_at are ordered by snapshot_id.
    """
    one = latest_rows(snapshots.select("snapshot_id", "repo_id", "branch", "created_at", "index_status", "indexed_at"), "snapshot_id", "indexed_at")
    loaded = files.select("snapshot_id").where(F.col("snapshot_id").isNotNull()).distinct()
    line = Window.partitionBy("repo_id", "branch").orderBy("created_at", "snapshot_id")
    return (
        one.where(_norm(F.col("index_status")) == "complete")
        .join(loaded, "snapshot_id", "left_semi")
        .select(
            "snapshot_id",
            F.struct("repo_id", "branch").alias("line"),
            F.row_number().over(line).alias("seq"),
            F.lead("snapshot_id").over(line).alias("next_snapshot_id"),
        )
    )


def validity_intervals(states: DataFrame) -> DataFrame:
    """Islands of unchanged state: one row per run of consecutive snapshots with the same row hash.

    ``states`` has line, record_type, record_key, seq, hash, version,
    snapshot_id, next_snapshot_id. Several deliveries of one record in one
    snapshot count once, by the greatest version. All steps after the single
    shuffle on (line, record_key) keep its partitioning.
    """
    keys = ["line", "record_type", "record_key"]
    rows = (
        states.repartition("line", "record_key")
        .groupBy(*keys, "seq")
        .agg(F.max(F.struct("version", "hash")).alias("v"), F.min("snapshot_id").alias("snapshot_id"), F.min("next_snapshot_id").alias("next_snapshot_id"))
        .select(*keys, "seq", F.col("v.hash").alias("hash"), "snapshot_id", "next_snapshot_id")
    )
    w = Window.partitionBy(*keys).orderBy("seq")
    begins = ~F.coalesce((F.lag("seq").over(w) == F.col("seq") - 1) & F.lag("hash").over(w).eqNullSafe(F.col("hash")), F.lit(False))
    numbered = rows.withColumn("first", begins.cast("int")).withColumn("island", F.sum("first").over(w))
    return numbered.groupBy(*keys, "island").agg(
        F.min("seq").alias("start_seq"),
        F.max("seq").alias("end_seq"),
        F.min(F.struct("seq", "snapshot_id")).getField("snapshot_id").alias("start_snapshot_id"),
        F.max(F.struct("seq", "snapshot_id")).getField("snapshot_id").alias("end_snapshot_id"),
        F.max(F.struct("seq", "next_snapshot_id")).getField("next_snapshot_id").alias("after_snapshot_id"),
        F.min("hash").alias("hash"),
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """Events from interval starts (added), ends (removed) and adjacencies (changed)."""
    w = Window.partitionBy("line", "record_type", "record_key").orderBy("start_seq")
    near = intervals.select(
        "*",
        F.lag("end_seq").over(w).alias("prev_end"),
        F.lag("hash").over(w).alias("prev_hash"),
        F.lead("start_seq").over(w).alias("next_start"),
    )
    follows = F.coalesce(F.col("prev_end") == F.col("start_seq") - 1, F.lit(False))
    added = (F.col("start_seq") > 1) & ~follows
    changed = follows & F.coalesce(F.col("prev_hash") != F.col("hash"), F.lit(False))
    removed = F.col("after_snapshot_id").isNotNull() & ~F.coalesce(F.col("next_start") == F.col("end_seq") + 1, F.lit(False))
    event = lambda when, at, kind: F.when(when, F.struct(F.col(at).alias("snapshot_id"), F.lit(kind).alias("change_kind")))
    events = F.filter(
        F.array(event(added, "start_snapshot_id", "added"), event(changed, "start_snapshot_id", "changed"), event(removed, "after_snapshot_id", "removed")),
        lambda x: x.isNotNull(),
    )
    return near.select("record_type", "record_key", F.explode(events).alias("e")).select("e.snapshot_id", "record_type", "record_key", "e.change_kind")


def record_states(snapshots: DataFrame, files: DataFrame, symbol_versions: DataFrame) -> DataFrame:
    """Files and symbols of the ordered snapshots as (record, seq, hash) rows."""
    order = snapshot_order(snapshots, files)
    as_record = lambda df, kind, key, digest, version: df.where(F.col(key).isNotNull()).select(
        "snapshot_id", F.lit(kind).alias("record_type"), F.col(key).alias("record_key"), _norm(F.col(digest)).alias("hash"), version.alias("version")
    )
    records = as_record(files, "file", "path", "content_hash", F.col("loaded_at")).unionByName(
        as_record(symbol_versions, "symbol", "symbol_id", "body_hash", F.lit(None).cast("timestamp_ntz"))
    )
    return records.join(order, "snapshot_id")


def snapshot_changes(snapshots: DataFrame, files: DataFrame, symbol_versions: DataFrame) -> DataFrame:
    """Records added, removed or changed in each snapshot since the one before it.

    Returns snapshot_id (the later one), record_type, record_key, change_kind.
    Null keys are left out; a null hash on either side is no change; the first
    snapshot of a branch has no rows; empty tables give no rows; other columns
    of the inputs are not read.
    """
    return change_events(validity_intervals(record_states(snapshots, files, symbol_versions)))
