"""Domain tables: cleaned symbol versions, the star join, call edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from sedgewire.functions import text as T
from sedgewire.operators.snapshots import latest_rows
from sedgewire.runtime import table


def _known(time: str) -> Column:
    return F.coalesce(time, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def versions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Symbol versions, one row per id, with one spelling of language; only the named columns besides the id."""
    columns = tuple(c for c in columns if c != "symbol_version_id")
    rows = table(spark, sf_dir, "symbol_versions").where("symbol_version_id is not null").select("symbol_version_id", *[T.language(F.col(c)).alias(c) if c == "language" else F.col(c) for c in columns])
    return rows.groupBy("symbol_version_id").agg(*[F.max(c).alias(c) for c in columns])


def timed_versions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``versions`` with their snapshot and its time t (the epoch if unknown), by which they follow one another."""
    times = snapshots(spark, sf_dir).select("snapshot_id", F.col("created_at").alias("t"))
    return versions(spark, sf_dir, "snapshot_id", *columns).join(times, "snapshot_id", "left").withColumn("t", _known("t"))


def in_time() -> WindowSpec:
    """The versions of a symbol, the earliest first."""
    return Window.partitionBy("symbol_id").orderBy("t", "snapshot_id", "symbol_version_id")


def body_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, a, b): distinct bodies of a symbol that follow one another in the order of their first appearance."""
    times = snapshots(spark, sf_dir).select("snapshot_id", F.col("created_at").alias("t"))
    rows = table(spark, sf_dir, "symbol_versions").select("symbol_id", "snapshot_id", "body_hash").join(bodies(spark, sf_dir).select("body_hash"), "body_hash", "left_semi").join(times, "snapshot_id", "left")
    first = rows.groupBy("symbol_id", F.col("body_hash").alias("b")).agg(F.min(F.struct(_known("t"), F.coalesce("snapshot_id", F.lit("")))).alias("f"))
    return first.select("symbol_id", F.lag("b").over(Window.partitionBy("symbol_id").orderBy("f", "b")).alias("a"), "b").where("a is not null")


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Files by their latest delivery."""
    return latest_rows(table(spark, sf_dir, "files").select("file_id", "loaded_at", *[T.language(F.col(c)).alias(c) if c == "language" else F.col(c) for c in columns if c != "file_id"]), "file_id", "loaded_at")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by their latest delivery, index_status in lower case and trimmed."""
    rows = table(spark, sf_dir, "snapshots").select("snapshot_id", "indexed_at", "repo_id", "branch", "parent_snapshot_id", "created_at", F.lower(F.trim("index_status")).alias("index_status"), "retained_until")
    return latest_rows(rows, "snapshot_id", "indexed_at")


def star(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Symbol versions with their symbol and file."""
    symbols = table(spark, sf_dir, "symbols").select("symbol_id", "repo_id", "stable_key", "canonical_name", "kind")
    return versions(spark, sf_dir, "symbol_id", "snapshot_id", "file_id", *columns).join(symbols, "symbol_id").join(files(spark, sf_dir, "path"), "file_id")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body_hash, body_source), one row per hash that has a text."""
    rows = table(spark, sf_dir, "symbol_versions").where("body_hash is not null and body_source is not null")
    return rows.groupBy("body_hash").agg(F.max("body_source").alias("body_source"))


CALL = r"([A-Za-z_][A-Za-z0-9_]*)\s*\("


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, src, dst): calls by name inside a snapshot, each name resolved to its greatest symbol version; no loops.

    Names are read once per distinct body and joined back by its hash.
    """
    named = versions(spark, sf_dir, "symbol_id", "snapshot_id", "body_hash").join(table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name"), "symbol_id")
    return calls_of(named.select("snapshot_id", "body_hash", F.col("symbol_version_id").alias("src")), named, bodies(spark, sf_dir))


def calls_of(sources: DataFrame, named: DataFrame, texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, src, dst): calls from ``sources`` (snapshot_id, body_hash, src) to ``named`` versions (snapshot_id, canonical_name, symbol_version_id); ``names``: a smaller table with the canonical_name of all these, if there is one."""
    calls = texts.select("body_hash", F.explode(F.array_distinct(F.regexp_extract_all("body_source", F.lit(CALL), F.lit(1)))).alias("callee"))
    targets = named.groupBy("snapshot_id", F.col("canonical_name").alias("callee")).agg(F.max("symbol_version_id").alias("dst"))
    used = calls.join((named if names is None else names).select(F.col("canonical_name").alias("callee")).distinct(), "callee", "left_semi")
    return sources.join(used, "body_hash").join(targets, ["snapshot_id", "callee"]).where("src <> dst").select("snapshot_id", "src", "dst").distinct()
