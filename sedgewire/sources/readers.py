"""Sources: file trees, exported commit logs, trace files, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.operators.temporal import parse_git_log

# Folders that are not searched, languages by extension, and the size above which a file is left alone.
SKIPPED = "node_modules .git dist build coverage vendor __pycache__ .venv venv target .next .cache".split()
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "go": "go", "rs": "rust", "cs": "csharp", "rb": "ruby", "cpp": "cpp", "c": "c", "h": "c", "kt": "kotlin", "swift": "swift", "php": "php", "sh": "bash"}
MOST_BYTES = 5 * 1024 * 1024
TRACE_SCHEMA = "source string, timestamp timestamp, call_edges array<struct<caller_key:string,callee_key:string,receiver_type:string,call_count:int>>, dynamic_routes array<struct<route:string,handler_key:string>>, observed_types array<struct<key:string,type:string>>, framework_events array<struct<event_type:string,target_key:string>>"


def language_of_extension(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, length, content_hash, text) of the source files under a folder, skipped folders and large files left out."""
    skip = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = found.where((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(skip)).withColumn("language", language_of_extension(F.col("path"))).where("language is not null")
    return kept.select("path", "language", "length", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits and their files from exported log files, one log per file, in order of line."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return parse_git_log(texts)


def read_traces(spark: SparkSession, path: str, most_edges: int = 50_000, most_other: int = 10_000) -> DataFrame:
    """Trace packs from JSON files by a stated schema; the arrays are cut to the numbers the format allows."""
    packs = spark.read.schema(TRACE_SCHEMA).json(path)
    cut = lambda c, n: F.slice(F.col(c), 1, n).alias(c)
    return packs.select("source", "timestamp", cut("call_edges", most_edges), cut("dynamic_routes", most_other // 2), cut("observed_types", most_other), cut("framework_events", most_other))


def keyset_page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next ``size`` rows after a key, and one more that tells whether there are others."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(size + 1)
