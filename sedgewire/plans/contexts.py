"""Context packing, name resolution and concept search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import text as T
from sedgewire.operators import context as C
from sedgewire.operators import corpus
from sedgewire.plans.graphs import _E
from sedgewire.plans.homologs import _LATEST, latest_versions
from sedgewire.plans.registry import Registry
from sedgewire.plans.textual import _JACC, _TRI
from sedgewire.runtime import table

r = Registry()


def _file_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each file as items of a context, in order of line, with the costs of their forms."""
    cost = lambda c: F.ceil(F.length(c) / 4).cast("long")
    rows = corpus.versions(spark, sf_dir, "symbol_id", "file_id", "range_start_line", "signature", "summary", "body_source").join(table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name"), "symbol_id")
    return rows.select("file_id", F.struct("range_start_line", "symbol_version_id").alias("rank"), F.col("symbol_version_id").alias("item"), cost("body_source").alias("full"), cost("signature").alias("signature"), cost("summary").alias("summary"), cost("canonical_name").alias("name"))


@r.query()
def cap1_ctx1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's symbols packed into 600 tokens with degrading forms."""
    return C.pack(_file_items(spark, sf_dir), "file_id", 600)


@r.query()
def cap4_fit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select("body_hash", C.fit_lines(F.col("body_source"), 100).alias("part"))


@r.query(_E + ", k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM e) SELECT src AS target, dst AS dependency, b.signature, rank FROM k JOIN v b ON b.symbol_version_id = k.dst WHERE rank <= 20")
def cap3_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 dependencies of a target, as a capsule loads them."""
    w = Window.partitionBy("target").orderBy("dependency")
    e = corpus.call_edges(spark, sf_dir).select(F.col("src").alias("target"), F.col("dst").alias("dependency")).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20")
    return e.join(corpus.versions(spark, sf_dir, "signature").withColumnRenamed("symbol_version_id", "dependency"), "dependency").select("target", "dependency", "signature", "rank")


@r.query(f"WITH q AS (SELECT symbol_id, canonical_name, {_TRI.format('canonical_name')} AS t, {_TRI.format(chr(39) + 'token catalog' + chr(39))} AS u FROM symbols), s AS (SELECT symbol_id, canonical_name, {_JACC.format('t', 'u')} AS s FROM q) SELECT symbol_id, canonical_name, round(s, 6) AS similarity FROM s WHERE s >= 0.3 OR canonical_name ILIKE '%catalog%' ORDER BY round(s, 6) DESC, symbol_id LIMIT 20")
def rsv1_pln1_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols for a name, by trigram similarity or containment, best 20."""
    s = T.trigram_similarity(F.col("canonical_name"), F.lit("token catalog"))
    hit = table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name", s.alias("s")).where((F.col("s") >= 0.3) | F.col("canonical_name").ilike("%catalog%"))
    return hit.select("symbol_id", "canonical_name", F.round("s", 6).alias("similarity")).orderBy(F.desc("similarity"), "symbol_id").limit(20)


@r.query(
    "WITH s0 AS (SELECT symbol_id, 0 AS source, 1.0 AS score FROM symbols WHERE canonical_name ILIKE '%token%'), s1 AS (SELECT symbol_id, 1, 0.9 FROM symbols WHERE logical_namespace ILIKE '%token%'), s2 AS (SELECT DISTINCT symbol_id, 2, 0.7 FROM symbol_versions WHERE signature ILIKE '%token%'), u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) "
    "SELECT symbol_id, min(source)::BIGINT AS source, arg_min(score, source)::DOUBLE AS score FROM u GROUP BY 1"
)
def set3_fcn1_find_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept in names, else in namespaces, else in signatures."""
    symbols = table(spark, sf_dir, "symbols")
    one = lambda df: df.select("symbol_id").distinct().withColumn("score", F.lit(1.0))
    found = C.first_source_wins(
        [(one(symbols.where("canonical_name ilike '%token%'")), 1.0), (one(symbols.where("logical_namespace ilike '%token%'")), 0.9), (one(table(spark, sf_dir, "symbol_versions").where("signature ilike '%token%'")), 0.7)], "symbol_id", "score"
    )
    return found.withColumn("source", F.col("source").cast("long"))


@r.query("SELECT DISTINCT t.p AS path FROM (SELECT unnest(files) AS p FROM git_commits) t WHERE p IS NOT NULL AND p <> '' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.path = t.p)")
def pln2_existence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths named by commits that no snapshot has."""
    named = table(spark, sf_dir, "git_commits").select(F.explode("files").alias("path")).where("path is not null and path <> ''").distinct()
    return named.join(table(spark, sf_dir, "files").select("path"), "path", "left_anti")


@r.query(f"WITH {_LATEST} SELECT symbol_id, symbol_version_id, visibility FROM lv")
def sk_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(spark, sf_dir, "visibility").select("symbol_id", "symbol_version_id", "visibility")


@r.query(
    "WITH st AS (SELECT snapshot_id, lower(trim(index_status)) AS s, indexed_at, lag(lower(trim(index_status))) OVER (PARTITION BY snapshot_id ORDER BY indexed_at, index_status) AS p FROM (SELECT DISTINCT snapshot_id, index_status, indexed_at FROM snapshots)), ok(p, s) AS (VALUES ('pending', 'indexing'), ('indexing', 'complete'), ('indexing', 'partial'), ('indexing', 'failed'), ('partial', 'complete'), ('failed', 'indexing')) "
    "SELECT st.snapshot_id, st.p AS before, st.s AS after FROM st LEFT JOIN ok ON ok.p = st.p AND ok.s = st.s WHERE st.p IS NOT NULL AND st.p <> st.s AND ok.p IS NULL"
)
def txn1_transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of snapshots that the transition table does not allow."""
    allowed = spark.createDataFrame([("pending", "indexing"), ("indexing", "complete"), ("indexing", "partial"), ("indexing", "failed"), ("partial", "complete"), ("failed", "indexing")], "before string, after string")
    w = Window.partitionBy("snapshot_id").orderBy("indexed_at", "index_status")
    rows = table(spark, sf_dir, "snapshots").select("snapshot_id", "index_status", "indexed_at").distinct().withColumn("after", F.lower(F.trim("index_status")))
    steps = rows.select("snapshot_id", "after", F.lag("after").over(w).alias("before")).where("before is not null and before <> after")
    return steps.join(allowed, ["before", "after"], "left_anti").select("snapshot_id", "before", "after")


QUERIES, SQL = r.queries, r.sql
