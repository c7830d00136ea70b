"""Queries of the general dealt problems: snapshot changes and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.operators.hierarchy import descendants, hierarchy
from sedgewire.operators.snapshots import latest_rows, record_states, snapshot_changes, validity_intervals
from sedgewire.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "files"), table(spark, sf_dir, "symbol_versions"))


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals (first and last snapshot of each unchanged run) behind p2_found."""
    states = record_states(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "files"), table(spark, sf_dir, "symbol_versions"))
    return validity_intervals(states).select(
        F.col("line.repo_id").alias("repo_id"), F.col("line.branch").alias("branch"), "record_type", "record_key", "hash", "start_snapshot_id", "end_snapshot_id", F.col("start_seq").cast("long").alias("start_seq"), F.col("end_seq").cast("long").alias("end_seq")
    )


def _snapshot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "snapshots").select("snapshot_id", "parent_snapshot_id", "indexed_at"), "snapshot_id", "indexed_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(_snapshot_links(spark, sf_dir), "snapshot_id", "parent_snapshot_id")
    return tree.select(F.col("node").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(_snapshot_links(spark, sf_dir), "snapshot_id", "parent_snapshot_id", with_path=True)
    return tree.select(F.col("node").alias("snapshot_id"), F.array_join("path", "/").alias("path"), "on_cycle")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(_snapshot_links(spark, sf_dir), "snapshot_id", "parent_snapshot_id", with_path=True)
    return descendants(tree).select(F.col("node").alias("snapshot_id"), F.col("descendant").alias("descendant_snapshot_id"), "distance")


_STATES = """
WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY indexed_at DESC NULLS LAST, index_status DESC) rn FROM snapshots WHERE snapshot_id IS NOT NULL) WHERE rn = 1),
ord AS (SELECT snapshot_id, repo_id, branch, row_number() OVER (PARTITION BY repo_id, branch ORDER BY created_at, snapshot_id) seq,
               lead(snapshot_id) OVER (PARTITION BY repo_id, branch ORDER BY created_at, snapshot_id) nxt
        FROM one WHERE lower(trim(index_status)) = 'complete' AND snapshot_id IN (SELECT snapshot_id FROM files)),
f AS (SELECT snapshot_id, path AS record_key, max_by(lower(trim(content_hash)), loaded_at) AS h FROM
        (SELECT snapshot_id, path, coalesce(content_hash, '') AS content_hash, loaded_at FROM files) GROUP BY 1, 2),
rec AS (SELECT snapshot_id, 'file' AS record_type, record_key, nullif(h, '') AS h FROM f
        UNION ALL SELECT snapshot_id, 'symbol', symbol_id, max(lower(trim(body_hash))) FROM symbol_versions GROUP BY 1, 3),
st AS (SELECT o.*, r.record_type, r.record_key, r.h FROM rec r JOIN ord o USING (snapshot_id))
"""

_LINKS = """
WITH RECURSIVE one AS (SELECT snapshot_id, parent_snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY indexed_at DESC NULLS LAST, parent_snapshot_id DESC NULLS LAST) rn FROM snapshots WHERE snapshot_id IS NOT NULL) WHERE rn = 1),
link AS (SELECT a.snapshot_id, b.snapshot_id AS parent FROM one a LEFT JOIN one b ON a.parent_snapshot_id = b.snapshot_id),
down AS (SELECT snapshot_id, snapshot_id AS root, 0::BIGINT AS depth, snapshot_id AS path FROM link WHERE parent IS NULL
         UNION ALL SELECT l.snapshot_id, d.root, d.depth + 1, d.path || '/' || l.snapshot_id FROM link l JOIN down d ON l.parent = d.snapshot_id)
"""

SQL = {
    "p2_found": _STATES
    + """
SELECT snapshot_id, record_type, record_key, 'added' AS change_kind FROM st a WHERE seq > 1 AND NOT EXISTS
    (SELECT 1 FROM st b WHERE b.repo_id IS NOT DISTINCT FROM a.repo_id AND b.branch IS NOT DISTINCT FROM a.branch AND b.record_type = a.record_type AND b.record_key = a.record_key AND b.seq = a.seq - 1)
UNION ALL SELECT a.nxt, record_type, record_key, 'removed' FROM st a WHERE nxt IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM st b WHERE b.repo_id IS NOT DISTINCT FROM a.repo_id AND b.branch IS NOT DISTINCT FROM a.branch AND b.record_type = a.record_type AND b.record_key = a.record_key AND b.seq = a.seq + 1)
UNION ALL SELECT a.snapshot_id, a.record_type, a.record_key, 'changed' FROM st a JOIN st b ON b.repo_id IS NOT DISTINCT FROM a.repo_id AND b.branch IS NOT DISTINCT FROM a.branch AND b.record_type = a.record_type AND b.record_key = a.record_key AND b.seq = a.seq - 1 WHERE a.h <> b.h
""",
    "p2_intervals": _STATES
    + """,
g AS (SELECT *, seq - row_number() OVER (PARTITION BY repo_id, branch, record_type, record_key, h ORDER BY seq) grp FROM st)
SELECT repo_id, branch, record_type, record_key, h AS hash, min_by(snapshot_id, seq) AS start_snapshot_id, max_by(snapshot_id, seq) AS end_snapshot_id, min(seq)::BIGINT AS start_seq, max(seq)::BIGINT AS end_seq
FROM g GROUP BY repo_id, branch, record_type, record_key, h, grp
""",
    "p5_found": _LINKS
    + """,
stuck AS (SELECT snapshot_id, parent FROM link WHERE snapshot_id NOT IN (SELECT snapshot_id FROM down)),
reach AS (SELECT snapshot_id, parent AS at FROM stuck UNION SELECT r.snapshot_id, s.parent FROM reach r JOIN stuck s ON r.at = s.snapshot_id)
SELECT snapshot_id, root AS root_snapshot_id, depth FROM down
UNION ALL SELECT r.snapshot_id, min(r.at), -1 FROM reach r JOIN reach c ON c.snapshot_id = r.at AND c.at = r.at GROUP BY r.snapshot_id
""",
    "p5_paths": _LINKS + "SELECT l.snapshot_id, d.path, d.snapshot_id IS NULL AS on_cycle FROM link l LEFT JOIN down d USING (snapshot_id)",
    "p5_descendants": _LINKS
    + """,
anc AS (SELECT snapshot_id AS s, parent AS a, 1::BIGINT AS distance FROM link WHERE parent IS NOT NULL AND snapshot_id IN (SELECT snapshot_id FROM down)
        UNION ALL SELECT s, l.parent, distance + 1 FROM anc JOIN link l ON l.snapshot_id = anc.a WHERE l.parent IS NOT NULL)
SELECT a AS snapshot_id, s AS descendant_snapshot_id, distance FROM anc
""",
}

QUERIES = {"p2_found": p2_found, "p2_intervals": p2_intervals, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}
