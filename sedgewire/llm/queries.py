"""Queries of the text problems over the project's tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm.cooccurrence import cooccurring
from sedgewire.llm.bpe import decode_column, encode_column
from sedgewire.llm.credentials import find_credentials, redact_bodies
from sedgewire.llm.mixing import mix_sources, share_report
from sedgewire.llm.neardup import groups_of_keys, near_duplicates, pairs_of_keys
from sedgewire.llm.parsing import acceptance, check_files
from sedgewire.llm.provenance import label_files
from sedgewire.llm.residue import find_residue, without_residue
from sedgewire.runtime import table


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(table(spark, sf_dir, "symbol_versions"), "symbol_version_id", "symbol_id", "body_hash", "body_source")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credentials(spark, sf_dir).select(F.col("row_id").alias("symbol_version_id"), "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = redact_bodies(table(spark, sf_dir, "symbol_versions"), _credentials(spark, sf_dir), "symbol_version_id", "body_source")
    return bodies.select(F.col("row_id").alias("symbol_version_id"), F.col("redacted").alias("body_source"))


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(table(spark, sf_dir, "file_texts"), table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_errors(spark, sf_dir).where("not valid").select("file_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance(p3_errors(spark, sf_dir), table(spark, sf_dir, "files"), table(spark, sf_dir, "snapshots"))


#: Least similarity of bodies that TESTDATA.md asks for.
BODY_SIMILARITY = 0.7


def _similar_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, sf_dir, "symbol_versions"), "body_hash", "body_source", BODY_SIMILARITY)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_keys(*_similar_bodies(spark, sf_dir)).select(F.col("key_a").alias("body_hash_a"), F.col("key_b").alias("body_hash_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of_keys(*_similar_bodies(spark, sf_dir)).select(F.col("key").alias("body_hash"), "group_id", "n_links")


def _cochanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "git_commits").where("is_merge is not true")
    return cooccurring(commits, "repo_id", "hash", "files")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cochanges(spark, sf_dir).select("repo_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p6_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cochanges(spark, sf_dir).withColumnsRenamed({"item_a": "path_a", "item_b": "path_b"})


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "symbol_versions"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_labels(spark, sf_dir).where("label <> 'handwritten'").select("file_id").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(p8_ids(spark, sf_dir), "ids", ["doc_id"])


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return share_report(*mix_sources(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_lift": p6_lift, "p7_found": p7_found, "p7_labels": p7_labels, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_shares": p9_shares, "p9_mix": p9_mix, "p10_found": p10_found, "p10_kinds": p10_kinds, "p10_clean": p10_clean}

_BASKETS = """
WITH x AS (SELECT DISTINCT repo_id, hash, p FROM (SELECT repo_id, hash, unnest(files) AS p FROM git_commits WHERE is_merge IS NOT TRUE AND repo_id IS NOT NULL AND hash IS NOT NULL) WHERE p IS NOT NULL AND p <> ''),
n AS (SELECT repo_id, count(DISTINCT hash) AS n FROM x GROUP BY 1),
m AS (SELECT repo_id, p, count(*) AS a FROM x GROUP BY 1, 2),
c AS (SELECT u.repo_id, u.p AS path_a, v.p AS path_b, count(*) AS c FROM x u JOIN x v ON u.repo_id = v.repo_id AND u.hash = v.hash AND u.p < v.p GROUP BY 1, 2, 3 HAVING count(*) >= 5),
f AS (SELECT c.*, ma.a, mb.a AS b, n.n FROM c JOIN n USING (repo_id) JOIN m ma ON ma.repo_id = c.repo_id AND ma.p = path_a JOIN m mb ON mb.repo_id = c.repo_id AND mb.p = path_b WHERE c.c * n.n >= 3 * ma.a * mb.a)
"""

_BODIES = """
WITH RECURSIVE b AS (SELECT body_hash, list_sort(list_distinct(regexp_extract_all(lower(any_value(body_source)), '[a-z0-9_]+'))) AS w FROM symbol_versions WHERE body_hash IS NOT NULL AND body_source IS NOT NULL GROUP BY 1),
k AS (SELECT * FROM b WHERE len(w) > 0),
t AS (SELECT body_hash, len(w) AS n, unnest(w) AS x FROM k),
p AS (SELECT u.body_hash AS body_hash_a, v.body_hash AS body_hash_b FROM t u JOIN t v ON u.x = v.x AND u.body_hash < v.body_hash GROUP BY 1, 2, u.n, v.n HAVING count(*) / (u.n + v.n - count(*))::DOUBLE >= 0.7)
"""

SQL = {
    "p4_found": _BODIES + "SELECT * FROM p",
    "p4_groups": _BODIES
    + """,
e AS (SELECT body_hash_a AS x, body_hash_b AS y FROM p UNION ALL SELECT body_hash_b, body_hash_a FROM p),
r AS (SELECT body_hash AS x, body_hash AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
l AS (SELECT e.x, count(DISTINCT kb.w) AS n FROM e JOIN k ka ON ka.body_hash = e.x JOIN k kb ON kb.body_hash = e.y WHERE ka.w <> kb.w GROUP BY 1)
SELECT r.x AS body_hash, min(r.y) AS group_id, coalesce(max(l.n), 0) AS n_links FROM r LEFT JOIN l ON l.x = r.x GROUP BY 1
""",
    "p6_found": _BASKETS + "SELECT repo_id, path_a, path_b FROM f",
    "p6_lift": _BASKETS + "SELECT repo_id, path_a, path_b, c AS together, a AS count_a, b AS count_b, n AS n_baskets, round(c * n / (a * b)::DOUBLE, 6) AS lift FROM f",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
