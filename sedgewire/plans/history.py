"""Change history over git_commits, with the baskets of lineitem as a second source of co-changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.operators import temporal as H
from sedgewire.plans.registry import Registry
from sedgewire.runtime import table

r = Registry()
AS_OF = "2026-01-01 00:00:00"
_DATE = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

_COMMITS = (
    "c AS (SELECT repo_id AS g, hash AS c, max(commit_date) AS date, max(author_email) AS author, max(subject) AS subject, bool_or(coalesce(is_merge, FALSE)) AS merge FROM git_commits WHERE repo_id IS NOT NULL AND hash IS NOT NULL GROUP BY 1, 2), "
    "t AS (SELECT DISTINCT repo_id AS g, hash AS c, x AS file FROM (SELECT repo_id, hash, unnest(files) AS x FROM git_commits) WHERE x IS NOT NULL AND x <> '' AND repo_id IS NOT NULL AND hash IS NOT NULL), "
    "ch AS (SELECT t.g, t.file, t.c, c.date, c.author, coalesce(regexp_matches(c.subject, '(?i)\\bfix(?:e[sd])?\\b|\\bbug\\b|\\bpatch\\b|\\bhotfix\\b|\\bresolve[sd]?\\b|\\bclose[sd]?\\s+#\\d+|\\bregression\\b'), FALSE) AS is_fix, coalesce(regexp_matches(c.subject, '(?i)^revert\\b'), FALSE) AS is_revert, c.merge FROM t JOIN c USING (g, c))"
)
_PAIRS = (
    "it AS (SELECT g, c, file, row_number() OVER (PARTITION BY g, c ORDER BY file) AS rn FROM ch WHERE NOT merge), fw AS (SELECT * FROM it), "
    "pr AS (SELECT x.g, x.file AS a, y.file AS b, count(*) AS n, min(c.date) AS d0, max(c.date) AS d1 FROM fw x JOIN fw y ON x.g = y.g AND x.c = y.c AND x.file < y.file JOIN c ON c.g = x.g AND c.c = x.c GROUP BY 1, 2, 3 HAVING count(*) >= 2), "
    "tt AS (SELECT g, file, count(*) AS t FROM it GROUP BY 1, 2), pj AS (SELECT pr.*, ta.t AS n_a, tb.t AS n_b, n / (ta.t + tb.t - n)::DOUBLE AS j FROM pr JOIN tt ta ON ta.g = pr.g AND ta.file = a JOIN tt tb ON tb.g = pr.g AND tb.file = b)"
)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "git_commits").where("repo_id is not null and hash is not null")
    return rows.groupBy(F.col("repo_id").alias("g"), F.col("hash").alias("c")).agg(F.max("commit_date").alias("date"), F.max("author_email").alias("author"), F.max("subject").alias("subject"), F.bool_or(F.coalesce("is_merge", F.lit(False))).alias("merge"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.touched(table(spark, sf_dir, "git_commits")).join(H.classify(_commits(spark, sf_dir)), ["g", "c"])


def changed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _changes(spark, sf_dir).where("not merge")
    return H.co_changes(kept.select("g", "c", "file"), kept.select("g", "c", "date").distinct())


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@r.query(f"WITH {_COMMITS} SELECT g AS repo_id, c AS hash, file, {_DATE.format('date')} AS date, author FROM ch")
def tmp1_src6_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits written as log lines and parsed back, one log per commit."""
    one = _commits(spark, sf_dir).join(H.touched(table(spark, sf_dir, "git_commits")).groupBy("g", "c").agg(F.array_sort(F.collect_set("file")).alias("files")), ["g", "c"])
    head = F.concat_ws("|", "c", F.lit("name"), F.coalesce("author", F.lit("")), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.coalesce("subject", F.lit("")))
    lines = one.select(F.col("g").alias("source_repo"), F.concat_ws("/", "g", "c").alias("source"), F.posexplode(F.concat(F.array(head), F.array(F.lit("")), F.col("files"))).alias("at", "line"))
    parsed = H.parse_git_log(lines)
    return parsed.select(F.substring_index("source", "/", 1).alias("repo_id"), "hash", "file", "date", F.nullif(F.col("author_email"), F.lit("")).alias("author"))


@r.query(f"WITH {_COMMITS}, {_PAIRS} SELECT g AS repo_id, a, b, n, n_a, n_b, round(j, 6) AS jaccard, {_DATE.format('d0')} AS first_date, {_DATE.format('d1')} AS last_date FROM pj")
def tmp2_co_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_pairs(spark, sf_dir).select(F.col("g").alias("repo_id"), "a", "b", "n", "n_a", "n_b", F.round("jaccard", 6).alias("jaccard"), _day("first_date"), _day("last_date"))


@r.query(f"WITH {_COMMITS}, {_PAIRS}, k AS (SELECT g, a, b, round(j, 3) AS confidence FROM pj WHERE j >= 0.25) SELECT g AS repo_id, a AS src, b AS dst, confidence FROM k UNION ALL SELECT g, b, a, confidence FROM k")
def tmp3_co_change_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.co_change_edges(changed_pairs(spark, sf_dir)).withColumnRenamed("g", "repo_id")


@r.query(
    f"WITH {_COMMITS}, fx AS (SELECT g, file, date, lag(date) OVER (PARTITION BY g, file ORDER BY date, c) AS before FROM ch WHERE is_fix), ag AS (SELECT g, file, count(*) AS again FROM fx WHERE date <= before + INTERVAL 30 DAY GROUP BY 1, 2), "
    f"p AS (SELECT g, file, count(*) AS changes, count(*) FILTER (WHERE is_fix) AS fixes, count(*) FILTER (WHERE is_revert) AS rv, count(*) FILTER (WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, count(DISTINCT author) AS authors FROM ch GROUP BY 1, 2), "
    "q AS (SELECT p.*, coalesce(again, 0) + rv AS regressions FROM p LEFT JOIN ag USING (g, file)), m AS (SELECT g, max(changes) mc, max(fixes) mf, max(regressions) mr, max(recent) mn, max(authors) ma FROM q GROUP BY 1) "
    "SELECT g AS repo_id, file, changes, fixes, regressions, recent, authors, round(0.25 * CASE WHEN mc > 0 THEN changes / mc::DOUBLE ELSE 0 END + 0.30 * CASE WHEN mf > 0 THEN fixes / mf::DOUBLE ELSE 0 END + 0.20 * CASE WHEN mr > 0 THEN regressions / mr::DOUBLE ELSE 0 END + 0.15 * CASE WHEN mn > 0 THEN recent / mn::DOUBLE ELSE 0 END + 0.10 * CASE WHEN ma > 0 THEN authors / ma::DOUBLE ELSE 0 END, 4) AS score FROM q JOIN m USING (g)"
)
def tmp4_wn2_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.risk_scores(_changes(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz")).select(F.col("g").alias("repo_id"), "file", "changes", "fixes", "regressions", "recent", "authors", "score")


@r.query(f"WITH {_COMMITS}, {_PAIRS}, u AS (SELECT g, a AS file, b AS partner, j FROM pj WHERE j >= 0.1 UNION ALL SELECT g, b, a, j FROM pj WHERE j >= 0.1), k AS (SELECT *, row_number() OVER (PARTITION BY g, file ORDER BY round(j, 9) DESC, partner) AS rank FROM u) SELECT g AS repo_id, file, partner, round(j, 6) AS jaccard, rank FROM k WHERE rank <= 5")
def tmp5_prj3_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of each file, at least 0.1: both ends of a pair as rows instead of an OR join."""
    pairs = changed_pairs(spark, sf_dir).where("jaccard >= 0.1").select("g", "a", "b", "jaccard")
    both = pairs.select("g", F.col("a").alias("file"), F.col("b").alias("partner"), "jaccard").unionByName(pairs.select("g", F.col("b").alias("file"), F.col("a").alias("partner"), "jaccard"))
    w = Window.partitionBy("g", "file").orderBy(F.desc(F.round("jaccard", 9)), "partner")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select(F.col("g").alias("repo_id"), "file", "partner", F.round("jaccard", 6).alias("jaccard"), "rank")


@r.query(
    f"WITH {_COMMITS}, p AS (SELECT g, file, author, count(*) AS n FROM ch GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN author IS NOT NULL THEN round(100.0 * n / sum(CASE WHEN author IS NOT NULL THEN n END) OVER (PARTITION BY g, file), 2) END AS share FROM p) "
    "SELECT g AS repo_id, file, author, share, CASE WHEN max(share) OVER (PARTITION BY g, file) IS NULL THEN 'orphaned' WHEN max(share) OVER (PARTITION BY g, file) >= 80 THEN 'sole' ELSE 'shared' END AS state FROM s"
)
def tmp6_ag12_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ownership(_changes(spark, sf_dir)).withColumnRenamed("g", "repo_id")


@r.query(
    "WITH b AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS file FROM lineitem), d AS (SELECT o_orderkey AS c, o_orderdate AS date FROM orders), t AS (SELECT file, count(*) AS t FROM b GROUP BY 1), "
    "p AS (SELECT x.file AS a, y.file AS b, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM b x JOIN b y ON x.c = y.c AND x.file < y.file JOIN d ON d.c = x.c GROUP BY 1, 2 HAVING count(*) >= 2) "
    f"SELECT a AS part_a, p.b AS part_b, n, round(n / (ta.t + tb.t - n)::DOUBLE, 6) AS jaccard, {_DATE.format('d0')} AS first_date, {_DATE.format('d1')} AS last_date FROM p JOIN t ta ON ta.file = a JOIN t tb ON tb.file = p.b"
)
def tmp2_parts_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-change pairs of parts within orders (no order has more than 50 parts)."""
    items = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("g"), F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("file")).distinct()
    dates = table(spark, sf_dir, "orders").select(F.lit(0).alias("g"), F.col("o_orderkey").alias("c"), F.col("o_orderdate").alias("date"))
    return H.co_changes(items, dates).select(F.col("a").alias("part_a"), F.col("b").alias("part_b"), "n", F.round("jaccard", 6).alias("jaccard"), _day("first_date"), _day("last_date"))


@r.query(
    f"WITH {_COMMITS}, s AS (SELECT repo_id AS g, split_part(stable_key, '#', 1) AS file, count(*) AS n_symbols FROM symbols GROUP BY 1, 2) SELECT ch.g AS repo_id, count(DISTINCT ch.file) AS n_files, count(DISTINCT CASE WHEN s.n_symbols IS NOT NULL THEN ch.file END) AS n_with_symbols FROM ch LEFT JOIN s USING (g, file) GROUP BY 1"
)
def jn16_files_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "symbols").select(F.col("repo_id").alias("g"), F.substring_index("stable_key", "#", 1).alias("file")).distinct().withColumn("known", F.lit(True))
    rows = _changes(spark, sf_dir).join(known, ["g", "file"], "left")
    return rows.groupBy(F.col("g").alias("repo_id")).agg(F.countDistinct("file").alias("n_files"), F.countDistinct(F.when(F.col("known"), F.col("file"))).alias("n_with_symbols"))


QUERIES, SQL = r.queries, r.sql
