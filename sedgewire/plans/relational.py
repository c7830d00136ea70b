"""Relational shapes: scans, filters, joins, aggregates, windows, set operations, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import text as T
from sedgewire.operators import corpus
from sedgewire.plans.registry import FILES, SNAPSHOTS, VERSIONS, Registry
from sedgewire.runtime import table

r = Registry()
#: The moment that ages are measured from, and retention settings.
AS_OF, KEEP_DAYS, KEEP_PER_REPO = "2026-01-01 00:00:00", 90, 50


@r.query(f"WITH {FILES} SELECT file_id, language, path FROM f WHERE file_id > '4' ORDER BY file_id LIMIT 501")
def src8_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir, "path", "language").where("file_id > '4'").select("file_id", "language", "path").orderBy("file_id").limit(501)


@r.query("WITH b AS (SELECT body_hash, max(body_source) AS body_source FROM symbol_versions WHERE body_hash IS NOT NULL AND body_source IS NOT NULL GROUP BY 1) SELECT body_hash, sha256(body_source) = lower(trim(body_hash)) AS verified FROM b")
def src2_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select("body_hash", (F.sha2("body_source", 256) == F.lower(F.trim("body_hash"))).alias("verified"))


@r.query(f"WITH {FILES} SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n_files FROM f WHERE NOT regexp_matches(path, '(^|/)(node_modules|dist|build|vendor)/') GROUP BY 1")
def src1_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension outside skipped folders."""
    kept = corpus.files(spark, sf_dir, "path").where(~F.col("path").rlike("(^|/)(node_modules|dist|build|vendor)/"))
    return kept.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("n_files"))


@r.query(f"WITH {VERSIONS}, ids AS (SELECT DISTINCT file_id FROM v) SELECT f.file_id FROM files f JOIN ids USING (file_id) GROUP BY 1")
def src10_id_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("file_id").join(table(spark, sf_dir, "symbol_versions").select("file_id"), "file_id", "left_semi").distinct()


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, signature, coalesce(summary, '') AS summary FROM v")
def prj1_view_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "signature", "summary").select("symbol_version_id", "signature", F.coalesce("summary", F.lit("")).alias("summary"))


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, (range_end_line - range_start_line + 1)::BIGINT AS line_span FROM v")
def prj2_line_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "range_start_line", "range_end_line").select("symbol_version_id", (F.col("range_end_line") - F.col("range_start_line") + 1).cast("long").alias("line_span"))


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id FROM v WHERE list_contains(uncertainty_flags, 'eval_usage') AND visibility <> 'private' AND language IN ('python', 'go')")
def flt1_flt2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.versions(spark, sf_dir, "uncertainty_flags", "visibility", "language")
    return rows.where(F.array_contains("uncertainty_flags", "eval_usage") & (F.col("visibility") != "private") & F.col("language").isin("python", "go")).select("symbol_version_id")


@r.query("SELECT DISTINCT repo_id FROM repositories WHERE list_has_any(language_set, ['go', 'java'])")
def flt3_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repositories").where(F.arrays_overlap("language_set", F.array(F.lit("go"), F.lit("java")))).select("repo_id").distinct()


@r.query("SELECT repo_id, hash FROM git_commits WHERE len(files) > 0 GROUP BY 1, 2")
def flt6_nonempty_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "git_commits").where(F.size("files") > 0).select("repo_id", "hash").distinct()


@r.query("SELECT symbol_id, canonical_name FROM symbols WHERE canonical_name ILIKE '%token%' OR stable_key LIKE 'tools/%'")
def flt7_flt8_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").where(F.col("canonical_name").ilike("%token%") | F.col("stable_key").like("tools/%")).select("symbol_id", "canonical_name")


@r.query(f"WITH {FILES} SELECT file_id, (contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__')) AS is_test, regexp_matches(path, '(?i)\\.(png|jpe?g|gif|ico|svg|woff2?|ttf|eot|mp[34]|zip|gz|pdf|lock|map)$|(^|/)(node_modules|dist|build|coverage|\\.git)/|(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml)$') AS is_ignored FROM f")
def flt10_flt12_path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir, "path").select("file_id", T.is_test_path(F.col("path")).alias("is_test"), T.is_ignored_path(F.col("path")).alias("is_ignored"))


@r.query(f"WITH {VERSIONS}, {FILES} SELECT v.symbol_version_id, s.canonical_name, s.kind, f.path, v.visibility FROM v JOIN symbols s USING (symbol_id) JOIN f USING (file_id)")
def jn1_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.star(spark, sf_dir, "visibility").select("symbol_version_id", "canonical_name", "kind", "path", "visibility")


@r.query("SELECT v.symbol_version_id, max(sv.token_count)::BIGINT AS token_count FROM (SELECT DISTINCT symbol_version_id FROM symbol_versions) v LEFT JOIN semantic_vectors sv ON sv.symbol_version_id = v.symbol_version_id GROUP BY 1")
def jn4_left_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "semantic_vectors").groupBy("symbol_version_id").agg(F.max("token_count").cast("long").alias("token_count"))
    return table(spark, sf_dir, "symbol_versions").select("symbol_version_id").distinct().join(vectors, "symbol_version_id", "left")


@r.query("WITH one AS (SELECT repo_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY symbol_id) rn FROM symbols) WHERE rn = 1) SELECT s.repo_id, count(*) AS n FROM symbols s JOIN one ON one.repo_id = s.repo_id AND one.kind = s.kind GROUP BY 1")
def jn6_same_property_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols of a repository share the kind of its first one."""
    symbols = table(spark, sf_dir, "symbols").select("repo_id", "symbol_id", "kind")
    one = symbols.groupBy("repo_id").agg(F.min(F.struct("symbol_id", "kind")).getField("kind").alias("kind"))
    return symbols.join(one, ["repo_id", "kind"]).groupBy("repo_id").agg(F.count("*").alias("n"))


@r.query(
    f"WITH {FILES}, {SNAPSHOTS}, o AS (SELECT snapshot_id, lead(snapshot_id) OVER (PARTITION BY repo_id, branch ORDER BY created_at, snapshot_id) AS nxt FROM sn WHERE snapshot_id IN (SELECT snapshot_id FROM f)) "
    "SELECT o.snapshot_id AS old_snapshot_id, o.nxt AS new_snapshot_id, count(*) AS unchanged FROM o JOIN f a ON a.snapshot_id = o.snapshot_id JOIN f b ON b.snapshot_id = o.nxt AND a.path = b.path AND lower(trim(a.content_hash)) = lower(trim(b.content_hash)) GROUP BY 1, 2"
)
def jn7_copy_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files unchanged between neighbouring snapshots of a branch (what is copied forward)."""
    f = corpus.files(spark, sf_dir, "snapshot_id", "path", "content_hash").select("snapshot_id", "path", F.lower(F.trim("content_hash")).alias("h"))
    w = Window.partitionBy("repo_id", "branch").orderBy("created_at", "snapshot_id")
    steps = corpus.snapshots(spark, sf_dir).join(f.select("snapshot_id").distinct(), "snapshot_id", "left_semi").select("snapshot_id", F.lead("snapshot_id").over(w).alias("nxt"))
    old = f.join(steps, "snapshot_id").select(F.col("snapshot_id").alias("old_snapshot_id"), F.col("nxt").alias("new_snapshot_id"), "path", "h")
    new = f.select(F.col("snapshot_id").alias("new_snapshot_id"), "path", "h")
    return old.join(new, ["new_snapshot_id", "path", "h"]).groupBy("old_snapshot_id", "new_snapshot_id").agg(F.count("*").alias("unchanged"))


@r.query("WITH n AS (SELECT DISTINCT repo_id, logical_namespace AS ns FROM symbols WHERE logical_namespace IS NOT NULL) SELECT a.repo_id, a.ns AS namespace, count(*) AS n_below FROM n a JOIN n b ON a.repo_id = b.repo_id AND starts_with(b.ns, a.ns || '.') GROUP BY 1, 2")
def jn8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces below each namespace: every prefix is spelt out, so the join is on equality."""
    n = table(spark, sf_dir, "symbols").where("logical_namespace is not null").select("repo_id", F.col("logical_namespace").alias("ns")).distinct()
    parts = F.split("ns", r"\.")
    above = n.select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("namespace"), "ns").where("namespace <> ns")
    return above.join(n.withColumnRenamed("ns", "namespace"), ["repo_id", "namespace"]).groupBy("repo_id", "namespace").agg(F.count("*").alias("n_below"))


@r.query("SELECT snapshot_id FROM (SELECT DISTINCT snapshot_id FROM snapshots WHERE snapshot_id IS NOT NULL) WHERE snapshot_id NOT IN (SELECT snapshot_id FROM files WHERE snapshot_id IS NOT NULL)")
def jn11_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snapshots").where("snapshot_id is not null").select("snapshot_id").distinct().join(table(spark, sf_dir, "files").select("snapshot_id"), "snapshot_id", "left_anti")


@r.query(f"WITH {SNAPSHOTS}, {VERSIONS}, l AS (SELECT v.symbol_id, max(sn.created_at) AS t FROM v JOIN sn USING (snapshot_id) WHERE index_status = 'complete' GROUP BY 1) SELECT symbol_id, t::VARCHAR AS latest FROM l")
def jn13_latest_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = corpus.snapshots(spark, sf_dir).where("index_status = 'complete'").select("snapshot_id", "created_at")
    return corpus.versions(spark, sf_dir, "symbol_id", "snapshot_id").join(done, "snapshot_id").groupBy("symbol_id").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@r.query(f"WITH {FILES}, {VERSIONS}, n AS (SELECT file_id, count(*) AS n FROM v GROUP BY 1) SELECT f.file_id, coalesce(n.n, 0) AS n_symbols FROM f LEFT JOIN n USING (file_id)")
def jn14_update_from_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.versions(spark, sf_dir, "file_id").groupBy("file_id").agg(F.count("*").alias("n"))
    return corpus.files(spark, sf_dir, "path").join(counts, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n_symbols"))


@r.query(
    "WITH p AS (SELECT DISTINCT repo_id, p AS path FROM (SELECT repo_id, unnest(files) AS p FROM git_commits) WHERE p IS NOT NULL AND p <> ''), "
    "k AS (SELECT repo_id, split_part(stable_key, '#', 1) AS path, min(symbol_id) AS by_path FROM symbols GROUP BY 1, 2), "
    "n AS (SELECT repo_id, canonical_name, min(symbol_id) AS by_name FROM symbols GROUP BY 1, 2) "
    "SELECT p.repo_id, p.path, coalesce(k.by_path, n.by_name) AS symbol_id, CASE WHEN k.by_path IS NOT NULL THEN 'path' WHEN n.by_name IS NOT NULL THEN 'name' ELSE 'none' END AS tier FROM p LEFT JOIN k ON k.repo_id = p.repo_id AND k.path = p.path "
    "LEFT JOIN n ON n.repo_id = p.repo_id AND n.canonical_name = regexp_extract(p.path, '([A-Za-z0-9_]+)\\.[A-Za-z0-9.]+$', 1)"
)
def jn17_tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touched paths resolved to a symbol: by the path of its key, else by a name like the file's."""
    paths = table(spark, sf_dir, "git_commits").select("repo_id", F.explode("files").alias("path")).where("path is not null and path <> ''").distinct()
    symbols = table(spark, sf_dir, "symbols")
    by_path = symbols.groupBy("repo_id", F.substring_index("stable_key", "#", 1).alias("path")).agg(F.min("symbol_id").alias("by_path"))
    by_name = symbols.groupBy("repo_id", F.col("canonical_name").alias("stem")).agg(F.min("symbol_id").alias("by_name"))
    found = paths.withColumn("stem", F.regexp_extract("path", r"([A-Za-z0-9_]+)\.[A-Za-z0-9.]+$", 1)).join(by_path, ["repo_id", "path"], "left").join(by_name, ["repo_id", "stem"], "left")
    return found.select("repo_id", "path", F.coalesce("by_path", "by_name").alias("symbol_id"), F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_name").isNotNull(), "name").otherwise("none").alias("tier"))


@r.query(f"WITH {VERSIONS} SELECT v.language, s.kind, count(*) AS n FROM v JOIN symbols s USING (symbol_id) GROUP BY 1, 2")
def ag1_language_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "symbol_id", "language").join(table(spark, sf_dir, "symbols").select("symbol_id", "kind"), "symbol_id").groupBy("language", "kind").agg(F.count("*").alias("n"))


@r.query(f"WITH {FILES} SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, count(*) AS n_files FROM f GROUP BY 1 ORDER BY n_files DESC, directory LIMIT 20")
def ag2_directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir, "path").groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("directory")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "directory").limit(20)


@r.query(
    f"WITH {VERSIONS}, {FILES}, t AS (SELECT sn_.repo_id, count(DISTINCT v.symbol_id) AS n, count(DISTINCT CASE WHEN contains(f.path, '.test.') OR contains(f.path, '.spec.') OR contains(f.path, '__tests__') THEN v.symbol_id END) AS tested FROM v JOIN f USING (file_id) JOIN symbols sn_ ON sn_.symbol_id = v.symbol_id GROUP BY 1) "
    "SELECT repo_id, n AS n_symbols, tested AS n_test_symbols, round(100.0 * tested / n, 2) AS percent FROM t"
)
def ag3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.star(spark, sf_dir)
    counts = rows.groupBy("repo_id").agg(F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct(F.when(T.is_test_path(F.col("path")), F.col("symbol_id"))).alias("n_test_symbols"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n_test_symbols") / F.col("n_symbols"), 2))


@r.query(f"WITH {SNAPSHOTS} SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE index_status = 'complete') AS n_complete, count(*) FILTER (WHERE index_status IN ('failed', 'partial')) AS n_bad, round(coalesce(avg(date_diff('second', created_at, indexed_at)), 0), 4) AS mean_lag_s FROM sn GROUP BY 1")
def ag4_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = (F.unix_micros(F.col("indexed_at").cast("timestamp")) / 1_000_000).cast("long") - (F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000).cast("long")
    return corpus.snapshots(spark, sf_dir).groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("index_status") == "complete").alias("n_complete"), F.count_if(F.col("index_status").isin("failed", "partial")).alias("n_bad"), F.round(F.coalesce(F.avg(lag), F.lit(0.0)), 4).alias("mean_lag_s")
    )


@r.query("SELECT user_id, event_type, sum(value) AS total, max(value) AS most, count(*) AS n FROM events GROUP BY 1, 2")
def ag5_sum_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count("*").alias("n"))


@r.query("SELECT repo_id, min(commit_date)::VARCHAR AS first_date, max(commit_date)::VARCHAR AS last_date FROM git_commits GROUP BY 1")
def ag6_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "git_commits").groupBy("repo_id").agg(day(F.min("commit_date")).alias("first_date"), day(F.max("commit_date")).alias("last_date"))


@r.query("SELECT DISTINCT ON (repo_id, canonical_name) repo_id, canonical_name, symbol_id FROM symbols ORDER BY repo_id, canonical_name, symbol_id")
def ag7_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").groupBy("repo_id", "canonical_name").agg(F.min("symbol_id").alias("symbol_id"))


@r.query(f"WITH {VERSIONS} SELECT symbol_id, array_to_string(list_sort(list_distinct(list_append(flatten(list(coalesce(uncertainty_flags, []))), 'reviewed'))), ',') AS flags FROM v GROUP BY 1")
def ag8_set_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the flags of a symbol's versions, with one more inserted."""
    flags = corpus.versions(spark, sf_dir, "symbol_id", "uncertainty_flags").select("symbol_id", F.explode_outer("uncertainty_flags").alias("flag"))
    return flags.groupBy("symbol_id").agg(F.array_join(F.array_sort(F.array_distinct(F.array_append(F.collect_set("flag"), F.lit("reviewed")))), ",").alias("flags"))


@r.query(f"WITH {VERSIONS}, {FILES}, {SNAPSHOTS}, a AS (SELECT snapshot_id, count(*) AS n_files FROM f GROUP BY 1), b AS (SELECT snapshot_id, count(*) AS n_symbols, count(*) FILTER (WHERE len(uncertainty_flags) > 0) AS n_uncertain FROM v GROUP BY 1) SELECT sn.snapshot_id, coalesce(n_files, 0) AS n_files, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_uncertain, 0) AS n_uncertain FROM sn LEFT JOIN a USING (snapshot_id) LEFT JOIN b USING (snapshot_id)")
def ag13_snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_files = corpus.files(spark, sf_dir, "snapshot_id").groupBy("snapshot_id").agg(F.count("*").alias("n_files"))
    n_symbols = corpus.versions(spark, sf_dir, "snapshot_id", "uncertainty_flags").groupBy("snapshot_id").agg(F.count("*").alias("n_symbols"), F.count_if(F.size("uncertainty_flags") > 0).alias("n_uncertain"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return corpus.snapshots(spark, sf_dir).join(n_files, "snapshot_id", "left").join(n_symbols, "snapshot_id", "left").select("snapshot_id", zero("n_files"), zero("n_symbols"), zero("n_uncertain"))


@r.query(f"WITH {SNAPSHOTS} SELECT snapshot_id FROM (SELECT snapshot_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, snapshot_id DESC) rn FROM sn) WHERE rn > {KEEP_PER_REPO}")
def wn1_ret2_cap_per_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return corpus.snapshots(spark, sf_dir).select("snapshot_id", F.row_number().over(w).alias("rn")).where(F.col("rn") > KEEP_PER_REPO).select("snapshot_id")


@r.query("WITH n AS (SELECT repo_id, count(*) AS n FROM git_commits GROUP BY 1) SELECT repo_id, round(n / (SELECT max(n) FROM n)::DOUBLE, 6) AS share_of_max FROM n")
def wn3_max_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "git_commits").groupBy("repo_id").agg(F.count("*").alias("n"))
    return n.select("repo_id", F.round(F.col("n") / n.agg(F.max("n")).scalar(), 6).alias("share_of_max"))


@r.query("SELECT repo_id, hash, len(files)::BIGINT AS n FROM (SELECT repo_id, hash, max(files) AS files FROM git_commits WHERE files IS NOT NULL GROUP BY 1, 2) ORDER BY n DESC, repo_id, hash LIMIT 50")
def srt1_top_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "git_commits").where("files is not null").groupBy("repo_id", "hash").agg(F.max("files").alias("files"))
    return one.select("repo_id", "hash", F.size("files").cast("long").alias("n")).orderBy(F.desc("n"), "repo_id", "hash").limit(50)


@r.query("SELECT DISTINCT symbol_id FROM symbols WHERE kind = 'variable' UNION SELECT DISTINCT symbol_id FROM symbol_versions WHERE visibility = 'internal'")
def set1_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "symbols").where("kind = 'variable'").select("symbol_id")
    return a.unionByName(table(spark, sf_dir, "symbol_versions").where("visibility = 'internal'").select("symbol_id")).distinct()


@r.query(
    "WITH a AS (SELECT repo_id, hash, list_distinct(list_filter(files, lambda x: x IS NOT NULL AND x <> '')) AS now, lag(list_distinct(list_filter(files, lambda x: x IS NOT NULL AND x <> ''))) OVER (PARTITION BY repo_id ORDER BY commit_date, hash) AS before FROM (SELECT repo_id, hash, max(commit_date) AS commit_date, max(files) AS files FROM git_commits GROUP BY 1, 2) WHERE files IS NOT NULL) "
    "SELECT repo_id, hash, len(list_filter(now, lambda x: NOT list_contains(before, x)))::BIGINT AS n_new, len(list_filter(before, lambda x: NOT list_contains(now, x)))::BIGINT AS n_gone FROM a WHERE before IS NOT NULL"
)
def set2_array_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths new and gone against the commit before."""
    one = table(spark, sf_dir, "git_commits").groupBy("repo_id", "hash").agg(F.max("commit_date").alias("commit_date"), F.max("files").alias("files")).where("files is not null")
    clean = one.withColumn("now", F.array_distinct(F.filter("files", lambda x: x.isNotNull() & (x != ""))))
    step = clean.withColumn("before", F.lag("now").over(Window.partitionBy("repo_id").orderBy("commit_date", "hash"))).where("before is not null")
    return step.select("repo_id", "hash", F.size(F.array_except("now", "before")).cast("long").alias("n_new"), F.size(F.array_except("before", "now")).cast("long").alias("n_gone"))


@r.query("WITH x AS (SELECT repo_id, hash, count(DISTINCT array_to_string(list_sort(list_filter(files, lambda x: x IS NOT NULL)), chr(0))) AS n FROM git_commits WHERE files IS NOT NULL GROUP BY 1, 2) SELECT repo_id, hash, n = 1 AS same_files FROM x")
def set4_order_free_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the deliveries of a commit list the same files in any order."""
    listed = table(spark, sf_dir, "git_commits").where("files is not null").select("repo_id", "hash", F.array_join(F.array_sort(F.filter("files", lambda x: x.isNotNull())), "\x00").alias("k"))
    return listed.groupBy("repo_id", "hash").agg((F.countDistinct("k") == 1).alias("same_files"))


@r.query(f"WITH {SNAPSHOTS}, l AS (SELECT snapshot_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, snapshot_id DESC) AS rn, created_at, retained_until FROM sn) SELECT snapshot_id FROM l WHERE rn > 1 AND coalesce(retained_until, created_at + INTERVAL {KEEP_DAYS} DAY) < TIMESTAMP '{AS_OF}'")
def ret1_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots past their keeping time, never the latest of a repository."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    until = F.coalesce("retained_until", F.expr(f"created_at + INTERVAL {KEEP_DAYS} DAYS"))
    return corpus.snapshots(spark, sf_dir).select("snapshot_id", F.row_number().over(w).alias("rn"), until.alias("until")).where((F.col("rn") > 1) & (F.col("until") < F.lit(AS_OF).cast("timestamp_ntz"))).select("snapshot_id")


@r.query(f"WITH {SNAPSHOTS} SELECT snapshot_id, index_status FROM sn WHERE index_status IN ('pending', 'indexing') AND indexed_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE")
def ret3_stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.snapshots(spark, sf_dir).where(F.col("index_status").isin("pending", "indexing") & (F.col("indexed_at") < F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 60 MINUTES"))).select("snapshot_id", "index_status")


@r.query("SELECT DISTINCT vector_id FROM semantic_vectors WHERE symbol_version_id NOT IN (SELECT symbol_version_id FROM symbol_versions WHERE body_hash IS NOT NULL AND visibility = 'public')")
def ret4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose symbol version is not among the public ones."""
    kept = table(spark, sf_dir, "symbol_versions").where("body_hash is not null and visibility = 'public'").select("symbol_version_id")
    return table(spark, sf_dir, "semantic_vectors").select("vector_id", "symbol_version_id").join(kept, "symbol_version_id", "left_anti").select("vector_id").distinct()


@r.query(f"WITH {SNAPSHOTS} SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE retained_until IS NOT NULL) AS n_limited, count(*) FILTER (WHERE retained_until < TIMESTAMP '{AS_OF}') AS n_past, min(created_at)::VARCHAR AS oldest FROM sn GROUP BY 1")
def ret5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.snapshots(spark, sf_dir).groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count("retained_until").alias("n_limited"), F.count_if(F.col("retained_until") < F.lit(AS_OF).cast("timestamp_ntz")).alias("n_past"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest")
    )


@r.query(
    f"WITH {VERSIONS}, {FILES}, {SNAPSHOTS} SELECT sn.repo_id, count(DISTINCT f.path) AS n_paths, count(DISTINCT v.symbol_id) AS n_symbols, count(DISTINCT CASE WHEN len(v.uncertainty_flags) > 1 THEN v.symbol_id END) AS n_high_risk FROM sn JOIN f USING (snapshot_id) LEFT JOIN v ON v.file_id = f.file_id GROUP BY 1"
)
def ovr1_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.versions(spark, sf_dir, "symbol_id", "file_id", "uncertainty_flags").withColumn("risky", F.when(F.size("uncertainty_flags") > 1, F.col("symbol_id")))
    rows = corpus.files(spark, sf_dir, "snapshot_id", "path").join(corpus.snapshots(spark, sf_dir).select("snapshot_id", "repo_id"), "snapshot_id").join(v, "file_id", "left")
    return rows.groupBy("repo_id").agg(F.countDistinct("path").alias("n_paths"), F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct("risky").alias("n_high_risk"))


@r.query("WITH u AS (SELECT repo_id, hash, max(commit_date) AS d, 'a' AS src FROM git_commits WHERE is_bug_fix GROUP BY 1, 2 UNION ALL SELECT repo_id, hash, max(commit_date), 'b' FROM git_commits GROUP BY 1, 2) SELECT repo_id, hash, min(src) AS src FROM u GROUP BY 1, 2")
def snk1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows win over stored ones with the same key."""
    commits = table(spark, sf_dir, "git_commits")
    new, stored = commits.where("is_bug_fix").select("repo_id", "hash", F.lit("a").alias("src")), commits.select("repo_id", "hash", F.lit("b").alias("src"))
    return new.unionByName(stored).groupBy("repo_id", "hash").agg(F.min("src").alias("src"))


@r.query("SELECT repo_id, name || '|' || default_branch || '|' || visibility AS line FROM repositories")
def snk5_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repositories").select("repo_id", F.concat_ws("|", "name", "default_branch", "visibility").alias("line"))


@r.query("SELECT least(greatest(floor(ln(1 + n_chars)), 0), 12)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1")
def snk6_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.least(F.greatest(F.floor(F.log(1 + F.col("n_chars"))), F.lit(0)), F.lit(12)).cast("long")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


QUERIES, SQL = r.queries, r.sql
