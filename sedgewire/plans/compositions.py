"""Further shapes and compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import text as T
from sedgewire.operators import corpus
from sedgewire.operators import vectors as V
from sedgewire.plans import textual
from sedgewire.plans.behaving import _HINTS, _INVARIANTS, body_profiles, invariants, language_bodies
from sedgewire.operators import behavior as B
from sedgewire.plans.graphs import _E
from sedgewire.plans.history import _COMMITS, _PAIRS, changed_pairs
from sedgewire.plans.registry import FILES, IN_TIME, SNAPSHOTS, TIMED, VERSIONS, Registry
from sedgewire.runtime import table

r = Registry()


@r.query("SELECT DISTINCT f.path FROM files f WHERE EXISTS (SELECT 1 FROM git_commits c WHERE list_contains(c.files, f.path))")
def jn10_exists_in_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that some commit lists: the arrays are spelt out, then a semi join."""
    listed = table(spark, sf_dir, "git_commits").select(F.explode("files").alias("path"))
    return table(spark, sf_dir, "files").select("path").where("path is not null").join(listed, "path", "left_semi").distinct()


@r.query(f"WITH {SNAPSHOTS}, l AS (SELECT snapshot_id, row_number() OVER (PARTITION BY repo_id, branch ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM sn) SELECT snapshot_id FROM l WHERE rn > 1")
def jn12_not_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repo_id", "branch").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return corpus.snapshots(spark, sf_dir).select("snapshot_id", F.row_number().over(w).alias("rn")).where("rn > 1").select("snapshot_id")


@r.query("WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b, value FROM events) SELECT least(a, b) AS a, greatest(a, b) AS b, max(value) AS best FROM p WHERE a IS NOT NULL GROUP BY 1, 2")
def jn15_symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("x"), F.col("event_type").alias("y"), "value").where("x is not null")
    return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("value").alias("best"))


@r.query("SELECT repo_id, path, max(n)::BIGINT AS confidence, max_by(hash, (n, hash)) AS evidence FROM (SELECT repo_id, hash, unnest(files) AS path, len(files) AS n FROM git_commits) WHERE path IS NOT NULL AND path <> '' GROUP BY 1, 2")
def ag11_upsert_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path the widest commit that touched it, with that commit as evidence."""
    rows = table(spark, sf_dir, "git_commits").select("repo_id", "hash", F.size("files").cast("long").alias("n"), F.explode("files").alias("path")).where("path is not null and path <> ''")
    return rows.groupBy("repo_id", "path").agg(F.max(F.struct("n", "hash")).alias("m")).select("repo_id", "path", F.col("m.n").alias("confidence"), F.col("m.hash").alias("evidence"))


@r.query(f"WITH {VERSIONS}, {_INVARIANTS}, g AS (SELECT scope, expression, max(strength) AS s FROM iv GROUP BY 1, 2) SELECT scope AS symbol_id, expression, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM g")
def blr3_contract_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants(spark, sf_dir).select(F.col("scope").alias("symbol_id"), "expression", F.when(F.col("strength") >= 0.9, "critical").when(F.col("strength") >= 0.7, "high").otherwise("medium").alias("severity"))


@r.query(f"WITH {_COMMITS}, {_PAIRS}, u AS (SELECT g, a AS target, b AS file, j FROM pj WHERE j >= 0.5 UNION ALL SELECT g, b, a, j FROM pj WHERE j >= 0.5) SELECT g AS repo_id, target, file, CASE WHEN j >= 0.8 THEN 'medium' ELSE 'low' END AS severity FROM u")
def blr5_hom6_historical_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = changed_pairs(spark, sf_dir).where("jaccard >= 0.5")
    both = p.select("g", F.col("a").alias("target"), F.col("b").alias("file"), "jaccard").unionByName(p.select("g", F.col("b").alias("target"), F.col("a").alias("file"), "jaccard"))
    return both.select(F.col("g").alias("repo_id"), "target", "file", F.when(F.col("jaccard") >= 0.8, "medium").otherwise("low").alias("severity"))


@r.query(f"WITH {SNAPSHOTS}, {FILES}, n AS (SELECT snapshot_id, count(*) AS n FROM f GROUP BY 1) SELECT sn.snapshot_id, index_status, coalesce(n, 0) AS n_files FROM sn LEFT JOIN n USING (snapshot_id) WHERE index_status <> 'complete' ORDER BY indexed_at, sn.snapshot_id LIMIT 50")
def txn4_stale_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.files(spark, sf_dir, "snapshot_id").groupBy("snapshot_id").agg(F.count("*").alias("n"))
    open_ = corpus.snapshots(spark, sf_dir).where("index_status <> 'complete'").join(n, "snapshot_id", "left")
    return open_.orderBy("indexed_at", "snapshot_id").limit(50).select("snapshot_id", "index_status", F.coalesce("n", F.lit(0)).alias("n_files"))


@r.query(_E + ", d AS (SELECT src AS symbol, 'out' AS direction, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT dst, 'in', count(*) FROM e GROUP BY 1) SELECT symbol, coalesce(max(n) FILTER (WHERE direction = 'out'), 0) AS n_out, coalesce(max(n) FILTER (WHERE direction = 'in'), 0) AS n_in FROM d GROUP BY 1")
def gr5_relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.call_edges(spark, sf_dir)
    both = e.select(F.col("src").alias("symbol"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("symbol"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("symbol").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


@r.query(
    _E + f", {TIMED}, st AS (SELECT symbol_id, symbol_version_id AS b, lag(symbol_version_id) OVER {IN_TIME} AS a FROM vt), nm AS (SELECT symbol_version_id AS id, symbol_id AS sym FROM v), "
    "cl AS (SELECT src AS id, list(DISTINCT sym) AS s FROM e JOIN nm ON nm.id = e.dst GROUP BY 1), cr AS (SELECT dst AS id, list(DISTINCT sym) AS s FROM e JOIN nm ON nm.id = e.src GROUP BY 1), "
    "x AS (SELECT st.a, st.b, coalesce(ca.s, []) AS ca, coalesce(cb.s, []) AS cb, coalesce(ra.s, []) AS ra, coalesce(rb.s, []) AS rb FROM st LEFT JOIN cl ca ON ca.id = st.a LEFT JOIN cl cb ON cb.id = st.b LEFT JOIN cr ra ON ra.id = st.a LEFT JOIN cr rb ON rb.id = st.b WHERE st.a IS NOT NULL) "
    f"SELECT a, b, round(0.6 * {textual._JACC.format('ca', 'cb')} + 0.4 * {textual._JACC.format('ra', 'rb')}, 6) AS neighborhood FROM x WHERE len(ca) + len(cb) + len(ra) + len(rb) > 0"
)
def lin5_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far neighbouring versions of a symbol share callees (0.6) and callers (0.4)."""
    v = corpus.timed_versions(spark, sf_dir, "symbol_id")
    e = corpus.call_edges(spark, sf_dir)
    near = lambda one, other: e.join(v.select(F.col("symbol_version_id").alias(other), F.col("symbol_id").alias("sym")), other).groupBy(F.col(one).alias("id")).agg(F.collect_set("sym").alias("s"))
    callees, callers = near("src", "dst"), near("dst", "src")
    steps = v.select(F.lag("symbol_version_id").over(corpus.in_time()).alias("a"), F.col("symbol_version_id").alias("b")).where("a is not null")
    for name, df in (("c", callees), ("r", callers)):
        for side in "ab":
            steps = steps.join(df.select(F.col("id").alias(side), F.col("s").alias(name + side)), side, "left").withColumn(name + side, F.coalesce(name + side, F.array().cast("array<string>")))
    some = F.size("ca") + F.size("cb") + F.size("ra") + F.size("rb") > 0
    return steps.where(some).select("a", "b", F.round(0.6 * T.jaccard(F.col("ca"), F.col("cb")) + 0.4 * T.jaccard(F.col("ra"), F.col("rb")), 6).alias("neighborhood"))


_AUTH = _HINTS + ", q AS (SELECT DISTINCT symbol_id, body_hash FROM symbol_versions WHERE body_hash IN (SELECT body_hash FROM lb)), a AS (SELECT DISTINCT body_hash FROM h WHERE hint_type = 'auth_check'), t AS (SELECT s.repo_id, count(DISTINCT q.symbol_id) AS n, count(DISTINCT CASE WHEN a.body_hash IS NOT NULL THEN q.symbol_id END) AS m FROM q JOIN symbols s USING (symbol_id) LEFT JOIN a USING (body_hash) GROUP BY 1)"


@r.query("WITH " + _AUTH + " SELECT repo_id, n AS n_symbols, m AS n_checked, CASE WHEN n >= 3 AND m / n::DOUBLE >= 0.70 THEN round(least(0.95, 0.80 + 0.15 * m / n::DOUBLE), 6) END AS strength FROM t")
def dct5_global_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether checks are so common in a repository that they are an invariant of it."""
    checked = body_profiles(spark, sf_dir).where(F.size("auth_operations") > 0).select("body_hash", F.lit(True).alias("auth"))
    rows = table(spark, sf_dir, "symbol_versions").where("body_hash is not null").select("symbol_id", "body_hash").distinct().join(language_bodies(spark, sf_dir).select("body_hash"), "body_hash", "left_semi")
    t = rows.join(table(spark, sf_dir, "symbols").select("symbol_id", "repo_id"), "symbol_id").join(checked, "body_hash", "left").groupBy("repo_id").agg(F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct(F.when(F.col("auth"), F.col("symbol_id"))).alias("n_checked"))
    ratio = F.col("n_checked") / F.col("n_symbols")
    return t.withColumn("strength", F.when((F.col("n_symbols") >= 3) & (ratio >= 0.70), F.round(F.least(F.lit(0.95), 0.80 + 0.15 * ratio), 6)))


@r.query("WITH " + _HINTS + ", ids AS (SELECT body_hash AS k, hint_type AS x FROM h UNION ALL SELECT body_hash, unnest(regexp_extract_all(detail, '[a-zA-Z_$][a-zA-Z0-9_$]*')) FROM h), " + textual._TOKENS.format(split=textual._SPLIT.format("x"), noise="") + " SELECT k AS body_hash, array_to_string(list_sort(list(w)), ' ') AS tokens FROM tok GROUP BY 1")
def st6_behavior_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = B.mine_hints(language_bodies(spark, sf_dir))
    words = F.concat(T.name_tokens(F.col("hint_type")), F.flatten(F.transform(F.regexp_extract_all("detail", F.lit(T.IDENTIFIER), F.lit(0)), T.name_tokens)))
    return hints.select("body_hash", F.explode(words).alias("w")).groupBy("body_hash").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("tokens"))


_S14 = textual.SQL["sim14_search"]


@r.query(f"WITH s AS ({_S14}) SELECT symbol_id, body_hash, round(least(1, score * 1.15), 4) AS score FROM s JOIN (SELECT symbol_id, kind FROM symbols) k USING (symbol_id) WHERE kind IN ('function', 'method', 'class')")
def sim15_second_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second boost that the search's caller applies to functions, methods and classes."""
    kinds = table(spark, sf_dir, "symbols").where("kind in ('function', 'method', 'class')").select("symbol_id")
    return textual.sim14_search(spark, sf_dir).join(kinds, "symbol_id", "left_semi").select("symbol_id", "body_hash", F.round(F.least(F.lit(1.0), F.col("score") * 1.15), 4).alias("score"))


@r.query()
def sim8_sim9_sim10_multi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring versions of a symbol by body and signature views, each with its own corpus statistics."""
    v = corpus.timed_versions(spark, sf_dir, "symbol_id", "signature", "body_source")
    pairs = v.select(F.lag("symbol_version_id").over(corpus.in_time()).alias("a"), F.col("symbol_version_id").alias("b")).where("a is not null")
    views = []
    for name, words in (("body", T.body_tokens(F.col("body_source"))), ("signature", T.signature_tokens(F.col("signature")))):
        tokens = v.select(F.col("symbol_version_id").alias("doc"), F.explode(words).alias("token"))
        weights = V.term_weights(tokens)
        views.append(V.tfidf(weights, V.inverse_frequencies(weights, v.agg(F.count("*")))).withColumn("view", F.lit(name)))
    return V.multi_view(pairs, views[0].unionByName(views[1])).select("a", "b", F.round("similarity", 6).alias("similarity"))


QUERIES, SQL = r.queries, r.sql
