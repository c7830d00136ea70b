"""Graph, impact, propagation and lineage-chain queries over the call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions.text import is_test_path
from sedgewire.operators import corpus
from sedgewire.operators import graph as G
from sedgewire.operators.components import connected_components
from sedgewire.operators.hierarchy import ancestors
from sedgewire.plans.behaving import _LEVEL, _HINTS, _TOUCH, body_profiles
from sedgewire.plans.registry import BODIES, EDGES, SNAPSHOTS, VERSIONS, Registry
from sedgewire.runtime import table

r = Registry()
_E = f"WITH RECURSIVE {VERSIONS}, {BODIES}, {EDGES}"


@r.query(_E + " SELECT snapshot_id, src, dst FROM e")
def gr2_jn2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.call_edges(spark, sf_dir)


@r.query(_E + ", n AS (SELECT src AS symbol, 'callee' AS direction, dst AS other FROM e UNION ALL SELECT dst, 'caller', src FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY other) AS rank FROM n) SELECT symbol, direction, other, rank FROM k WHERE rank <= 500")
def gr1_callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.call_edges(spark, sf_dir)
    both = e.select(F.col("src").alias("symbol"), F.lit("callee").alias("direction"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("symbol"), F.lit("caller").alias("direction"), F.col("src").alias("other")))
    ranked = G.best_relations(both.withColumn("k", F.concat_ws("/", "symbol", "direction")), "k", 500, [F.col("other")])
    return ranked.select("symbol", "direction", "other", "rank")


_REACH = ", w AS (SELECT DISTINCT src, dst, 1 AS depth FROM e UNION SELECT w.src, e.dst, depth + 1 FROM w JOIN e ON e.src = w.dst WHERE depth < 5), rc AS (SELECT src, dst, min(depth)::BIGINT AS depth FROM w WHERE src <> dst GROUP BY 1, 2)"


@r.query(_E + _REACH + " SELECT src AS start, dst AS node, depth FROM rc")
def gr3_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.call_edges(spark, sf_dir)
    return G.bounded_reach(e, e.select(F.col("src").alias("node"))).withColumn("depth", F.col("depth").cast("long"))


@r.query(_E + _REACH + " SELECT dst AS target, src AS symbol, depth, round(greatest(0.05, 1 - 0.2 * (depth - 1))::DOUBLE, 4) AS confidence, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM rc")
def gr4_blr1_structural_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.call_edges(spark, sf_dir)
    return G.impact(e, e.select(F.col("dst").alias("node"))).withColumn("depth", F.col("depth").cast("long"))


@r.query(_E + _REACH + ", s AS (SELECT dst AS target, src AS symbol, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM rc), c AS (SELECT target, count(DISTINCT symbol) AS n, count(DISTINCT CASE WHEN severity = 'high' THEN symbol END) AS h FROM s GROUP BY 1) SELECT target, n AS n_symbols, h AS n_high, CASE WHEN h >= 5 OR n >= 20 THEN 'strict' WHEN h >= 2 OR n >= 8 THEN 'standard' ELSE 'quick' END AS scope FROM c")
def blr6_impact_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.call_edges(spark, sf_dir)
    return G.impact_scope(G.impact(e, e.select(F.col("dst").alias("node"))), "target")


_SYMBOL_PROFILE = ", " + _HINTS + f", pk AS (SELECT body_hash, list(DISTINCT hint_type) AS k, list(DISTINCT {_TOUCH}) FILTER ({_TOUCH} IS NOT NULL) AS touches FROM h GROUP BY 1), np AS (SELECT v.symbol_version_id AS node, coalesce({_LEVEL}, 0) AS level, coalesce(touches, []) AS items FROM v JOIN lb USING (body_hash) LEFT JOIN pk USING (body_hash))"


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = body_profiles(spark, sf_dir).select("body_hash", F.col("purity_level").alias("level"), F.col("resource_touches").alias("items"))
    return corpus.versions(spark, sf_dir, "body_hash").join(p, "body_hash").select(F.col("symbol_version_id").alias("node"), "level", "items")


@r.query(
    _E + _SYMBOL_PROFILE + ", ep AS (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT node FROM np) AND dst IN (SELECT node FROM np)), "
    "al AS (SELECT src, dst FROM ep UNION SELECT al.src, ep.dst FROM al JOIN ep ON ep.src = al.dst), cy AS (SELECT src AS node FROM al WHERE src = dst), rs AS (SELECT node FROM cy UNION SELECT src FROM al WHERE dst IN (SELECT node FROM cy)), "
    "un AS (SELECT src AS a, dst AS b FROM ep WHERE src IN (SELECT node FROM rs) AND dst IN (SELECT node FROM rs)), cc AS (SELECT node AS a, node AS b FROM rs UNION SELECT cc.a, CASE WHEN un.a = cc.b THEN un.b ELSE un.a END FROM cc JOIN un ON un.a = cc.b OR un.b = cc.b), "
    "sc AS (SELECT node AS n, node AS m FROM np WHERE node NOT IN (SELECT node FROM rs) UNION SELECT a, b FROM cc), "
    "rx AS (SELECT n, m AS x FROM sc UNION SELECT sc.n, al.dst FROM sc JOIN al ON al.src = sc.m) "
    "SELECT rx.n AS node, max(p.level)::BIGINT AS level, array_to_string(list_sort(list_distinct(flatten(list(p.items)))), ';') AS items, bool_or(rx.n IN (SELECT node FROM rs)) AS residual FROM rx JOIN np p ON p.node = rx.x GROUP BY 1"
)
def gr8_gr9_gr10_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity and touched resources of every symbol with those of what it calls."""
    out = G.propagate(_profiled(spark, sf_dir), corpus.call_edges(spark, sf_dir))
    return out.select("node", F.col("level").cast("long").alias("level"), F.array_join("items", ";").alias("items"), "residual")


@r.query(
    _E + _SYMBOL_PROFILE + " SELECT DISTINCT e.dst AS target, e.src AS symbol, ['pure', 'read_only', 'read_write', 'side_effecting'][p.level + 1] AS purity_class, CASE WHEN p.level <= 1 THEN 0.80 ELSE 0.50 END::DOUBLE AS confidence FROM e JOIN np p ON p.node = e.src"
)
def blr2_behavioral_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers whose purity a change of the callee could spoil."""
    p = _profiled(spark, sf_dir).select(F.col("node").alias("src"), "level")
    names = F.array(*[F.lit(x) for x in ("pure", "read_only", "read_write", "side_effecting")])
    return corpus.call_edges(spark, sf_dir).join(p, "src").select(F.col("dst").alias("target"), F.col("src").alias("symbol"), F.element_at(names, F.col("level") + 1).alias("purity_class"), F.when(F.col("level") <= 1, 0.80).otherwise(0.50).alias("confidence")).distinct()


@r.query(_E + ", un AS (SELECT DISTINCT src AS a, dst AS b FROM e), cc AS (SELECT a AS n, a AS m FROM un UNION SELECT b, b FROM un UNION SELECT cc.n, CASE WHEN un.a = cc.m THEN un.b ELSE un.a END FROM cc JOIN un ON un.a = cc.m OR un.b = cc.m) SELECT n AS node, min(m) AS component FROM cc GROUP BY 1")
def gr13_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(corpus.call_edges(spark, sf_dir))


@r.query(_E + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT s.symbol_id, count(*) AS n_versions FROM v s JOIN n ON n.id = s.symbol_version_id GROUP BY 1")
def jn9_semi_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that stand at either end of a call: both columns as one, then a semi join."""
    e = corpus.call_edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("symbol_version_id")).union(e.select("dst"))
    return corpus.versions(spark, sf_dir, "symbol_id").join(ends, "symbol_version_id", "left_semi").groupBy("symbol_id").agg(F.count("*").alias("n_versions"))


@r.query(_E + ", nm AS (SELECT v.symbol_version_id, s.canonical_name, s.kind FROM v JOIN symbols s USING (symbol_id)) SELECT e.src, a.canonical_name AS src_name, e.dst, b.canonical_name AS dst_name, b.kind AS dst_kind FROM e JOIN nm a ON a.symbol_version_id = e.src JOIN nm b ON b.symbol_version_id = e.dst")
def jn3_named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus.versions(spark, sf_dir, "symbol_id").join(table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name", "kind"), "symbol_id")
    side = lambda x: names.select(F.col("symbol_version_id").alias(x), F.col("canonical_name").alias(f"{x}_name"), F.col("kind").alias(f"{x}_kind"))
    return corpus.call_edges(spark, sf_dir).join(side("src"), "src").join(side("dst"), "dst").select("src", "src_name", "dst", "dst_name", "dst_kind")


@r.query(
    f"WITH RECURSIVE {SNAPSHOTS}, ch AS (SELECT snapshot_id AS s0, snapshot_id AS s1, 0 AS depth FROM sn UNION ALL SELECT ch.s0, sn.parent_snapshot_id, depth + 1 FROM ch JOIN sn ON sn.snapshot_id = ch.s1 JOIN sn p ON p.snapshot_id = sn.parent_snapshot_id WHERE depth < 100) SELECT s0 AS snapshot_id, s1 AS ancestor_snapshot_id, min(depth)::BIGINT AS depth FROM ch WHERE depth > 0 GROUP BY 1, 2"
)
def gr7_ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of each snapshot up to a hundred steps away."""
    rows = corpus.snapshots(spark, sf_dir).select(F.col("snapshot_id").alias("node"), F.col("parent_snapshot_id").alias("parent"))
    links = rows.join(rows.select(F.col("node").alias("parent")), "parent", "left_semi")
    return ancestors(links).select(F.col("node").alias("snapshot_id"), F.col("ancestor").alias("ancestor_snapshot_id"), "depth")


@r.query(
    _E + ", f AS (SELECT file_id, max(path) AS path FROM files GROUP BY 1), t AS (SELECT v.symbol_version_id FROM v JOIN f USING (file_id) WHERE contains(f.path, '.test.') OR contains(f.path, '.spec.') OR contains(f.path, '__tests__')) SELECT e.dst AS symbol, count(*) AS n_tests, string_agg(e.src, ',' ORDER BY e.src) AS tests FROM e JOIN t ON t.symbol_version_id = e.src GROUP BY 1"
)
def gr6_gr16_tests_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test code that calls a symbol, from the test's side turned round."""
    return test_callers(spark, sf_dir).groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("n_tests"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("tests"))


def test_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls (src, dst) that come from test files."""
    return corpus.call_edges(spark, sf_dir).join(test_versions(spark, sf_dir), "src", "left_semi")


def test_versions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(src): versions in test files, with the named columns."""
    paths = table(spark, sf_dir, "files").groupBy("file_id").agg(F.max("path").alias("path")).where(is_test_path(F.col("path")))
    return corpus.versions(spark, sf_dir, "file_id", *columns).join(paths, "file_id", "left_semi").select(F.col("symbol_version_id").alias("src"), *columns)


QUERIES, SQL = r.queries, r.sql
