"""Runtime evidence, dispatch and the sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions import text as T
from sedgewire.operators import corpus
from sedgewire.operators import dispatch as D
from sedgewire.operators import sequential as S
from sedgewire.operators.components import connected_components
from sedgewire.plans.registry import BODIES, VERSIONS, Registry
from sedgewire.runtime import table
from sedgewire.streaming import traces as R

r = Registry()

_OBSERVED = "p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS caller, event_type AS callee, ts, value FROM events), o AS (SELECT caller, callee, count(*) AS n, sum(value) AS w FROM p WHERE caller IS NOT NULL GROUP BY 1, 2)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consecutive(table(spark, sf_dir, "events")).groupBy("caller", "callee").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


@r.query(f"WITH {_OBSERVED} SELECT caller, callee, n, round(w, 4) AS weight, round(CASE WHEN caller <> 'error' AND callee <> 'error' THEN 0.90 ELSE 0.60 END + least(0.10, 0.03 * log10(n)), 6) AS confidence FROM o")
def rte2_observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed edges; an error end counts as unresolved."""
    resolved = (F.col("caller") != "error") & (F.col("callee") != "error")
    return _observed(spark, sf_dir).select("caller", "callee", "n", F.round("w", 4).alias("weight"), R.observed_confidence(resolved, F.col("n")).alias("confidence"))


@r.query(f"WITH {_OBSERVED}, s(caller, callee, c) AS (VALUES ('view', 'click', 0.7), ('click', 'purchase', 0.9), ('view', 'logout', 0.5)) SELECT coalesce(s.caller, o.caller) AS caller, coalesce(s.callee, o.callee) AS callee, round(CASE WHEN s.c IS NULL THEN least(1, 0.85 + 0.05 * log10(n)) WHEN n IS NULL THEN s.c ELSE least(1, s.c + 0.15) END, 6)::DOUBLE AS confidence, CASE WHEN s.c IS NULL THEN 'observed' WHEN n IS NULL THEN 'static' ELSE 'confirmed' END AS origin FROM s FULL JOIN o ON o.caller = s.caller AND o.callee = s.callee")
def rte3_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.createDataFrame([("view", "click", 0.7), ("click", "purchase", 0.9), ("view", "logout", 0.5)], "caller string, callee string, confidence double")
    return R.merge_observed(static, _observed(spark, sf_dir))


@r.query(f"WITH {_OBSERVED}, k AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY n DESC, callee) AS rank FROM o) SELECT caller, string_agg(callee, ',' ORDER BY rank) AS top_callees FROM k WHERE rank <= 5 GROUP BY 1")
def rte4_top_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most frequent callees, by which an unresolved call is settled."""
    from pyspark.sql import Window

    w = Window.partitionBy("caller").orderBy(F.desc("n"), "callee")
    ranked = _observed(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.groupBy("caller").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "callee"))), lambda x: x["callee"]), ",").alias("top_callees"))


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, array_to_string(list_sort(list_filter(coalesce(uncertainty_flags, []), lambda f: f NOT IN ('dynamic_import', 'eval_usage'))), ';') AS remaining FROM v")
def rte4_reduce_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags left once run-time evidence has settled the dynamic ones."""
    empty = F.array().cast("array<string>")
    return corpus.versions(spark, sf_dir, "uncertainty_flags").select("symbol_version_id", F.array_join(F.array_sort(F.filter(F.coalesce("uncertainty_flags", empty), lambda f: ~f.isin("dynamic_import", "eval_usage"))), ";").alias("remaining"))


@r.query("SELECT event_type, count(DISTINCT user_id) AS n_sources, round(least(0.30, 0.15 * least(count(DISTINCT user_id), 3)), 4)::DOUBLE AS boost, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def rte6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_sources"), day(F.min("ts")).alias("first_seen"), day(F.max("ts")).alias("last_seen"))
    return e.select("event_type", "n_sources", F.round(R.evidence_boost(F.col("n_sources")), 4).alias("boost"), "first_seen", "last_seen")


@r.query("SELECT event_type, count(*) AS n, sum(regexp_extract(props, '\"k\": *(\\d+)', 1)::BIGINT)::BIGINT AS total_k FROM events GROUP BY 1")
def src7_rte5_nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of the JSON of the events, by a stated schema."""
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total_k"))


_FACT_SQL = " UNION ALL ".join(f"SELECT body_hash, regexp_extract(m, '{rx}', 1) AS field, regexp_extract(m, '{rx}', 2) AS type, {c} AS c, '{n}' AS source FROM (SELECT body_hash, unnest(regexp_extract_all(body_source, '{rx}')) AS m FROM b)" for n, c, rx in D.FACTS)


@r.query(f"WITH {BODIES}, f AS ({_FACT_SQL}) SELECT body_hash AS owner, field, string_agg(DISTINCT type, ',' ORDER BY type) AS types, max(c)::DOUBLE AS confidence, max_by(source, (c, source)) AS source FROM f GROUP BY 1, 2")
def dsp1_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points_to(corpus.bodies(spark, sf_dir)).select("owner", "field", F.array_join("types", ",").alias("types"), "confidence", "source")


@r.query(f"WITH {BODIES}, l AS (SELECT body_hash AS owner, unnest(range(1, len(string_split(body_source, chr(10))) + 1)) AS n, string_split(body_source, chr(10)) AS ls FROM b) SELECT owner, n::BIGINT AS line_no, substring(unnest(regexp_extract_all(ls[n], '(?:this|self)((?:\\.\\w+)+)\\s*\\(', 1)), 2) AS chain FROM l")
def dsp2_callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.callsites(corpus.bodies(spark, sf_dir))


@r.query()
def dsp3_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = corpus.bodies(spark, sf_dir)
    last = F.element_at(F.split("logical_namespace", r"\."), -1)
    symbols = table(spark, sf_dir, "symbols").where("logical_namespace is not null")
    methods = symbols.where("kind in ('method', 'function')").select(last.alias("class"), F.col("canonical_name").alias("method"), F.col("symbol_id").alias("target"))
    homes = table(spark, sf_dir, "symbol_versions").select("symbol_id", F.col("body_hash").alias("owner")).join(symbols.select("symbol_id", last.alias("class")), "symbol_id").select("owner", "class").distinct()
    return D.resolve(D.callsites(bodies), D.points_to(bodies), homes, methods)


@r.query()
def gr11_gr12_method_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of a repository as classes, each derived from the one above it."""
    n = table(spark, sf_dir, "symbols").where("logical_namespace is not null").select("repo_id", F.col("logical_namespace").alias("class")).distinct()
    top = F.substring_index("class", ".", 1)
    parent = F.when(F.col("class").contains("."), F.regexp_replace("class", r"\.[^.]*$", ""))
    return S.method_resolution(n.select(F.concat_ws("/", "repo_id", top).alias("tree"), "class", parent.alias("parent"), F.lit(0).alias("position"))).select("tree", "class", F.array_join("mro", ">").alias("mro"), "consistent")


@r.query()
def gr14_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the call graph, the large or sparse ones split."""
    e = corpus.call_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = connected_components(e, "a", "b").withColumnRenamed("node", "a")
    return S.split_components(e.join(parts, "a").select("component", "a", "b", F.lit(1.0).alias("w")))


@r.query()
def st12_normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select("body_hash", S.normalized_hash(F.col("body_source")).alias("normalized_hash"))


@r.query()
def dct2_signature_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.versions(spark, sf_dir, "signature").where("signature is not null").select("symbol_version_id", F.explode(S.signature_invariants(F.col("signature"))).alias("i"))
    return rows.select("symbol_version_id", "i.expression", "i.strength")


@r.query()
def src4_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "files").where("path rlike '[.]pyw?$'").select("file_id").distinct()
    return S.extract_python(table(spark, sf_dir, "file_texts").join(paths, "file_id", "left_semi"))


@r.query(
    "WITH f AS (SELECT file_id, max(path) AS path FROM files GROUP BY 1), t AS (SELECT file_id, unnest(regexp_extract_all(source_text, '(?:function|func|def|class)\\s+(\\w+)', 1)) AS name FROM file_texts WHERE source_text IS NOT NULL) SELECT file_id, regexp_extract(path, '\\.([a-z]+)$', 1) AS extension, name, count(*) AS n FROM t JOIN f USING (file_id) GROUP BY 1, 2, 3"
)
def src3_src5_declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names declared in source files of every language, by pattern."""
    paths = table(spark, sf_dir, "files").groupBy("file_id").agg(F.max("path").alias("path"))
    names = table(spark, sf_dir, "file_texts").select("file_id", F.explode(F.regexp_extract_all("source_text", F.lit(r"(?:function|func|def|class)\s+(\w+)"), F.lit(1))).alias("name"))
    return names.join(paths, "file_id").groupBy("file_id", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("extension"), "name").agg(F.count("*").alias("n"))


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(trim(regexp_extract(signature, '\\)\\s*(?::|->)\\s*(.+)$', 1)), '^(?:Optional|Promise|Awaitable|Union)\\s*[<\\[](.*)[>\\]]$', '\\1'), '\\s*[|,]\\s*'), lambda p: trim(regexp_replace(p, '[<\\[].*$', ''))), lambda p: p NOT IN ('', 'string', 'number', 'boolean', 'void', 'null', 'undefined', 'any', 'unknown', 'never', 'int', 'str', 'float', 'bool', 'None')), ',') AS classes FROM v WHERE signature IS NOT NULL")
def st22_union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.versions(spark, sf_dir, "signature").where("signature is not null")
    return rows.select("symbol_version_id", F.array_join(T.union_members(T.return_type(F.col("signature"))), ",").alias("classes"))


QUERIES, SQL = r.queries, r.sql
