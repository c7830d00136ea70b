"""Behavior, contracts, effects, invariants and uncertainty of symbol versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions import patterns as P
from sedgewire.functions import text as T
from sedgewire.operators import behavior as B
from sedgewire.operators import corpus
from sedgewire.plans.registry import BODY_STEPS, IN_TIME, LANG, TIMED, VERSIONS, Registry
from sedgewire.runtime import table

r = Registry()

_LB = "lb AS (SELECT body_hash, max(body_source) AS body_source, max(" + LANG.format("language") + ") AS language FROM symbol_versions WHERE body_hash IS NOT NULL AND body_source IS NOT NULL GROUP BY 1)"
_HINTS = _LB + ", ln AS (SELECT body_hash, language, i AS line_no, ls[i] AS line FROM (SELECT body_hash, language, string_split(body_source, chr(10)) AS ls, unnest(range(1, len(string_split(body_source, chr(10))) + 1)) AS i FROM lb)), " + (
    "hh AS (SELECT body_hash, line_no, unnest(" + P.matches_sql("line", "language", P.HINTS) + ") AS h FROM ln WHERE trim(line) <> ''), h AS (SELECT body_hash, line_no, split_part(h, '|', 1) AS hint_type, split_part(h, '|', 2) AS detail FROM hh)"
)
_LEVEL = "CASE WHEN list_has_any(k, ['network_call', 'transaction', 'acquires_lock', 'concurrency']) THEN 3 WHEN list_has_any(k, ['db_write', 'state_mutation', 'file_io', 'cache_write']) THEN 2 WHEN list_has_any(k, ['db_read', 'cache_op', 'auth_check']) THEN 1 ELSE 0 END"
_TOUCH = "CASE hint_type " + " ".join(f"WHEN '{k}' THEN '{v}' || detail" for k, v in B.TOUCH.items()) + " END"
_PROFILE = _HINTS + f", pk AS (SELECT body_hash, list(DISTINCT hint_type) AS k, list_sort(list(DISTINCT {_TOUCH}) FILTER ({_TOUCH} IS NOT NULL)) AS touches, list_sort(list(DISTINCT hint_type || ':' || detail) FILTER (hint_type IN ('throws', 'catches'))) AS exc FROM h GROUP BY 1), " + (
    f"pf AS (SELECT lb.body_hash, {_LEVEL} AS level, coalesce(touches, []) AS touches, coalesce(exc, []) AS exc FROM lb LEFT JOIN pk USING (body_hash))"
)


def language_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "symbol_versions").where("body_hash is not null and body_source is not null")
    return rows.groupBy("body_hash").agg(F.max("body_source").alias("body_source"), F.max(T.language(F.col("language"))).alias("language"))


def body_profiles(spark: SparkSession, sf_dir: str, bodies: DataFrame | None = None) -> DataFrame:
    """Profiles of all bodies; ``bodies``: ``language_bodies`` if they are stored already."""
    bodies = language_bodies(spark, sf_dir) if bodies is None else bodies
    return B.profiles(B.mine_hints(bodies), bodies)


def _joined(c: str):
    return F.array_join(c, ";").alias(c)


@r.query("WITH " + _HINTS + " SELECT body_hash, line_no::BIGINT AS line_no, hint_type, detail FROM h")
def beh1_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.mine_hints(language_bodies(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@r.query("WITH " + _PROFILE + " SELECT body_hash, ['pure', 'read_only', 'read_write', 'side_effecting'][level + 1] AS purity_class, array_to_string(touches, ';') AS resource_touches, array_to_string(exc, ';') AS exception_profile FROM pf")
def beh2_beh3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body_profiles(spark, sf_dir).select("body_hash", "purity_class", _joined("resource_touches"), _joined("exception_profile"))


_STEPS = BODY_STEPS.format("lb")


def _sided(df: DataFrame, side: str, key: str = "body_hash") -> DataFrame:
    return df.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != key])


@r.query("WITH " + _PROFILE + ", " + _STEPS + " SELECT symbol_id, st.a, st.b, CASE WHEN y.level > x.level THEN 'escalated' WHEN y.level < x.level THEN 'deescalated' ELSE 'same' END AS direction, array_to_string(list_sort(list_filter(y.touches, lambda t: NOT list_contains(x.touches, t))), ';') AS new_touches, array_to_string(list_sort(list_filter(x.touches, lambda t: NOT list_contains(y.touches, t))), ';') AS removed_touches FROM st JOIN pf x ON x.body_hash = st.a JOIN pf y ON y.body_hash = st.b WHERE st.a IS NOT NULL")
def beh4_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = body_profiles(spark, sf_dir).select("body_hash", "purity_level", "resource_touches")
    both = corpus.body_steps(spark, sf_dir).join(_sided(p, "a"), "a").join(_sided(p, "b"), "b")
    direction = F.when(F.col("purity_level_b") > F.col("purity_level_a"), "escalated").when(F.col("purity_level_b") < F.col("purity_level_a"), "deescalated").otherwise("same")
    new = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ";")
    return both.select("symbol_id", "a", "b", direction.alias("direction"), new("resource_touches_b", "resource_touches_a").alias("new_touches"), new("resource_touches_a", "resource_touches_b").alias("removed_touches"))


_THROWN = "list_sort(list_distinct(regexp_extract_all(coalesce(body_source, ''), '(?:throw new|raise) (\\w+)', 1)))"
_TYPES = "list_filter(list_transform(string_split(regexp_extract(signature, '\\((.*)\\)', 1), ','), lambda p: trim(string_split(p, ':')[-1])), lambda p: p <> '')"
_CONTRACT = (
    f"ct AS (SELECT symbol_version_id, symbol_id, CASE WHEN len({_TYPES}) > 0 THEN '(' || array_to_string({_TYPES}, ', ') || ')' ELSE 'void' END AS input_contract, CASE WHEN trim(regexp_extract(signature, '\\)\\s*(?::|->)\\s*(.+)$', 1)) = '' THEN 'void' ELSE trim(regexp_extract(signature, '\\)\\s*(?::|->)\\s*(.+)$', 1)) END AS output_contract, "
    f"CASE WHEN len({_THROWN}) > 0 THEN array_to_string({_THROWN}, ' | ') ELSE 'never' END AS error_contract FROM v WHERE signature IS NOT NULL)"
)


def thrown_types(body):
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:throw new|raise) (\w+)"), F.lit(1))))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.versions(spark, sf_dir, "symbol_id", "signature", "body_source").where("signature is not null")
    thrown = thrown_types(F.coalesce("body_source", F.lit("")))
    return rows.select("symbol_version_id", "symbol_id", *B.contract(F.col("signature"), thrown))


@r.query(f"WITH {VERSIONS}, {_CONTRACT} SELECT symbol_version_id, input_contract, output_contract, error_contract FROM ct")
def con1_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).drop("symbol_id")


@r.query(
    f"WITH {VERSIONS}, {TIMED}, {_CONTRACT}, w AS (SELECT ct.*, t, snapshot_id, lag(symbol_version_id) OVER o AS prev, lag(input_contract) OVER o AS i0, lag(output_contract) OVER o AS o0, lag(error_contract) OVER o AS e0 FROM ct JOIN (SELECT symbol_version_id, t, snapshot_id FROM vt) USING (symbol_version_id) WINDOW o AS " + IN_TIME + ") "
    "SELECT prev AS before_id, symbol_version_id AS after_id, input_contract IS DISTINCT FROM i0 AS input_changed, output_contract IS DISTINCT FROM o0 AS output_changed, error_contract IS DISTINCT FROM e0 AS error_changed FROM w WHERE prev IS NOT NULL"
)
def con4_dif2_compare_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.in_time()
    rows = contracts(spark, sf_dir).join(corpus.timed_versions(spark, sf_dir), "symbol_version_id")
    changed = lambda c: (~F.col(c).eqNullSafe(F.lag(c).over(w))).alias(c.split("_")[0] + "_changed")
    return rows.select(F.lag("symbol_version_id").over(w).alias("before_id"), F.col("symbol_version_id").alias("after_id"), changed("input_contract"), changed("output_contract"), changed("error_contract")).where("before_id is not null")


_INVARIANTS = (
    f"iv AS (SELECT symbol_id AS scope, 'throws ' || unnest({_THROWN}) AS expression, 0.80 AS strength FROM v UNION ALL "
    "SELECT symbol_id, 'guard ' || unnest(list_distinct(regexp_extract_all(coalesce(body_source, ''), 'if \\(!(\\w+) \\|\\|', 1))), 0.75 FROM v UNION ALL "
    "SELECT symbol_id, 'not null ' || unnest(list_distinct(regexp_extract_all(coalesce(body_source, ''), '(\\w+) == (?:null|nil)\\b', 1))), 0.80 FROM v UNION ALL "
    "SELECT symbol_id, 'below ' || unnest(list_distinct(regexp_extract_all(coalesce(body_source, ''), '\\w+\\.\\w+ < (\\d+)', 1))), 0.83 FROM v)"
)


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, expression, strength) mined from bodies, the strongest of equal ones kept."""
    rows = corpus.versions(spark, sf_dir, "symbol_id", "body_source").where("body_source is not null").select(F.col("symbol_id").alias("scope"), "body_source").distinct()
    rules = (("throws ", r"(?:throw new|raise) (\w+)", 0.80), ("guard ", r"if \(!(\w+) \|\|", 0.75), ("not null ", r"(\w+) == (?:null|nil)\b", 0.80), ("below ", r"\w+\.\w+ < (\d+)", 0.83))

    def mine(prefix: str, rx: str, strength: float):
        return F.transform(F.array_distinct(F.regexp_extract_all("body_source", F.lit(rx), F.lit(1))), lambda x: F.struct(F.concat(F.lit(prefix), x).alias("expression"), F.lit(strength).alias("strength")))

    mined = F.flatten(F.array(*[mine(*rule) for rule in rules]))
    return rows.select("scope", F.explode(mined).alias("i")).groupBy("scope", F.col("i.expression").alias("expression")).agg(F.max("i.strength").alias("strength"))


@r.query(f"WITH {VERSIONS}, {_INVARIANTS} SELECT scope, expression, max(strength)::DOUBLE AS strength FROM iv GROUP BY 1, 2")
def con2_dct1_dct6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants(spark, sf_dir)


@r.query(f"WITH {VERSIONS}, {_INVARIANTS} SELECT scope AS symbol_id, count(DISTINCT expression) AS n FROM iv GROUP BY 1")
def ag9_con3_invariant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants(spark, sf_dir).groupBy(F.col("scope").alias("symbol_id")).agg(F.count("*").alias("n"))


@r.query(
    f"WITH {VERSIONS}, {_INVARIANTS}, g AS (SELECT DISTINCT scope, expression, max(strength) OVER (PARTITION BY scope, expression) AS s FROM iv), k AS (SELECT split_part(expression, ' ', 1) AS category, expression, count(DISTINCT scope) AS n, max(s) AS s FROM g GROUP BY 1, 2 HAVING count(DISTINCT scope) >= 3) "
    "SELECT category, expression, n AS n_symbols, round(least(0.95, s + 0.05 * log2(n)), 6) AS family_strength, CASE WHEN n >= 10 THEN round(least(0.98, least(0.95, s + 0.05 * log2(n)) + 0.05), 6) END AS global_strength FROM k"
)
def dct4_families_of_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants that three symbols or more share; from ten on they are global."""
    k = invariants(spark, sf_dir).groupBy(F.substring_index("expression", " ", 1).alias("category"), "expression").agg(F.countDistinct("scope").alias("n_symbols"), F.max("strength").alias("s")).where("n_symbols >= 3")
    family = F.least(F.lit(0.95), F.col("s") + 0.05 * F.log2("n_symbols"))
    return k.select("category", "expression", "n_symbols", F.round(family, 6).alias("family_strength"), F.when(F.col("n_symbols") >= 10, F.round(F.least(F.lit(0.98), family + 0.05), 6)).alias("global_strength"))


@r.query("WITH " + _LB + ", p AS (SELECT body_hash, unnest(regexp_extract_all(body_source, 'if \\((.{3,80}?)\\) \\{', 1)) AS predicate FROM lb) SELECT trim(regexp_replace(regexp_replace(predicate, '(?i)\\b[a-z_]\\w*\\b', '_VAR', 'g'), '\\s+', ' ', 'g')) AS shape, count(*) AS n, count(DISTINCT body_hash) AS n_bodies FROM p GROUP BY 1")
def st24_predicate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_bodies(spark, sf_dir).select("body_hash", F.explode(F.regexp_extract_all("body_source", F.lit(r"if \((.{3,80}?)\) \{"), F.lit(1))).alias("predicate"))
    return found.groupBy(T.predicate_shape(F.col("predicate"), F.lit("guard_clause_check")).alias("shape")).agg(F.count("*").alias("n"), F.countDistinct("body_hash").alias("n_bodies"))


_EFF = _LB + ", ef AS (SELECT body_hash, list_sort(list_distinct(list_transform(" + P.matches_sql("body_source", "language", P.EFFECT_PATTERNS) + ", lambda x: replace(x, '|', ':')))) AS e FROM lb)"
_HAS = "len(list_filter(e, lambda x: starts_with(x, '{0}:'))) > 0"
_CLASS = "CASE WHEN " + " OR ".join(_HAS.format(k) for k in ("emits", "acquires_lock")) + " OR len(list_filter(e, lambda x: starts_with(x, 'writes:') AND contains(x, 'transaction'))) > 0 THEN 'full_side_effect' WHEN " + _HAS.format("calls_external") + " THEN 'io' WHEN " + " OR ".join(_HAS.format(k) for k in ("writes", "mutates", "opens")) + " THEN 'writer' WHEN " + " OR ".join(_HAS.format(k) for k in ("reads", "requires", "throws", "normalizes", "logs")) + " THEN 'reader' ELSE 'pure' END"


def body_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_bodies(spark, sf_dir).select("body_hash", B.effects_of_text(F.col("body_source"), F.col("language")).alias("effects"))


@r.query("WITH " + _EFF + " SELECT body_hash, array_to_string(e, ';') AS effects, " + _CLASS + " AS effect_class FROM ef")
def eff4_eff5_eff6_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body_effects(spark, sf_dir).select("body_hash", _joined("effects"), B.effect_class(F.col("effects")).alias("effect_class"))


@r.query(
    "WITH " + _HINTS + ", m AS (SELECT body_hash, unnest(CASE hint_type WHEN 'db_read' THEN ['reads:db.' || detail] WHEN 'db_write' THEN ['writes:db.' || detail] WHEN 'network_call' THEN ['calls_external:network.' || detail] WHEN 'file_io' THEN ['opens:file.' || detail] "
    "WHEN 'cache_op' THEN [CASE WHEN regexp_matches(detail, '(?i)set|write|del|put|clear|invalidate|expire') THEN 'writes:cache.' ELSE 'reads:cache.' END || detail] WHEN 'auth_check' THEN ['requires:auth.' || detail] WHEN 'validation' THEN ['normalizes:validation.' || detail] WHEN 'throws' THEN ['throws:error.' || detail] "
    "WHEN 'state_mutation' THEN ['mutates:state.' || detail] WHEN 'transaction' THEN ['writes:transaction.' || detail, 'acquires_lock:transaction.' || detail] ELSE [] END) AS x FROM h), ef AS (SELECT lb.body_hash, coalesce(list_sort(list(DISTINCT x) FILTER (x IS NOT NULL)), []) AS e FROM lb LEFT JOIN m USING (body_hash) GROUP BY 1) SELECT body_hash, array_to_string(e, ';') AS effects, " + _CLASS + " AS effect_class FROM ef"
)
def eff1_eff3_profile_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = body_profiles(spark, sf_dir).select("body_hash", B.effects_of_profile().alias("effects"))
    return e.select("body_hash", _joined("effects"), B.effect_class(F.col("effects")).alias("effect_class"))


@r.query(f"WITH {VERSIONS}, {_CONTRACT}, x AS (SELECT symbol_version_id, trim(unnest(string_split(error_contract, '|'))) AS t FROM ct WHERE error_contract <> 'never') SELECT symbol_version_id, string_agg(DISTINCT d, ';' ORDER BY d) AS effects FROM (SELECT symbol_version_id, 'throws:error.' || regexp_replace(regexp_replace(lower(t), '\\s+', '_', 'g'), '[^a-z0-9_.-]', '', 'g') AS d FROM x WHERE t <> '') GROUP BY 1")
def eff2_contract_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects that a version's error contract states: each error type it may throw."""
    rows = contracts(spark, sf_dir).where("error_contract <> 'never'").select("symbol_version_id", F.explode(F.split("error_contract", r"\|")).alias("t")).where("trim(t) <> ''")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("t")), r"\s+", "_"), r"[^a-z0-9_.-]", "")
    return rows.groupBy("symbol_version_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("throws:error."), plain))), ";").alias("effects"))


@r.query("WITH " + _EFF + ", " + _STEPS + " SELECT symbol_id, st.a, st.b, array_to_string(list_sort(list_filter(y.e, lambda t: NOT list_contains(x.e, t))), ';') AS added, array_to_string(list_sort(list_filter(x.e, lambda t: NOT list_contains(y.e, t))), ';') AS removed FROM st JOIN ef x ON x.body_hash = st.a JOIN ef y ON y.body_hash = st.b WHERE st.a IS NOT NULL")
def eff8_effect_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = body_effects(spark, sf_dir)
    both = corpus.body_steps(spark, sf_dir).join(_sided(e, "a"), "a").join(_sided(e, "b"), "b")
    less = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ";")
    return both.select("symbol_id", "a", "b", less("effects_b", "effects_a").alias("added"), less("effects_a", "effects_b").alias("removed"))


@r.query(f"WITH {VERSIONS}, x AS (SELECT symbol_id, symbol_version_id, 0.50 + CASE WHEN signature IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN body_source IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 0.20 ELSE 0 END AS c FROM v) SELECT symbol_id, max(symbol_version_id) AS symbol_version_id, round(least(0.95, max(c)), 4)::DOUBLE AS confidence FROM x WHERE c = (SELECT max(y.c) FROM x y WHERE y.symbol_id = x.symbol_id) GROUP BY 1")
def eff7_eff9_best_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each symbol whose signature rests on most evidence."""
    have = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    rows = corpus.versions(spark, sf_dir, "symbol_id", "signature", "body_source", "summary").select("symbol_id", "symbol_version_id", (F.lit(0.50) + have("signature", 0.15) + have("body_source", 0.10) + have("summary", 0.20)).alias("c"))
    best = rows.groupBy("symbol_id").agg(F.max(F.struct("c", "symbol_version_id")).alias("m"))
    return best.select("symbol_id", "m.symbol_version_id", F.round(F.least(F.lit(0.95), F.col("m.c")), 4).alias("confidence"))


_IMPACT = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.IMPACT.items()) + " ELSE 0.05 END"


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, round(greatest(0.10, list_product(list_prepend(1.0, list_transform(list_distinct(coalesce(uncertainty_flags, [])), lambda f: 1 - {_IMPACT.format('f')})))), 6) AS confidence FROM v")
def unc1_symbol_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "uncertainty_flags").select("symbol_version_id", F.round(B.symbol_confidence(F.col("uncertainty_flags")), 6).alias("confidence"))


@r.query(f"WITH {VERSIONS}, x AS (SELECT snapshot_id, unnest(uncertainty_flags) AS flag FROM v), n AS (SELECT snapshot_id, flag, count(*) AS n, {_IMPACT.format('flag')} AS i FROM x WHERE flag IS NOT NULL GROUP BY 1, 2), s AS (SELECT snapshot_id, greatest(0.10, exp(sum(ln(1 - i) + (n - 1) * ln(1 - 0.3 * i)))) AS c FROM n GROUP BY 1) SELECT snapshot_id, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM s")
def unc2_unc3_st29_snapshot_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = corpus.versions(spark, sf_dir, "snapshot_id", "uncertainty_flags").select("snapshot_id", F.explode("uncertainty_flags").alias("flag")).where("flag is not null")
    return B.snapshot_confidence(flags, "snapshot_id").select("snapshot_id", F.round("confidence", 6).alias("confidence"), T.confidence_band(F.col("confidence")).alias("band"))


def _family(rules: list):
    def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Invariants of one family that bodies state, each once per body."""
        found = language_bodies(spark, sf_dir).select("body_hash", F.explode(P.invariants(F.col("body_source"), rules)).alias("i"))
        return found.select("body_hash", "i.*").distinct()

    return mined


for _name, _rules in P.INVARIANTS.items():
    _mined = _family(_rules)
    _mined.__name__ = f"dct3_{_name}" if _name == "decorators" else f"dct1_{_name}"
    r.query("WITH " + _LB + ", x AS (SELECT body_hash, unnest(" + P.invariants_sql("body_source", _rules) + ") AS i FROM lb) SELECT DISTINCT body_hash, i.category, i.expression, i.strength FROM x")(_mined)

# both bounds of one name in one condition; a pattern without a reference back, so that both engines read it
_BOTH_BOUNDS = r"if\s*\(\s*([\w.]+)\s*(<|>|<=|>=)\s*(-?\d+(?:\.\d+)?)\s*(?:\|\||&&)\s*([\w.]+)\s*(<|>|<=|>=)\s*(-?\d+(?:\.\d+)?)\s*\)"


@r.query("WITH " + _LB + f", x AS (SELECT body_hash, unnest(regexp_extract_all(body_source, '{_BOTH_BOUNDS}')) AS m FROM lb) SELECT DISTINCT body_hash, 'range_check:' || regexp_replace(m, '{_BOTH_BOUNDS}', '\\1 \\2 \\3 and \\1 \\5 \\6') AS expression, 0.85::DOUBLE AS strength FROM x WHERE regexp_extract(m, '{_BOTH_BOUNDS}', 1) = regexp_extract(m, '{_BOTH_BOUNDS}', 4)")
def dct1_range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_bodies(spark, sf_dir).select("body_hash", F.explode(F.regexp_extract_all("body_source", F.lit(_BOTH_BOUNDS), F.lit(0))).alias("m")).where(F.regexp_extract("m", _BOTH_BOUNDS, 1) == F.regexp_extract("m", _BOTH_BOUNDS, 4))
    return found.select("body_hash", F.concat(F.lit("range_check:"), F.regexp_replace("m", _BOTH_BOUNDS, "$1 $2 $3 and $1 $5 $6")).alias("expression"), F.lit(0.85).alias("strength")).distinct()


_SWITCH, _CASE = r"switch\s*\(\s*([\w.]+)\s*\)\s*\{([\s\S]*)", r"""case\s+['"`]?([\w.]+)['"`]?\s*:"""


@r.query("WITH " + _LB + f", x AS (SELECT body_hash, regexp_extract(body_source, '{_SWITCH}', 1) AS name, regexp_extract_all(regexp_extract(body_source, '{_SWITCH}', 2), '{_CASE.replace(chr(39), chr(39) * 2)}', 1) AS v FROM lb) SELECT body_hash, 'enum_restriction:' || name || ' in {{' || array_to_string(v, ', ') || '}}' AS expression, 0.82::DOUBLE AS strength FROM x WHERE name <> '' AND len(v) BETWEEN 2 AND 50")
def dct1_switch_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the first switch of a body tells apart, two to fifty (the rule's own bounds)."""
    found = language_bodies(spark, sf_dir).select("body_hash", F.regexp_extract("body_source", _SWITCH, 1).alias("name"), F.regexp_extract_all(F.regexp_extract("body_source", _SWITCH, 2), F.lit(_CASE), F.lit(1)).alias("v"))
    return found.where((F.col("name") != "") & F.size("v").between(2, 50)).select("body_hash", F.concat(F.lit("enum_restriction:"), "name", F.lit(" in {"), F.array_join("v", ", "), F.lit("}")).alias("expression"), F.lit(0.82).alias("strength"))


QUERIES, SQL = r.queries, r.sql
