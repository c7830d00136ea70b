"""Homolog scores, families, lineage and semantic diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import hashing as H
from sedgewire.functions import text as T
from sedgewire.operators import behavior as B
from sedgewire.operators import corpus
from sedgewire.operators import homolog as O
from sedgewire.operators.components import connected_components
from sedgewire.plans.behaving import _CONTRACT, _HINTS, _LEVEL, _TOUCH, body_profiles, language_bodies, thrown_types
from sedgewire.plans.registry import BODIES, EDGES, FILES, IN_TIME, SNAPSHOTS, TIMED, VERSIONS, Registry
from sedgewire.plans.graphs import test_versions
from sedgewire.plans.history import _COMMITS, _PAIRS
from sedgewire.plans.textual import _JACC, _LOOSE, _TRI
from sedgewire.operators.temporal import commits_of_files
from sedgewire.runtime import store, table

r = Registry()

#: The newest version of each symbol, by its snapshot's time, stands for it.
_LATEST = f"{VERSIONS}, {TIMED}, lv AS (SELECT * FROM (SELECT vt.*, row_number() OVER (PARTITION BY symbol_id ORDER BY t DESC, snapshot_id DESC, symbol_version_id DESC) rn FROM vt) WHERE rn = 1)"


def latest_versions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = corpus.timed_versions(spark, sf_dir, "symbol_id", *columns)
    return rows.groupBy("symbol_id").agg(F.max(F.struct("t", "snapshot_id", "symbol_version_id", *columns)).alias("m")).select("symbol_id", "m.symbol_version_id", *[f"m.{c}" for c in columns])


_SIGNATURES = "sg AS (SELECT v.body_hash, max(sv.minhash_signature) AS s FROM semantic_vectors sv JOIN v USING (symbol_version_id) WHERE lower(sv.view_type) = 'body' AND sv.minhash_signature IS NOT NULL AND NOT list_bool_and(list_transform(sv.minhash_signature, lambda x: x = 4294967295)) GROUP BY 1)"
_PURITY = f"pk AS (SELECT body_hash, list(DISTINCT hint_type) AS k, list(DISTINCT {_TOUCH}) FILTER ({_TOUCH} IS NOT NULL) AS touches, list_sort(list(DISTINCT hint_type || ':' || detail) FILTER (hint_type IN ('throws', 'catches'))) AS exc, list_sort(list(DISTINCT detail) FILTER (hint_type = 'auth_check')) AS auth, list_sort(list(DISTINCT hint_type || detail) FILTER (hint_type IN ('db_read', 'db_write', 'network_call'))) AS io FROM h GROUP BY 1)"
_SYMBOLS = f"sb AS (SELECT lv.symbol_id AS id, s.repo_id, s.kind, s.canonical_name AS name, lv.body_hash, lv.ast_hash, lv.normalized_ast_hash, sg.s, ['pure', 'read_only', 'read_write', 'side_effecting'][coalesce({_LEVEL}, 0) + 1] AS purity FROM lv JOIN symbols s USING (symbol_id) LEFT JOIN pk ON pk.body_hash = lv.body_hash AND lv.body_source IS NOT NULL LEFT JOIN sg ON sg.body_hash = lv.body_hash)"
_STAR = "SELECT * FROM (SELECT min(id) OVER (PARTITION BY repo_id, {0}) AS a, id AS b FROM sb WHERE {0} IS NOT NULL) WHERE a <> b"
_NEXT = "SELECT id AS a, unnest(list(id) OVER (PARTITION BY repo_id, {0} ORDER BY id ROWS BETWEEN 1 FOLLOWING AND {1} FOLLOWING)) AS b FROM sb WHERE kind IS NOT NULL"
_BEST = "SELECT least(q, id) AS a, greatest(q, id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(x, 9) DESC, id) AS rn FROM {0}) WHERE rn <= 30"
_CANDIDATES = (
    f"fn AS (SELECT repo_id, name, min(id) AS id, {_TRI.format('name')} AS t FROM sb WHERE name IS NOT NULL GROUP BY 1, 2), fg AS (SELECT repo_id, id, len(t) AS n, unnest(t) AS g FROM fn), "
    "nn AS (SELECT * FROM (SELECT l.id AS q, r.id, count(*) / (l.n + r.n - count(*))::DOUBLE AS x FROM fg l JOIN fg r ON l.repo_id = r.repo_id AND l.g = r.g AND l.id <> r.id GROUP BY l.id, r.id, l.n, r.n) WHERE x >= 0.3), "
    "fs AS (SELECT repo_id, s, min(id) AS id FROM sb WHERE s IS NOT NULL GROUP BY 1, 2), fb AS (SELECT repo_id, id, s, i AS band, list_slice(s, i * 8 + 1, i * 8 + 8) AS piece FROM fs, range(16) x(i)), "
    "nb AS (SELECT DISTINCT l.id AS q, r.id, l.s AS ls, r.s AS rs FROM fb l JOIN fb r ON l.repo_id = r.repo_id AND l.band = r.band AND l.piece = r.piece AND l.id <> r.id), "
    "ns AS (SELECT q, id, list_sum(list_transform(range(1, 129), lambda i: CASE WHEN ls[i] = rs[i] THEN 1 ELSE 0 END)) / 128.0 AS x FROM nb), "
    "cd AS (" + " UNION ".join([_STAR.format(c) for c in O.CLASSES] + [_BEST.format("nn"), _BEST.format("ns"), _NEXT.format("purity, kind", O.PROFILES), _NEXT.format("kind", O.KINDS)]) + ")"
)
_BASE = f"WITH {_LATEST}, {_HINTS}, {_SIGNATURES}, {_PURITY}, {_SYMBOLS}, {_CANDIDATES}"


def _bodies(spark: SparkSession, sf_dir: str, callers: DataFrame | None = None) -> DataFrame:
    """``language_bodies``, stored, since they are read more than once; with ``callers`` (body_hash) whether one of these has the body."""
    bodies = language_bodies(spark, sf_dir)
    return store(bodies if callers is None else bodies.join(callers.select("body_hash").distinct().withColumn("calls", F.lit(True)), "body_hash", "left"))


def _thrown(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``thrown`` in place of ``lo`` and ``hi``, the least and greatest of a version's deliveries; where these differ, the greatest body decides."""
    if rows.where("lo <> hi").isEmpty():
        return rows.withColumn("thrown", F.col("hi")).drop("lo", "hi")
    texts = table(spark, sf_dir, "symbol_versions").join(rows.where("lo <> hi").select("symbol_version_id"), "symbol_version_id", "left_semi")
    settled = texts.groupBy("symbol_version_id").agg(F.array_join(thrown_types(F.max("body_source")), " | ").alias("settled"))
    return rows.join(settled, "symbol_version_id", "left").withColumn("thrown", F.coalesce("settled", "hi")).drop("lo", "hi", "settled")


def _newest(spark: SparkSession, sf_dir: str, bodies: DataFrame) -> DataFrame:
    """The newest version of each symbol of a repository with its symbol, profile, thrown types and signature, stored; no: numbers by repository and id; splits: blocks of its repository."""
    symbols = table(spark, sf_dir, "symbols").where("repo_id is not null").select(F.col("symbol_id").alias("id"), "repo_id", "kind", F.col("canonical_name").alias("name"))
    latest = latest_versions(spark, sf_dir).withColumnRenamed("symbol_id", "id").join(symbols, "id").orderBy("repo_id", "id").withColumn("no", F.monotonically_increasing_id())
    known = store(latest.withColumn("splits", O.splits(F.count("*").over(Window.partitionBy("repo_id")))))
    hashes = ("body_hash", "ast_hash", "normalized_ast_hash", "signature", "file_id")
    rows = table(spark, sf_dir, "symbol_versions").where("symbol_version_id is not null")
    thrown = F.array_join(thrown_types(F.col("body_source")), " | ")
    deliveries = rows.select("symbol_version_id", *hashes, F.col("body_source").isNotNull().alias("bodied"), thrown.alias("thrown"))
    wide = deliveries.groupBy("symbol_version_id").agg(*[F.max(c).alias(c) for c in hashes], F.max("bodied").alias("bodied"), F.min("thrown").alias("lo"), F.max("thrown").alias("hi"))
    profiles = body_profiles(spark, sf_dir, bodies).select(F.col("body_hash").alias("profiled"), "purity_class", "resource_touches", "exception_profile", "auth_operations", F.array_sort(F.concat("db_reads", "db_writes", "network_calls")).alias("io"))
    signed = H.packed(table(spark, sf_dir, "semantic_vectors").where("lower(view_type) = 'body' and minhash_signature is not null").select("symbol_version_id", F.col("minhash_signature").alias("s")), "s").where("s is not null")
    sigs = corpus.versions(spark, sf_dir, "body_hash").join(signed, "symbol_version_id").groupBy("body_hash").agg(F.max("s").alias("s"))
    empty = F.array().cast("array<string>")
    joined = known.join(wide, "symbol_version_id").withColumn("profiled", F.when(F.col("bodied"), F.col("body_hash"))).join(profiles, "profiled", "left").join(sigs, "body_hash", "left")
    newest = joined.select(
        "no", "splits", "id", "symbol_version_id", "file_id", "repo_id", "kind", "name", "body_hash", "ast_hash", "normalized_ast_hash", "signature", "lo", "hi", "s",
        F.coalesce("purity_class", F.lit("pure")).alias("purity"), *[F.coalesce(c, empty).alias(n) for c, n in (("resource_touches", "touches"), ("exception_profile", "exc"), ("auth_operations", "auth"), ("io", "io"))],
    )
    return _thrown(spark, sf_dir, store(newest))


@r.query(f"{_BASE} SELECT a, b FROM cd")
def hom1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.candidates(_newest(spark, sf_dir, language_bodies(spark, sf_dir)))


_SIG_SCORE = "CASE WHEN x.signature IS NULL OR y.signature IS NULL OR x.signature = '' OR y.signature = '' THEN 0 WHEN x.signature = y.signature THEN 1 ELSE least(1, 0.4 * CASE WHEN greatest(x.np, y.np) = 0 THEN 1 ELSE least(x.np, y.np)::DOUBLE / greatest(x.np, y.np) END + CASE WHEN x.rt <> '' AND x.rt = y.rt THEN 0.4 ELSE 0 END + CASE WHEN len(x.sw) > 0 AND len(y.sw) > 0 THEN 0.2 * " + _JACC.format("x.sw", "y.sw") + " ELSE 0 END) END"
_SCORED = (
    f"{_BASE}, {_CONTRACT}, {FILES}, {BODIES}, {EDGES}, {_COMMITS}, {_PAIRS}, "
    "ts AS (SELECT v.symbol_version_id FROM v JOIN (SELECT file_id, max(path) AS path FROM files GROUP BY 1) p USING (file_id) WHERE contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__')), "
    "tb AS (SELECT e.dst, list(DISTINCT e.src) AS tests FROM e JOIN ts ON ts.symbol_version_id = e.src GROUP BY 1), "
    "sy AS (SELECT sb.*, lv.signature, f.path, coalesce(tb.tests, []) AS tests, coalesce(pk.touches, []) AS touches, coalesce(pk.exc, []) AS exc, coalesce(pk.auth, []) AS auth, coalesce(pk.io, []) AS io, ct.input_contract AS ci, ct.output_contract AS co, ct.error_contract AS ce, "
    f"{_LOOSE.format('sb.name')} AS nw, "
    "len(list_filter(string_split(regexp_extract(lv.signature, '\\((.*?)\\)', 1), ','), lambda p: p <> '')) AS np, trim(string_split(lv.signature, ':')[-1]) AS rt, list_distinct(list_filter(string_split_regex(lower(regexp_replace(lv.signature, '[(),:]', ' ', 'g')), '\\s+'), lambda t: length(t) > 1)) AS sw "
    "FROM sb JOIN lv ON lv.symbol_id = sb.id LEFT JOIN pk ON pk.body_hash = lv.body_hash AND lv.body_source IS NOT NULL LEFT JOIN ct ON ct.symbol_version_id = lv.symbol_version_id LEFT JOIN f ON f.file_id = lv.file_id LEFT JOIN tb ON tb.dst = lv.symbol_version_id), "
    "co2 AS (SELECT g, a, b, round(j, 3) AS j FROM pj WHERE j >= 0.25), "
    "sc AS (SELECT cd.a, cd.b, x.kind AS ka, y.kind AS kb, CASE WHEN x.body_hash = y.body_hash THEN 1.0 WHEN x.normalized_ast_hash = y.normalized_ast_hash THEN 0.90 WHEN x.ast_hash = y.ast_hash THEN 0.85 WHEN x.s IS NULL OR y.s IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 129), lambda i: CASE WHEN x.s[i] = y.s[i] THEN 1 ELSE 0 END)) / 128.0 END AS logic, "
    f"{_JACC.format('x.nw', 'y.nw')} AS name, {_SIG_SCORE} AS signature, CASE WHEN len(x.touches) = 0 AND len(y.touches) = 0 THEN CASE WHEN x.purity = y.purity AND x.purity <> 'pure' THEN 0.3 ELSE 0 END ELSE least(1, {_JACC.format('x.touches', 'y.touches')} + CASE WHEN x.purity = y.purity THEN 0.2 ELSE 0 END) END AS behavior, "
    "CASE WHEN x.ci IS NULL OR y.ci IS NULL THEN 0 ELSE ((x.ci = y.ci)::INT + (x.co = y.co)::INT + (x.ce = y.ce)::INT) / 3.0 END AS contract, "
    "least(1, 0.3 * len(list_intersect(x.tests, y.tests))) AS tests, coalesce(co2.j, 0) AS history, "
    "list_sort(list_filter([CASE WHEN x.purity <> y.purity THEN 'side_effects_differ' END, CASE WHEN x.exc <> y.exc THEN 'exception_semantics_differ' END, CASE WHEN x.auth <> y.auth THEN 'security_context_differs' END, CASE WHEN x.io <> y.io AND len(x.io) > 0 AND len(y.io) > 0 THEN 'io_shape_diverges' END], lambda f: f IS NOT NULL)) AS flags, "
    "len(x.auth) > 0 AND len(y.auth) > 0 AS auth2, len(list_filter(x.exc, lambda e: starts_with(e, 'throws:'))) > 0 AND len(list_filter(y.exc, lambda e: starts_with(e, 'throws:'))) > 0 AS thr2 "
    "FROM cd JOIN sy x ON x.id = cd.a JOIN sy y ON y.id = cd.b LEFT JOIN co2 ON co2.g = x.repo_id AND co2.a = least(x.path, y.path) AND co2.b = greatest(x.path, y.path)), "
    "tx AS (SELECT *, 0.20 * logic + 0.20 * name + 0.15 * signature + 0.15 * behavior + 0.15 * contract + 0.10 * tests + 0.05 * history AS raw, (logic > 0.1)::INT + (name > 0.1)::INT + (signature > 0.1)::INT + (behavior > 0.1)::INT + (contract > 0.1)::INT + (tests > 0.1)::INT + (history > 0.1)::INT AS fam FROM sc), "
    "hm AS (SELECT *, CASE WHEN logic >= 0.85 THEN greatest(raw, 0.85) ELSE raw END AS total, CASE WHEN logic >= 0.85 THEN greatest(fam, 3) ELSE fam END AS families FROM tx)"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    callers = store(test_versions(spark, sf_dir, "symbol_id", "snapshot_id", "body_hash"))
    bodies = _bodies(spark, sf_dir, callers)
    newest = _newest(spark, sf_dir, bodies)
    paths = corpus.files(spark, sf_dir, "path").select("file_id", "path")
    symbols = table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name")
    named = corpus.versions(spark, sf_dir, "symbol_id", "snapshot_id").join(symbols, "symbol_id")
    edges = corpus.calls_of(callers.join(symbols.select("symbol_id"), "symbol_id", "left_semi").select("snapshot_id", "body_hash", "src"), named, bodies.where("calls"), symbols)
    tests = edges.groupBy(F.col("dst").alias("symbol_version_id")).agg(F.collect_set(F.xxhash64("src")).alias("tests"))
    history = commits_of_files(table(spark, sf_dir, "git_commits")).withColumnsRenamed({"g": "repo_id", "file": "path"})
    stated = B.contract(F.col("signature"), F.array().cast("array<string>"))[:2]
    error = F.when(F.coalesce("thrown", F.lit("")) != "", F.col("thrown")).otherwise("never").alias("error_contract")
    has = F.col("signature").isNotNull()
    words, parts = T.loose_name_words(F.col("name")), T.signature_parts(F.col("signature"))
    stated_by = [F.when(has, c).alias(n) for c, n in zip([*stated, error], ("input_contract", "output_contract", "error_contract"))]
    # looked up by number only and stored, so that the wide rows are shuffled once and these shuffles end before the next begin
    placed = newest.select("no", "symbol_version_id", "file_id", "repo_id").join(tests, "symbol_version_id", "left").join(paths, "file_id", "left").join(history, ["repo_id", "path"], "left")
    joined = newest.join(store(placed.select("no", "path", "commits", "tests")), "no").select("*", words.alias("words"), parts.alias("parts"), *stated_by)
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    equal = ["body_hash", "ast_hash", "normalized_ast_hash", "path", "signature", "returns", "purity", "exc", "auth", "io", "input_contract", "output_contract", "error_contract"]
    sets = ["commits", "tests", "words", "touches", "signature_words"]
    one = joined.select(
        "no", "id", "repo_id", "kind", "s", *[F.to_json(c).alias(c) if c in ("exc", "auth", "io") else F.col(c) for c in equal if c != "returns"], F.nullif("parts.returns", F.lit("")).alias("returns"), *sets[:-1], F.col("parts.words").alias("signature_words"),
        (F.col("purity") == "pure").alias("pure"), F.coalesce(F.col("signature") != "", F.lit(False)).alias("signed"), *[F.coalesce(F.col(c) != "", F.lit(False)).alias(f"has_{c}") for c in equal[-3:]], (size("auth") > 0).alias("authorized"), (size("io") > 0).alias("reads"), F.exists("exc", lambda e: e.startswith("throws:")).alias("throws"),
        *[size(c).alias(f"n_{c}") for c in sets if c in ("commits", "words", "touches")], size("parts.words").alias("n_signature_words"), F.col("parts.params").alias("params"),
    )
    kept = [c for c in one.columns if c not in ("no", "repo_id", "s", *equal, *sets)]
    both = O.beside(one, store(O.candidates(newest.withColumn("id", F.col("no")))), equal, sets, kept).withColumnsRenamed({"id_a": "a", "id_b": "b"})
    two = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    all_two = lambda c: F.col(f"{c}_a") & F.col(f"{c}_b")
    same = lambda c: F.coalesce(f"same_{c}", F.lit(False))
    overlap = lambda c: T.jaccard_of(F.col(f"shared_{c}"), *two(f"n_{c}"))
    signatures = T.parts_similarity(two("params"), same("returns"), (F.col("n_signature_words_a") > 0) & (F.col("n_signature_words_b") > 0), overlap("signature_words"))
    changes = overlap("commits")
    scores = {
        "logic": O.logic_similarity(same("body_hash"), same("normalized_ast_hash"), same("ast_hash"), F.col("places")),
        "name": overlap("words"),
        "signature": F.when(~all_two("signed"), 0.0).when(same("signature"), 1.0).otherwise(signatures),
        "behavior": O.behavioral_overlap(*two("n_touches"), F.col("shared_touches"), same("purity"), F.col("pure_a")),
        "contract": O.contract_overlap([(*two(f"has_{c}"), same(c)) for c in equal[-3:]]),
        "tests": F.least(F.lit(1.0), 0.3 * F.col("shared_tests")),
        "history": F.when((F.col("shared_commits") >= 2) & ~F.coalesce("same_path", F.lit(True)) & (changes >= 0.25), F.round(changes, 3)).otherwise(0.0),
    }
    flags = O.contradictions(same("purity"), same("exc"), same("auth"), same("io"), all_two("reads"))
    named = both.select("a", "b", "kind_a", "kind_b", *[c.alias(f"e_{k}") for k, c in scores.items()], flags.alias("flags"), all_two("authorized").alias("auth2"), all_two("throws").alias("thr2"))
    kept = {k: F.col(f"e_{k}") for k in O.WEIGHTS}
    total, families = O.total_score(kept)
    return named.select("*", total.alias("total"), families.alias("families"), O.relation_type(kept, F.col("auth2"), F.col("thr2"), two("kind")).alias("relation_type"), O.rationale(kept).alias("rationale"))


@r.query(_SCORED + " SELECT a, b, round(logic, 6)::DOUBLE AS logic, round(name, 6)::DOUBLE AS name, round(signature, 6)::DOUBLE AS signature, round(behavior, 6)::DOUBLE AS behavior, round(contract, 6)::DOUBLE AS contract, round(tests, 6)::DOUBLE AS tests, round(history, 6)::DOUBLE AS history, round(total + 1e-9, 6)::DOUBLE AS total, families::BIGINT AS families FROM hm")
def hom2_to_hom8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("a", "b", *[F.round(f"e_{k}", 6).alias(k) for k in O.WEIGHTS], F.round(F.col("total") + 1e-9, 6).alias("total"), F.col("families").cast("long").alias("families"))


@r.query(
    _SCORED + " SELECT a, b, CASE WHEN logic >= 0.85 THEN 'near_duplicate_logic' WHEN ka = 'validator' AND kb = 'validator' THEN 'validator_homolog' WHEN ka = 'serializer' AND kb = 'serializer' THEN 'serializer_homolog' WHEN ka = 'query_builder' AND kb = 'query_builder' THEN 'query_logic_duplicate' WHEN behavior >= 0.60 AND auth2 THEN 'auth_policy_peer' WHEN contract >= 0.50 AND thr2 THEN 'error_mapping_peer' WHEN behavior >= 0.70 AND contract >= 0.50 THEN 'business_rule_parallel' WHEN contract >= 0.70 THEN 'contract_sibling' WHEN signature >= 0.80 THEN 'normalization_homolog' ELSE 'near_duplicate_logic' END AS relation_type, "
    "array_to_string(flags, ';') AS flags, round(total, 4)::DOUBLE AS confidence FROM hm WHERE families >= 2 AND total >= 0.60"
)
def hom9_to_hom12_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _scored(spark, sf_dir).where((F.col("families") >= O.LEAST_FAMILIES) & (F.col("total") >= O.LEAST_TOTAL))
    return kept.select("a", "b", "relation_type", F.array_join("flags", ";").alias("flags"), F.round("total", 4).alias("confidence"))


_WORDS = "CASE WHEN logic >= 0.85 THEN 'near-identical logic' WHEN logic > 0 THEN 'logic similarity: ' || round(logic * 100)::INT || '%' END, " + ", ".join(f"CASE WHEN {c} {least} THEN '{said}' END" for c, least, said in (("name", ">= 0.7", "strong name similarity"), ("signature", ">= 0.7", "matching signatures"), ("behavior", ">= 0.7", "overlapping behavior"), ("contract", ">= 0.7", "matching contracts"), ("tests", "> 0", "shared test coverage"), ("history", "> 0", "historical co-change")))


@r.query(_SCORED + f" SELECT a, b, CASE WHEN concat_ws('; ', {_WORDS}) = '' THEN 'weak evidence' ELSE concat_ws('; ', {_WORDS}) END AS rationale FROM hm WHERE families >= 2 AND total >= 0.60")
def hom13_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where((F.col("families") >= O.LEAST_FAMILIES) & (F.col("total") >= O.LEAST_TOTAL)).select("a", "b", "rationale")


@r.query(_SCORED + " SELECT a, b, round(total, 4)::DOUBLE AS confidence, len(flags) = 0 AND total >= 0.85 AS safe FROM hm WHERE families >= 2 AND total >= 0.70")
def prp1_blr4_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols a change should be carried to; safe without contradictions from 0.85 on."""
    kept = _scored(spark, sf_dir).where((F.col("families") >= O.LEAST_FAMILIES) & (F.col("total") >= 0.70))
    return kept.select("a", "b", F.round("total", 4).alias("confidence"), ((F.size("flags") == 0) & (F.col("total") >= 0.85)).alias("safe"))


_FAMILIES = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + ", un AS (SELECT a, b FROM hm WHERE families >= 2 AND total >= 0.60), cc AS (SELECT a AS n, a AS m FROM un UNION SELECT b, b FROM un UNION SELECT cc.n, CASE WHEN un.a = cc.m THEN un.b ELSE un.a END FROM cc JOIN un ON un.a = cc.m OR un.b = cc.m), fm AS (SELECT n AS member, min(m) AS family FROM cc GROUP BY 1)"


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = store(_scored(spark, sf_dir).where((F.col("families") >= O.LEAST_FAMILIES) & (F.col("total") >= O.LEAST_TOTAL)).select("a", "b", "total"))
    return connected_components(edges, "a", "b").withColumnsRenamed({"node": "member", "component": "family"}), edges


@r.query(_FAMILIES + ", k AS (SELECT family, kind, count(*) AS n FROM fm JOIN symbols s ON s.symbol_id = fm.member GROUP BY 1, 2), fk AS (SELECT family, sum(n) AS n_members, arg_max(kind, (n, kind)) AS kind FROM k GROUP BY 1) SELECT family, n_members::BIGINT AS n_members, kind AS majority_kind FROM fk")
def fam1_fam2_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = _families(spark, sf_dir)
    kinds = members.join(table(spark, sf_dir, "symbols").select(F.col("symbol_id").alias("member"), "kind"), "member").groupBy("family", "kind").agg(F.count("*").alias("n"))
    return kinds.groupBy("family").agg(F.sum("n").alias("n_members"), F.max(F.struct("n", "kind")).getField("kind").alias("majority_kind"))


@r.query(_FAMILIES + ", ev AS (SELECT a AS member, total FROM hm WHERE families >= 2 AND total >= 0.60 UNION ALL SELECT b, total FROM hm WHERE families >= 2 AND total >= 0.60), av AS (SELECT member, avg(total) AS mean FROM ev GROUP BY 1), fa AS (SELECT family, avg(mean) AS fmean FROM fm JOIN av USING (member) GROUP BY 1) SELECT fm.family, fm.member, round(av.mean, 6)::DOUBLE AS similarity, av.mean < 0.5 * fa.fmean AS outlier, row_number() OVER (PARTITION BY fm.family ORDER BY round(av.mean, 9) DESC, fm.member) = 1 AS exemplar FROM fm JOIN av USING (member) JOIN fa USING (family)")
def fam3_fam5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their mean similarity to their neighbours; the best is the exemplar, those under half the family's mean are outliers."""
    members, edges = _families(spark, sf_dir)
    both = edges.select(F.col("a").alias("member"), "total").unionByName(edges.select(F.col("b").alias("member"), "total"))
    placed = members.join(both.groupBy("member").agg(F.avg("total").alias("mean")), "member")
    mean = placed.groupBy("family").agg(F.avg("mean").alias("fmean"))
    first = F.row_number().over(Window.partitionBy("family").orderBy(F.desc(F.round("mean", 9)), "member")) == 1
    return placed.join(mean, "family").select("family", "member", F.round("mean", 6).alias("similarity"), (F.col("mean") < 0.5 * F.col("fmean")).alias("outlier"), first.alias("exemplar"))


@r.query(_FAMILIES + f", w AS (SELECT family, member, unnest({_LOOSE.format('canonical_name')}) AS word FROM fm JOIN symbols s ON s.symbol_id = fm.member), n AS (SELECT family, count(*) AS n FROM fm GROUP BY 1) SELECT w.family, word, count(*) AS n_members FROM w JOIN n USING (family) GROUP BY 1, 2, n.n HAVING count(*) > 0.5 * n.n AND length(word) > 2")
def fam4_fam6_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = _families(spark, sf_dir)
    words = members.join(table(spark, sf_dir, "symbols").select(F.col("symbol_id").alias("member"), "canonical_name"), "member").select("family", F.explode(T.loose_name_words(F.col("canonical_name"))).alias("word"))
    size = members.groupBy("family").agg(F.count("*").alias("n"))
    return words.groupBy("family", "word").agg(F.count("*").alias("n_members")).join(size, "family").where((F.col("n_members") > 0.5 * F.col("n")) & (F.length("word") > 2)).select("family", "word", "n_members")


_LINE = (
    f"WITH {VERSIONS}, {FILES}, {SNAPSHOTS}, o AS (SELECT snapshot_id, row_number() OVER (PARTITION BY repo_id, branch ORDER BY created_at, snapshot_id) AS seq, repo_id, branch FROM sn WHERE snapshot_id IN (SELECT snapshot_id FROM v)), "
    "st AS (SELECT o.repo_id, o.branch, v.symbol_id, min(seq) AS birth, max(seq) AS death, count(DISTINCT seq) AS n FROM v JOIN o USING (snapshot_id) GROUP BY 1, 2, 3), mx AS (SELECT repo_id, branch, max(seq) AS m FROM o GROUP BY 1, 2)"
)


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.versions(spark, sf_dir, "symbol_id", "snapshot_id")
    w = Window.partitionBy("repo_id", "branch").orderBy("created_at", "snapshot_id")
    order = corpus.snapshots(spark, sf_dir).join(v.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", "repo_id", "branch", F.row_number().over(w).alias("seq"))
    life = v.join(order, "snapshot_id").groupBy("repo_id", "branch", "symbol_id").agg(F.min("seq").alias("birth"), F.max("seq").alias("death"), F.countDistinct("seq").alias("n"))
    newest = order.groupBy(F.col("repo_id").alias("r2"), F.col("branch").alias("b2")).agg(F.max("seq").alias("m"))
    return life.join(newest, life["repo_id"].eqNullSafe(F.col("r2")) & life["branch"].eqNullSafe(F.col("b2"))).drop("r2", "b2")


@r.query(_LINE + " SELECT st.repo_id, st.branch, symbol_id, birth::BIGINT AS birth, CASE WHEN death < m THEN death + 1 END::BIGINT AS death, death = m AS is_alive FROM st JOIN mx ON mx.repo_id = st.repo_id AND mx.branch IS NOT DISTINCT FROM st.branch")
def lin1_lin4_births_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).select("repo_id", "branch", "symbol_id", F.col("birth").cast("long").alias("birth"), F.when(F.col("death") < F.col("m"), F.col("death") + 1).cast("long").alias("death"), (F.col("death") == F.col("m")).alias("is_alive"))


@r.query(_LINE + " SELECT st.repo_id, s.kind, count(*) AS total, count(*) FILTER (WHERE death = m) AS alive FROM st JOIN mx ON mx.repo_id = st.repo_id AND mx.branch IS NOT DISTINCT FROM st.branch JOIN symbols s USING (symbol_id) GROUP BY 1, 2")
def ag10_lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).join(table(spark, sf_dir, "symbols").select("symbol_id", "kind"), "symbol_id").groupBy("repo_id", "kind").agg(F.count("*").alias("total"), F.count_if(F.col("death") == F.col("m")).alias("alive"))


@r.query(
    _LINE + f", d AS (SELECT st.*, s.canonical_name AS name, s.kind FROM st JOIN mx ON mx.repo_id = st.repo_id AND mx.branch IS NOT DISTINCT FROM st.branch JOIN symbols s USING (symbol_id) WHERE death < m), q AS (SELECT st.*, s.canonical_name AS name, s.kind FROM st JOIN symbols s USING (symbol_id) WHERE birth > 1), "
    f"p AS (SELECT d.symbol_id AS old_id, q.symbol_id AS new_id, {_LOOSE.format('d.name')} AS wa, {_LOOSE.format('q.name')} AS wb, d.name AS na, q.name AS nb FROM d JOIN q ON d.repo_id = q.repo_id AND d.branch IS NOT DISTINCT FROM q.branch AND d.kind = q.kind AND q.birth = d.death + 1), "
    f"z AS (SELECT old_id, new_id, greatest(1 - levenshtein(lower(na), lower(nb)) / greatest(length(na), length(nb))::DOUBLE, {_JACC.format('wa', 'wb')}) AS s FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY round(s, 9) DESC, new_id) AS r1, row_number() OVER (PARTITION BY new_id ORDER BY round(s, 9) DESC, old_id) AS r2 FROM z WHERE s >= 0.45) SELECT old_id, new_id, round(s, 6) AS similarity FROM b WHERE r1 = 1 AND r2 = 1"
)
def lin2_lin3_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols gone in one snapshot matched with those that came in the same, mutually best by name."""
    life = _life(spark, sf_dir).join(table(spark, sf_dir, "symbols").select("symbol_id", "canonical_name", "kind"), "symbol_id")
    gone = life.where("death < m").select("repo_id", F.coalesce("branch", F.lit("")).alias("branch"), "kind", (F.col("death") + 1).alias("birth"), F.col("symbol_id").alias("old_id"), F.col("canonical_name").alias("na"))
    come = life.where("birth > 1").select("repo_id", F.coalesce("branch", F.lit("")).alias("branch"), "kind", "birth", F.col("symbol_id").alias("new_id"), F.col("canonical_name").alias("nb"))
    scored = gone.join(come, ["repo_id", "branch", "kind", "birth"]).select("old_id", "new_id", T.name_similarity(F.col("na"), F.col("nb")).alias("s")).where("s >= 0.45")
    rank = lambda by, then: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("s", 9)), then))
    return scored.select("old_id", "new_id", "s", rank("old_id", "new_id").alias("r1"), rank("new_id", "old_id").alias("r2")).where("r1 = 1 and r2 = 1").select("old_id", "new_id", F.round("s", 6).alias("similarity"))


_DIFF = f"WITH {VERSIONS}, {TIMED}, w AS (SELECT *, lag(symbol_version_id) OVER o AS p, lag(signature) OVER o AS s0, lag(body_hash) OVER o AS b0, lag(visibility) OVER o AS v0, lag(range_end_line - range_start_line) OVER o AS l0 FROM vt WINDOW o AS {IN_TIME}), x AS (SELECT p, symbol_version_id, CASE WHEN visibility IS DISTINCT FROM v0 THEN CASE WHEN visibility = 'private' THEN 3 ELSE 1 END ELSE 0 END AS vis, CASE WHEN signature IS DISTINCT FROM s0 THEN 3 ELSE 0 END AS sig, CASE WHEN body_hash IS DISTINCT FROM b0 THEN 2 ELSE 0 END AS body, CASE WHEN (range_end_line - range_start_line) <> l0 THEN 1 ELSE 0 END AS span FROM w WHERE p IS NOT NULL)"


@r.query(_DIFF + " SELECT p AS before_id, symbol_version_id AS after_id, ['none', 'minor', 'major', 'breaking'][greatest(vis, sig, body, span) + 1] AS overall, ['none', 'minor', 'major', 'breaking'][vis + 1] AS visibility, ['none', 'minor', 'major', 'breaking'][sig + 1] AS signature, ['none', 'minor', 'major', 'breaking'][body + 1] AS body, ['none', 'minor', 'major', 'breaking'][span + 1] AS span FROM x")
def dif1_semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each version of a symbol departs from the one before it, by dimension and overall."""
    w = corpus.in_time()
    rows = corpus.timed_versions(spark, sf_dir, "symbol_id", "signature", "body_hash", "visibility", "range_start_line", "range_end_line").withColumn("lines", F.col("range_end_line") - F.col("range_start_line"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    ranks = rows.select(
        F.lag("symbol_version_id").over(w).alias("before_id"),
        F.col("symbol_version_id").alias("after_id"),
        F.when(differs("visibility"), F.when(F.col("visibility") == "private", 3).otherwise(1)).otherwise(0).alias("visibility"),
        F.when(differs("signature"), 3).otherwise(0).alias("signature"),
        F.when(differs("body_hash"), 2).otherwise(0).alias("body"),
        F.when(F.col("lines") != F.lag("lines").over(w), 1).otherwise(0).alias("span"),
    ).where("before_id is not null")
    word = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("none", "minor", "major", "breaking")]), c + 1)
    return ranks.select("before_id", "after_id", word(F.greatest("visibility", "signature", "body", "span")).alias("overall"), *[word(F.col(c)).alias(c) for c in ("visibility", "signature", "body", "span")])


QUERIES, SQL = r.queries, r.sql
