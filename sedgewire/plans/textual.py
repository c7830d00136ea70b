"""Text kernel and similarity engine over symbols, bodies and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import hashing as H
from sedgewire.functions import text as T
from sedgewire.operators import corpus
from sedgewire.operators import vectors as V
from sedgewire.plans.registry import BODIES, BODY_STEPS, VERSIONS, Registry
from sedgewire.runtime import table

r = Registry()

_NOISE = "(" + ", ".join(f"'{w}'" for w in T.NOISE_WORDS) + ")"
_STEM = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.STEMS.items()) + " ELSE {0} END"
_SPLIT = "string_split_regex(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[_-]+')"
_STRIP = "{0}"
for _rx in (r"(?m)//.*$", r"/\*[\s\S]*?\*/", r"''(?:[^''\\]|\\.)*''", r'"(?:[^"\\]|\\.)*"', r"`(?:[^`\\]|\\.)*`", r"\b0[xX][0-9a-fA-F]+\b", r"\b0[bB][01]+\b", r"\b0[oO][0-7]+\b", r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b"):
    _STRIP = f"regexp_replace({_STRIP}, '{_rx}', '', 'g')"
_IDENT = "[a-zA-Z_$][a-zA-Z0-9_$]*"
#: words(key, raw): split identifiers -> stemmed words
_TOKENS = (
    "sp AS (SELECT k, unnest({split}) AS part FROM ids), "
    "lo AS (SELECT k, regexp_replace(lower(part), '[0-9]+$', '') AS w FROM sp WHERE part <> ''), "
    "st AS (SELECT k, " + _STEM.format("w") + " AS w FROM lo), "
    "tok AS (SELECT k, w FROM st WHERE length(w) >= 2{noise})"
)


def _sql_tokens(source: str, key: str, text: str, noise: bool = True, strip: bool = True, ident: bool = True) -> str:
    inner = _STRIP.format(text) if strip else text
    ids = f"ids AS (SELECT {key} AS k, {'unnest(regexp_extract_all(' + inner + ', ' + chr(39) + _IDENT + chr(39) + '))' if ident else text} AS x FROM {source})"
    return ids + ", " + _TOKENS.format(split=_SPLIT.format("x"), noise=f" AND w NOT IN {_NOISE}" if noise else "")


_BAG = "SELECT k AS {0}, array_to_string(list_sort(list(w)), ' ') AS tokens FROM tok GROUP BY 1"


def _bag(c):
    return F.array_join(F.array_sort(c), " ").alias("tokens")


@r.query("WITH " + _sql_tokens("symbols", "symbol_id", "canonical_name", noise=False, strip=False, ident=False) + " " + _BAG.format("symbol_id"))
def st1_st2_st3_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("symbol_id", T.name_tokens(F.col("canonical_name")).alias("t")).where(F.size("t") > 0).select("symbol_id", _bag("t"))


@r.query("WITH " + BODIES + ", " + _sql_tokens("b", "body_hash", "body_source") + " " + _BAG.format("body_hash"))
def st4_body_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select("body_hash", T.body_tokens(F.col("body_source")).alias("t")).where(F.size("t") > 0).select("body_hash", _bag("t"))


@r.query("WITH " + VERSIONS + ", " + _sql_tokens("(SELECT symbol_version_id, signature FROM v WHERE signature IS NOT NULL)", "symbol_version_id", "signature", strip=False) + " " + _BAG.format("symbol_version_id"))
def st5_signature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "signature").where("signature is not null").select("symbol_version_id", T.signature_tokens(F.col("signature")).alias("t")).where(F.size("t") > 0).select("symbol_version_id", _bag("t"))


@r.query("SELECT symbol_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(canonical_name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-\\s.]+'), lambda x: x <> ''))), ' ') AS words FROM symbols")
def st8_loose_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("symbol_id", F.array_join(F.array_sort(T.loose_name_words(F.col("canonical_name"))), " ").alias("words"))


@r.query("WITH n AS (SELECT DISTINCT canonical_name AS name FROM symbols) SELECT name, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS fnv FROM n")
def st9_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select(F.col("canonical_name").alias("name")).distinct().select("name", H.fnv1a(F.col("name")).alias("fnv"))


@r.query("SELECT repo_id, stable_key, sha256(repo_id || chr(0) || stable_key || chr(0) || kind) AS identity, left(sha256(canonical_name), 16) AS short_hash FROM symbols")
def st11_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("repo_id", "stable_key", F.sha2(F.concat_ws("\x00", "repo_id", "stable_key", "kind"), 256).alias("identity"), F.substring(F.sha2("canonical_name", 256), 1, 16).alias("short_hash"))


_NEAR_NAMES = "n AS (SELECT repo_id, canonical_name, min(symbol_id) AS symbol_id FROM symbols GROUP BY 1, 2), o AS (SELECT repo_id, canonical_name AS a, lead(canonical_name) OVER (PARTITION BY repo_id ORDER BY canonical_name) AS b FROM n), p AS (SELECT * FROM o WHERE b IS NOT NULL)"


def _neighbour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names next to one another in a repository's sorted list: pairs to compare."""
    w = Window.partitionBy("repo_id").orderBy("a")
    return table(spark, sf_dir, "symbols").select("repo_id", F.col("canonical_name").alias("a")).distinct().withColumn("b", F.lead("a").over(w)).where("b is not null")


_LOOSE = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-\\s.]+'), lambda x: x <> ''))"
_JACC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


@r.query(f"WITH {_NEAR_NAMES}, q AS (SELECT *, {_LOOSE.format('a')} AS wa, {_LOOSE.format('b')} AS wb FROM p) SELECT repo_id, a, b, levenshtein(lower(a), lower(b))::BIGINT AS edits, round(greatest(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b))::DOUBLE, {_JACC.format('wa', 'wb')}), 6) AS similarity FROM q")
def st13_st14_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_names(spark, sf_dir).select("repo_id", "a", "b", F.levenshtein(F.lower("a"), F.lower("b")).cast("long").alias("edits"), F.round(T.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@r.query(f"WITH {_NEAR_NAMES}, q AS (SELECT *, {_TRI.format('a')} AS ta, {_TRI.format('b')} AS tb FROM p) SELECT repo_id, a, b, round({_JACC.format('ta', 'tb')}, 6) AS similarity, {_JACC.format('ta', 'tb')} >= 0.3 AS matches FROM q")
def st17_flt9_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.trigram_similarity(F.col("a"), F.col("b"))
    return _neighbour_names(spark, sf_dir).select("repo_id", "a", "b", F.round(s, 6).alias("similarity"), (s >= 0.3).alias("matches"))


def _signature_sql(w: tuple[float, float, float]) -> str:
    params = "len(list_filter(string_split(regexp_extract({0}, '\\((.*?)\\)', 1), ','), lambda p: p <> ''))"
    ret = "trim(string_split({0}, ':')[-1])"
    words = "list_distinct(list_filter(string_split_regex(lower(regexp_replace({0}, '[(),:]', ' ', 'g')), '\\s+'), lambda t: length(t) > 1))"
    return (
        f"WITH {VERSIONS}, s AS (SELECT DISTINCT symbol_id, signature FROM v WHERE signature IS NOT NULL), k AS (SELECT sy.repo_id, s.signature FROM s JOIN symbols sy USING (symbol_id) GROUP BY 1, 2), "
        "p AS (SELECT repo_id, signature AS a, lead(signature) OVER (PARTITION BY repo_id ORDER BY signature) AS b FROM k), "
        f"q AS (SELECT *, {params.format('a')} AS pa, {params.format('b')} AS pb, {ret.format('a')} AS ra, {ret.format('b')} AS rb, {words.format('a')} AS wa, {words.format('b')} AS wb FROM p WHERE b IS NOT NULL) "
        f"SELECT repo_id, a, b, round(CASE WHEN a = b THEN 1 ELSE least(1, {w[0]} * CASE WHEN greatest(pa, pb) = 0 THEN 1 ELSE least(pa, pb)::DOUBLE / greatest(pa, pb) END + CASE WHEN ra <> '' AND ra = rb THEN {w[1]} ELSE 0 END + CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN {w[2]} * {_JACC.format('wa', 'wb')} ELSE 0 END) END, 6) AS similarity FROM q"
    )


def _neighbour_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy("a")
    rows = corpus.versions(spark, sf_dir, "symbol_id", "signature").where("signature is not null").join(table(spark, sf_dir, "symbols").select("symbol_id", "repo_id"), "symbol_id")
    return rows.select("repo_id", F.col("signature").alias("a")).distinct().withColumn("b", F.lead("a").over(w)).where("b is not null")


@r.query(_signature_sql((0.4, 0.4, 0.2)))
def st15_signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_signatures(spark, sf_dir).select("repo_id", "a", "b", F.round(T.signature_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@r.query(_signature_sql((0.4, 0.3, 0.3)))
def st16_lineage_signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_signatures(spark, sf_dir).select("repo_id", "a", "b", F.round(T.signature_similarity(F.col("a"), F.col("b"), (0.4, 0.3, 0.3)), 6).alias("similarity"))


@r.query(
    "SELECT repo_id, hash, max(subject) AS subject, bool_or(regexp_matches(subject, '(?i)\\bfix(?:e[sd])?\\b|\\bbug\\b|\\bpatch\\b|\\bhotfix\\b|\\bresolve[sd]?\\b|\\bclose[sd]?\\s+#\\d+|\\bregression\\b')) AS bug_fix, bool_or(regexp_matches(subject, '(?i)^revert\\b')) AS revert, bool_or(regexp_matches(subject, '(?i)^merge\\s+(branch|pull\\s+request|remote)')) AS merge FROM git_commits WHERE subject IS NOT NULL GROUP BY 1, 2"
)
def st18_commit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "git_commits").where("subject is not null")
    has = lambda rx: F.bool_or(F.col("subject").rlike(rx))
    return rows.groupBy("repo_id", "hash").agg(F.max("subject").alias("subject"), has(T.BUG_FIX).alias("bug_fix"), has(T.REVERT).alias("revert"), has(T.MERGE).alias("merge"))


@r.query(
    "WITH l AS (SELECT file_id, string_split(source_text, chr(10)) AS ls FROM file_texts WHERE source_text IS NOT NULL), x AS (SELECT file_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM l) "
    "SELECT file_id, n::BIGINT AS line_no, ls[n] AS line, array_to_string(list_slice(ls, greatest(n - 1, 1), n + 1), chr(10)) AS context FROM x WHERE regexp_matches(ls[n], 'throw new \\w+|raise \\w+|errors\\.New')"
)
def st19_nat1_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match a pattern, with one line before and after."""
    lines = table(spark, sf_dir, "file_texts").where("source_text is not null").select("file_id", F.split("source_text", "\n").alias("ls"))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.element_at("ls", i).rlike(r"throw new \w+|raise \w+|errors\.New"))
    hits = lines.select("file_id", "ls", at.alias("at")).where(F.size("at") > 0)
    found = F.transform("at", lambda i: F.struct(i.cast("long").alias("line_no"), F.element_at("ls", i).alias("line"), F.array_join(F.slice("ls", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 1), "\n").alias("context")))
    return hits.select("file_id", F.explode(found).alias("x")).select("file_id", "x.*")


@r.query(f"WITH q AS (SELECT symbol_id, canonical_name AS n, lower(canonical_name) AS l, len(list_intersect({_LOOSE.format('canonical_name')}, ['catalog', 'token'])) AS hits FROM symbols), s AS (SELECT symbol_id, CASE WHEN n = 'catalogToken' THEN 100 WHEN l = 'catalogtoken' THEN 92 WHEN starts_with(l, 'catalogtoken') THEN 84 WHEN contains(l, 'catalogtoken') THEN 76 WHEN hits > 0 THEN 40 + 12 * hits ELSE 0 END AS score FROM q) SELECT symbol_id, (score + 3)::BIGINT AS score FROM s WHERE score > 0")
def st20_native_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("symbol_id", T.native_symbol_score(F.col("canonical_name"), F.lit("catalogToken"), F.lit(True)).cast("long").alias("score")).where("score > 0")


@r.query(f"WITH {VERSIONS} SELECT symbol_version_id, trim(regexp_extract(signature, '\\)\\s*(?::|->)\\s*(.+)$', 1)) AS returns FROM v WHERE signature IS NOT NULL")
def st21_return_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions(spark, sf_dir, "signature").where("signature is not null").select("symbol_version_id", T.return_type(F.col("signature")).alias("returns"))


@r.query("SELECT symbol_id, regexp_replace(stable_key, '^(?:[^/]*/)*', '') AS simple, string_split(stable_key, '#')[-1] AS name, lower(regexp_replace(split_part(stable_key, '#', 1), '[\\\\/]+', '/', 'g')) AS path FROM symbols")
def st23_path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select(
        "symbol_id", F.regexp_replace("stable_key", "^(?:[^/]*/)*", "").alias("simple"), F.element_at(F.split("stable_key", "#"), -1).alias("name"), F.lower(F.regexp_replace(F.substring_index("stable_key", "#", 1), r"[\\/]+", "/")).alias("path")
    )


@r.query(
    f"WITH {BODIES}, l AS (SELECT DISTINCT unnest(regexp_extract_all(body_source, '\"([^\"\\n]{{4,80}})\"', 1)) AS lit FROM b) SELECT lit, CASE WHEN regexp_matches(lit, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 'email' WHEN regexp_matches(lit, 'https?://[^\\s''\"]+') THEN 'url' WHEN regexp_matches(lit, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'uuid' "
    "WHEN regexp_matches(lit, '\\(\\d{3}\\)\\s*\\d{3}-?\\d{4}|\\d{3}-\\d{3}-\\d{4}') THEN 'phone' WHEN regexp_matches(lit, '(?:\\d{1,3}\\.){3}\\d{1,3}') THEN 'ipv4' WHEN regexp_matches(lit, '\\d{4}-\\d{2}-\\d{2}') THEN 'datetime' WHEN regexp_matches(lit, '^\\d+(?:\\.\\d+)?$') THEN 'numeric' WHEN regexp_matches(lit, '^[A-Za-z]+$') THEN 'alpha' ELSE 'custom' END AS domain FROM l"
)
def st25_literal_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = corpus.bodies(spark, sf_dir).select(F.explode(F.regexp_extract_all("body_source", F.lit(r'"([^"\n]{4,80})"'), F.lit(1))).alias("lit")).distinct()
    return literals.select("lit", T.regex_domain(F.col("lit")).alias("domain"))


@r.query("SELECT doc_id, CASE WHEN length(x) > 80 THEN left(x, 77) || '...' ELSE x END AS short, ceil(length(text) / 4.0)::BIGINT AS tokens FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL)")
def st26_st27_shorten_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.shorten(F.col("text"), 80).alias("short"), T.token_estimate(F.col("text")).alias("tokens"))


_TF = "tf AS (SELECT k, w, 1 + ln(count(*)) AS tf FROM tok GROUP BY 1, 2)"
_IDF = "df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), idf AS (SELECT w, df, ln(1 + (SELECT count(*) FROM b) / (1 + df)::DOUBLE) AS idf FROM df)"
_VEC = "raw AS (SELECT k, w, tf * idf AS x FROM tf JOIN idf USING (w)), nm AS (SELECT k, sqrt(sum(x * x)) AS nm FROM raw GROUP BY 1), vec AS (SELECT k, w, CASE WHEN nm < 1e-10 THEN x ELSE x / nm END AS x FROM raw JOIN nm USING (k))"
_BODY_TOKENS = "WITH " + BODIES + ", " + _sql_tokens("b", "body_hash", "body_source") + ", "


def _body_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select(F.col("body_hash").alias("doc"), F.explode(T.body_tokens(F.col("body_source"))).alias("token"))


def _body_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weights = V.term_weights(_body_words(spark, sf_dir))
    n = corpus.bodies(spark, sf_dir).agg(F.count("*"))
    idf = V.inverse_frequencies(weights, n)
    return V.tfidf(weights, idf), idf


@r.query(_BODY_TOKENS + _TF + " SELECT k AS doc, w AS token, round(tf, 6) AS tf FROM tf")
def sim1_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_weights(_body_words(spark, sf_dir)).select("doc", "token", F.round("tf", 6).alias("tf"))


@r.query(_BODY_TOKENS + _TF + ", " + _IDF + " SELECT w AS token, df, round(idf, 6) AS idf FROM idf")
def sim2_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body_vectors(spark, sf_dir)[1].select("token", "df", F.round("idf", 6).alias("idf"))


@r.query(_BODY_TOKENS + _TF + ", " + _IDF + ", " + _VEC + " SELECT k AS doc, w AS token, round(x, 6) AS w FROM vec")
def sim3_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body_vectors(spark, sf_dir)[0].select("doc", "token", F.round("w", 6).alias("w"))


_PAIRS = BODY_STEPS.format("b").replace("st AS (", "bs AS (") + ", pr AS (SELECT DISTINCT a, b FROM bs WHERE a IS NOT NULL)"


def _revision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct bodies of one symbol that follow one another in time."""
    return corpus.body_steps(spark, sf_dir).select("a", "b").distinct()


@r.query(_BODY_TOKENS + _TF + ", " + _IDF + ", " + _VEC + ", " + _PAIRS + " SELECT pr.a, pr.b, round(least(1, greatest(0, coalesce(sum(x.x * y.x), 0))), 6) AS cosine FROM pr LEFT JOIN vec x ON x.k = pr.a LEFT JOIN vec y ON y.k = pr.b AND y.w = x.w GROUP BY 1, 2")
def sim4_sim12_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cosine(_revision_pairs(spark, sf_dir), _body_vectors(spark, sf_dir)[0]).select("a", "b", F.round("cosine", 6).alias("cosine"))


_SIGS = "g AS (SELECT DISTINCT v.body_hash, sv.minhash_signature AS s FROM semantic_vectors sv JOIN symbol_versions v USING (symbol_version_id) WHERE lower(sv.view_type) = 'body' AND sv.minhash_signature IS NOT NULL AND v.body_source IS NOT NULL AND NOT list_bool_and(list_transform(sv.minhash_signature, lambda x: x = 4294967295)))"


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bodies(spark, sf_dir).select("body_hash", H.minhash()(F.array_distinct(T.body_tokens(F.col("body_source")))).alias("s"))


_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)"
_COEFFICIENTS = (
    "g AS (SELECT 1 AS i, ((42::HUGEINT * 1664525 + 1013904223) % 4294967296) AS s UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < 256), "
    "co AS (SELECT x.i // 2 AS i, CASE WHEN x.s % 4294967290 = 0 THEN 1 ELSE x.s % 4294967290 END AS a, y.s % 4294967291 AS b FROM g x JOIN g y ON y.i = x.i + 1 WHERE x.i % 2 = 1)"
)


@r.query(
    "WITH RECURSIVE " + BODIES + ", " + _sql_tokens("b", "body_hash", "body_source") + ", " + _COEFFICIENTS + ", w1 AS (SELECT w, " + _FNV.format("w") + " AS h FROM (SELECT DISTINCT w FROM tok)), wh AS (SELECT w, i, (a * h + b) % 4294967291 AS x FROM w1, co), "
    "ms AS (SELECT k, i, min(x)::BIGINT AS x FROM (SELECT DISTINCT k, w FROM tok) JOIN wh USING (w) GROUP BY 1, 2) SELECT k AS body_hash, string_agg(x::VARCHAR, ',' ORDER BY i) AS signature FROM ms GROUP BY 1"
)
def sim5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).where(~H.is_empty_signature(F.col("s"))).select("body_hash", F.array_join("s", ",").alias("signature"))


@r.query("WITH " + BODIES + ", " + _SIGS + ", " + _PAIRS + " SELECT pr.a, pr.b, round(list_sum(list_transform(range(1, 129), lambda i: CASE WHEN x.s[i] = y.s[i] THEN 1 ELSE 0 END)) / 128.0, 6) AS estimate FROM pr JOIN g x ON x.body_hash = pr.a JOIN g y ON y.body_hash = pr.b")
def sim6_sim13_body_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "semantic_vectors").where("lower(view_type) = 'body'").where(~H.is_empty_signature(F.col("minhash_signature"))).select("symbol_version_id", "minhash_signature")
    g = table(spark, sf_dir, "symbol_versions").where("body_source is not null").select("symbol_version_id", "body_hash").join(stored, "symbol_version_id").groupBy("body_hash").agg(F.max("minhash_signature").alias("s"))
    pairs = _revision_pairs(spark, sf_dir)
    return pairs.join(g.select(F.col("body_hash").alias("a"), F.col("s").alias("x")), "a").join(g.select(F.col("body_hash").alias("b"), F.col("s").alias("y")), "b").select("a", "b", F.round(H.estimated_jaccard(F.col("x"), F.col("y")), 6).alias("estimate"))


_BYTES = "flatten(list_transform({0}, lambda v: [v % 256, (v // 256) % 256, (v // 65536) % 256, (v // 16777216) % 256]))"


@r.query("WITH " + _SIGS + ", x AS (SELECT body_hash, i AS band, " + _BYTES.format("list_slice(s, i * 8 + 1, i * 8 + 8)") + " AS bs FROM g, range(16) t(i)), h AS (SELECT body_hash, band, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(bs, lambda c: c::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS h FROM x) SELECT body_hash, band::BIGINT AS band, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM h")
def st10_sim7_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "semantic_vectors").where("lower(view_type) = 'body' and minhash_signature is not null").select("symbol_version_id", "minhash_signature")
    g = table(spark, sf_dir, "symbol_versions").where("body_source is not null").select("symbol_version_id", "body_hash").join(stored, "symbol_version_id").select("body_hash", F.col("minhash_signature").alias("s"))
    return V.banded(g.where(~H.is_empty_signature(F.col("s"))).distinct(), "body_hash", "s").select("body_hash", F.col("band").cast("long").alias("band"), "hash")


def _signature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body_hash, class, s): bodies of one signature are a class, named by its smallest hash."""
    return _signatures(spark, sf_dir).withColumn("class", F.min("body_hash").over(Window.partitionBy("s")))


@r.query()
def sim11_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of bodies (sim11_members) that share a band with another one, up to 50 best per class (the operator's top k)."""
    g = _signature_classes(spark, sf_dir).where("body_hash = class").select("body_hash", "s")
    near = V.band_neighbours(g, g, "body_hash", "s", 0.05)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "body_hash")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 50").select("query", "body_hash", F.round("similarity", 6).alias("similarity"))


@r.query()
def sim11_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body with the class it belongs to: those of a class have the same signature, hence every link of the class."""
    return _signature_classes(spark, sf_dir).select("body_hash", "class")


@r.query(
    _BODY_TOKENS + _TF + ", " + _IDF + ", " + _VEC + ", q0 AS (SELECT unnest(['compress', 'token', 'fleet', 'error']) AS w), q1 AS (SELECT q0.w, coalesce(idf, ln(1 + (SELECT count(*) FROM b)::DOUBLE)) AS x FROM q0 LEFT JOIN idf USING (w)), q AS (SELECT w, x / sqrt(sum(x * x) OVER ()) AS x FROM q1), "
    "sc AS (SELECT k, sum(vec.x * q.x) AS c FROM vec JOIN q USING (w) GROUP BY 1), m AS (SELECT DISTINCT v.body_hash, s.symbol_id, s.kind FROM symbol_versions v JOIN symbols s USING (symbol_id)) "
    "SELECT m.symbol_id, m.body_hash, round(least(1, c * CASE WHEN kind IN ('function', 'method', 'class') THEN 1.15 WHEN kind = 'interface' THEN 0.9 ELSE 1 END), 6) AS score FROM sc JOIN m ON m.body_hash = sc.k WHERE c * CASE WHEN kind IN ('function', 'method', 'class') THEN 1.15 WHEN kind = 'interface' THEN 0.9 ELSE 1 END > 0.01"
)
def sim14_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols for a free-text query, by cosine with a boost by kind; all of them, ranked by the caller."""
    vectors, idf = _body_vectors(spark, sf_dir)
    n = corpus.bodies(spark, sf_dir).agg(F.count("*"))
    words = spark.createDataFrame([(w,) for w in ("compress", "token", "fleet", "error")], "token string")
    raw = words.join(idf, "token", "left").select("token", F.coalesce("idf", F.log(1 + n.scalar())).alias("x"))
    query = raw.select("token", (F.col("x") / F.sqrt(raw.agg(F.sum(F.col("x") * F.col("x"))).scalar())).alias("x"))
    scored = vectors.join(F.broadcast(query), "token").groupBy("doc").agg(F.sum(F.col("w") * F.col("x")).alias("c"))  # the query has four rows
    of = table(spark, sf_dir, "symbol_versions").select("symbol_id", "body_hash").distinct().join(table(spark, sf_dir, "symbols").select("symbol_id", "kind"), "symbol_id")
    boosted = F.col("c") * F.when(F.col("kind").isin("function", "method", "class"), 1.15).when(F.col("kind") == "interface", 0.9).otherwise(1.0)
    return scored.join(of, scored["doc"] == of["body_hash"]).where(boosted > 0.01).select("symbol_id", "body_hash", F.round(F.least(F.lit(1.0), boosted), 6).alias("score"))


@r.query(
    "WITH p AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT p.a, p.b, round(list_dot_product(x.x, y.x) / (sqrt(list_dot_product(x.x, x.x)) * sqrt(list_dot_product(y.x, y.x))), 6) AS cosine FROM p JOIN e x ON x.vec_id = p.a JOIN e y ON y.vec_id = p.b"
)
def sim4_dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors of one label, each with the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = e.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(w).alias("b"), F.col("x"), F.lead("x").over(w).alias("y")).where("b is not null")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return pairs.select("a", "b", F.round(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), 6).alias("cosine"))


QUERIES, SQL = r.queries, r.sql
