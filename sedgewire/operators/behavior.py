"""Behavior hints, profiles, purity, contracts, effects and uncertainty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.functions import patterns as P

PURITY = ("pure", "read_only", "read_write", "side_effecting")
#: Profile columns and the hint types they gather.
PROFILE = {
    "db_reads": ("db_read",), "db_writes": ("db_write",), "network_calls": ("network_call",), "cache_ops": ("cache_op", "cache_write"), "file_io": ("file_io",), "auth_operations": ("auth_check",),
    "validation_operations": ("validation",), "state_mutation_profile": ("state_mutation",), "transaction_profile": ("transaction",),
}
#: Key prefixes of touched resources.
TOUCH = {"db_read": "db:read:", "db_write": "db:write:", "network_call": "network:", "file_io": "file:", "cache_op": "cache:", "cache_write": "cache:write:", "auth_check": "auth:", "state_mutation": "state:", "transaction": "txn:", "acquires_lock": "lock:", "concurrency": "concurrency:", "serialization": "serialization:"}
# How much a kind of uncertainty takes from the confidence; unknown ones 0.05, never below 0.10.
IMPACT = {
    "parse_error": 0.30, "type_inference_failure": 0.15, "dynamic_dispatch": 0.20, "reflection_usage": 0.25, "eval_usage": 0.35, "external_dependency": 0.10, "incomplete_type_info": 0.12,
    "ambiguous_override": 0.18, "circular_reference": 0.15, "untested_path": 0.08, "config_dependent": 0.10, "runtime_only_behavior": 0.22,
}
UNKNOWN_IMPACT, LEAST_CONFIDENCE = 0.05, 0.10


def mine_hints(bodies: DataFrame) -> DataFrame:
    """(body_hash, line_no, hint_type, detail): one row per pattern and line. ``bodies``: body_hash, body_source, language."""
    lines = bodies.select("body_hash", "language", F.posexplode(F.split("body_source", "\n")).alias("at", "line")).where("trim(line) <> ''")
    found = lines.select("body_hash", (F.col("at") + 1).alias("line_no"), F.explode(P.matches(F.col("line"), F.col("language"), P.HINTS)).alias("h"))
    return found.select("body_hash", "line_no", F.col("h.kind").alias("hint_type"), F.col("h.name").alias("detail"))


def purity_level(has) -> Column:
    """0 to 3 from a function that tells whether a hint type occurs."""
    any_of = lambda *kinds: reduce(lambda a, b: a | b, [has(k) for k in kinds])
    return (
        F.when(any_of("network_call", "transaction", "acquires_lock", "concurrency"), 3)
        .when(any_of("db_write", "state_mutation", "file_io", "cache_write"), 2)
        .when(any_of("db_read", "cache_op", "auth_check"), 1)
        .otherwise(0)
    )


def profiles(hints: DataFrame, keys: DataFrame, key: str = "body_hash") -> DataFrame:
    """One profile per key: sorted sets of details, touched resources, exceptions, purity level and class. Keys without hints are pure."""
    one = hints.select(key, "hint_type", "detail").distinct()
    details = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("hint_type").isin(*kinds), F.col("detail"))))
    touch = F.create_map(*[F.lit(x) for kv in TOUCH.items() for x in kv])
    grouped = one.groupBy(key).agg(
        *[details(kinds).alias(name) for name, kinds in PROFILE.items()],
        F.array_sort(F.collect_set(F.when(F.col("hint_type").isin("throws", "catches"), F.concat_ws(":", "hint_type", "detail")))).alias("exception_profile"),
        F.array_sort(F.collect_set(F.concat(F.try_element_at(touch, F.col("hint_type")), F.col("detail")))).alias("resource_touches"),
        F.collect_set("hint_type").alias("kinds"),
    )
    full = keys.select(key).distinct().join(grouped, key, "left")
    level = purity_level(lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False)))
    empty = F.array().cast("array<string>")
    arrays = [F.coalesce(c, empty).alias(c) for c in [*PROFILE, "exception_profile", "resource_touches"]]
    return full.select(key, *arrays, level.alias("purity_level")).withColumn("purity_class", F.element_at(F.array(*[F.lit(p) for p in PURITY]), F.col("purity_level") + 1))


def contract(signature: Column, thrown: Column) -> list[Column]:
    """Input, output and error contract from a signature and the types it throws."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    types = F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(F.element_at(F.split(p, ":"), -1))), lambda p: p != "")
    given = F.when(F.size(types) > 0, F.concat(F.lit("("), F.array_join(types, ", "), F.lit(")"))).otherwise("void")
    out = F.trim(F.regexp_extract(signature, r"\)\s*(?::|->)\s*(.+)$", 1))
    return [given.alias("input_contract"), F.when(out == "", "void").otherwise(out).alias("output_contract"), F.when(F.size(thrown) > 0, F.array_join(thrown, " | ")).otherwise("never").alias("error_contract")]


def effects_of_text(text: Column, language: Column) -> Column:
    """Sorted distinct kind:descriptor keys of the effect patterns found in a body."""
    return F.array_sort(F.array_distinct(F.transform(P.matches(text, language, P.EFFECT_PATTERNS), lambda e: F.concat_ws(":", e["kind"], e["name"]))))


def effects_of_profile() -> Column:
    """Sorted distinct kind:descriptor keys from the columns of a profile; a transaction is a write and a lock, a cache operation writes if its name says so."""
    keyed = lambda c, kind, prefix: F.transform(F.col(c), lambda d: F.concat(F.lit(f"{kind}:{prefix}"), d))
    cache = F.transform(F.col("cache_ops"), lambda d: F.when(d.rlike("(?i)set|write|del|put|clear|invalidate|expire"), F.concat(F.lit("writes:cache."), d)).otherwise(F.concat(F.lit("reads:cache."), d)))
    throws = F.transform(F.filter(F.col("exception_profile"), lambda e: e.startswith("throws:")), lambda e: F.concat(F.lit("throws:error."), F.substring(e, 8, 200)))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                keyed("db_reads", "reads", "db."), keyed("db_writes", "writes", "db."), keyed("network_calls", "calls_external", "network."), keyed("file_io", "opens", "file."), cache, keyed("auth_operations", "requires", "auth."),
                keyed("validation_operations", "normalizes", "validation."), throws, keyed("state_mutation_profile", "mutates", "state."), keyed("transaction_profile", "writes", "transaction."), keyed("transaction_profile", "acquires_lock", "transaction."),
            )
        )
    )


def effect_class(keys: Column) -> Column:
    """Class of a set of effect keys, strongest first."""
    has = lambda kind: F.exists(keys, lambda e: e.startswith(kind + ":"))
    any_of = lambda *kinds: reduce(lambda a, b: a | b, [has(k) for k in kinds])
    transaction = F.exists(keys, lambda e: e.startswith("writes:") & e.contains("transaction"))
    return (
        F.when(any_of("emits", "acquires_lock") | transaction, "full_side_effect").when(has("calls_external"), "io").when(any_of("writes", "mutates", "opens"), "writer").when(any_of("reads", "requires", "throws", "normalizes", "logs"), "reader").otherwise("pure")
    )


def symbol_confidence(flags: Column) -> Column:
    """Product of what each distinct flag leaves, at least LEAST_CONFIDENCE."""
    impact = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])
    left = F.aggregate(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>"))), F.lit(1.0), lambda acc, f: acc * (1 - F.coalesce(F.try_element_at(impact, f), F.lit(UNKNOWN_IMPACT))))
    return F.greatest(F.lit(LEAST_CONFIDENCE), F.least(F.lit(1.0), left))


def snapshot_confidence(flags: DataFrame, key: str) -> DataFrame:
    """(key, confidence) from one row per (key, flag): the first of a kind counts fully, its repeats by 0.3 of it."""
    impact = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])
    i = F.coalesce(F.try_element_at(impact, F.col("flag")), F.lit(UNKNOWN_IMPACT))
    per = flags.groupBy(key, "flag").agg(F.count("*").alias("n")).withColumn("ln", F.log(1 - i) + (F.col("n") - 1) * F.log(1 - 0.3 * i))
    return per.groupBy(key).agg(F.greatest(F.lit(LEAST_CONFIDENCE), F.exp(F.sum("ln"))).alias("confidence"))
