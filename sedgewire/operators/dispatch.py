"""Points-to facts, member call sites and their resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a field gets its type, the confidence of it, and the pattern (field, type).
FACTS = (
    ("constructor", 0.95, r"(?:this|self)\.(\w+)\s*=\s*(?:new\s+)?([A-Z]\w*)\s*\("),
    ("field_annotation", 0.90, r"(?:private|public|protected|readonly)\s+(\w+)\s*:\s*([A-Z]\w*)"),
    ("typed_parameter", 0.92, r"[(,]\s*(\w+)\s*:\s*([A-Z]\w*)"),
    ("factory_return", 0.80, r"(\w+)\s*=\s*(?:await\s+)?create([A-Z]\w*)\s*\("),
)
CALLSITE = r"(?:this|self)((?:\.\w+)+)\s*\("


def points_to(bodies: DataFrame) -> DataFrame:
    """(owner, field, types, confidence, source): types a name of a body may have; the surest source names the fact."""
    parts = []
    for source, confidence, rx in FACTS:
        whole = F.regexp_extract_all("body_source", F.lit(rx), F.lit(0))
        found = bodies.select("body_hash", F.explode(whole).alias("m"))
        parts.append(found.select(F.col("body_hash").alias("owner"), F.regexp_extract("m", rx, 1).alias("field"), F.regexp_extract("m", rx, 2).alias("type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")))
    facts = reduce(DataFrame.unionByName, parts)
    return facts.groupBy("owner", "field").agg(F.array_sort(F.collect_set("type")).alias("types"), F.max("confidence").alias("confidence"), F.max(F.struct("confidence", "source")).getField("source").alias("source"))


def callsites(bodies: DataFrame) -> DataFrame:
    """(owner, line_no, chain): member calls on this or self, by line."""
    lines = bodies.select(F.col("body_hash").alias("owner"), F.posexplode(F.split("body_source", "\n")).alias("at", "line"))
    found = lines.select("owner", (F.col("at") + 1).cast("long").alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(CALLSITE), F.lit(1))).alias("chain"))
    return found.select("owner", "line_no", F.expr("substring(chain, 2)").alias("chain"))


def resolve(calls: DataFrame, facts: DataFrame, homes: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner, line_no, chain, targets, confidence, polymorphic): every call site, resolved segment by segment.

    homes: (owner, class) the classes a body belongs to; methods: (class,
    method, target). A single method is looked for in the body's own classes
    (0.85). Of a chain, each field leads to its types by the facts of the body,
    or of any body of the class met; confidences multiply, with 0.90 for a
    method found and 0.3 for a segment or method that leads nowhere, at least
    0.05. Null owners and chains have no row; equal sites count once. One join
    per segment of the longest chain.
    """
    parts = F.split("chain", r"\.")
    known = calls.select("owner", "line_no", "chain").where("owner is not null and chain is not null").distinct()
    typed = facts.select("owner", "field", F.explode("types").alias("type"), "confidence")
    by_class = typed.join(homes, "owner").groupBy(F.col("class").alias("at"), "field", "type").agg(F.max("confidence").alias("c"))
    single = known.where(F.size(parts) == 1).join(homes, "owner", "left").join(methods.select("class", F.col("method").alias("chain"), "target"), ["class", "chain"], "left")
    out = [single.select("owner", "line_no", "chain", "target", F.when(F.col("target").isNotNull(), 0.85).otherwise(0.3).alias("c"))]
    longest = known.agg(F.max(F.size(parts))).first()[0] or 0
    own = typed.select("owner", "field", F.col("type").alias("own_type"), F.col("confidence").alias("own_c"))
    at = known.where(F.size(parts) > 1).withColumn("field", F.element_at(parts, 1)).join(own, ["owner", "field"], "left").select("owner", "line_no", "chain", F.col("own_type").alias("at"), F.coalesce("own_c", F.lit(0.3)).alias("p"))
    for k in range(2, longest):
        field = F.when(F.size(parts) > k, F.element_at(parts, k))
        stepped = at.withColumn("field", field).join(by_class.withColumnRenamed("type", "to"), ["at", "field"], "left")
        at = stepped.select("owner", "line_no", "chain", F.when(F.col("field").isNull(), F.col("at")).otherwise(F.col("to")).alias("at"), (F.col("p") * F.when(F.col("field").isNull(), 1.0).otherwise(F.coalesce("c", F.lit(0.3)))).alias("p"))
    met = at.withColumn("method", F.element_at(parts, -1)).join(methods.withColumnRenamed("class", "at"), ["at", "method"], "left")
    out.append(met.select("owner", "line_no", "chain", "target", (F.col("p") * F.when(F.col("target").isNotNull(), 0.90).otherwise(0.3)).alias("c")))
    all_ = out[0].unionByName(out[1]).groupBy("owner", "line_no", "chain").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.max(F.when(F.col("target").isNotNull(), F.col("c"))).alias("found"), F.max("c").alias("c"))
    return all_.select("owner", "line_no", "chain", "targets", F.round(F.greatest(F.lit(0.05), F.coalesce("found", "c")), 4).alias("confidence"), (F.size("targets") > 1).alias("polymorphic"))
