"""Sparse vectors, corpus statistics, min-hash signatures and banded search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.functions import hashing as H


def term_weights(tokens: DataFrame, doc: str = "doc", token: str = "token") -> DataFrame:
    """(doc, token, tf): 1 + ln(count) of each word of each document, from one row per occurrence."""
    return tokens.groupBy(doc, token).agg(F.count("*").alias("n")).select(doc, token, (1 + F.log("n")).alias("tf"))


def inverse_frequencies(weights: DataFrame, n_docs: DataFrame, token: str = "token") -> DataFrame:
    """(token, df, idf): idf = ln(1 + N / (1 + df)); ``n_docs`` is one row and column with N, counting empty documents too."""
    df = weights.groupBy(token).agg(F.count("*").alias("df"))
    return df.select(token, "df", F.log(1 + n_docs.scalar() / (1 + F.col("df"))).alias("idf"))


def tfidf(weights: DataFrame, idf: DataFrame, doc: str = "doc", token: str = "token") -> DataFrame:
    """(doc, token, w): tf*idf of unit length; a word without idf counts 1; raw if the length is nearly 0."""
    raw = weights.join(idf.select(token, "idf"), token, "left").select(doc, token, (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("raw"))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, doc).select(doc, token, F.when(F.col("norm") < 1e-10, F.col("raw")).otherwise(F.col("raw") / F.col("norm")).alias("w"))


def cosine(pairs: DataFrame, vectors: DataFrame, doc: str = "doc", token: str = "token") -> DataFrame:
    """(a, b, cosine) of given pairs of documents, between 0 and 1."""
    left = vectors.select(F.col(doc).alias("a"), token, F.col("w").alias("wa"))
    right = vectors.select(F.col(doc).alias("b"), token, F.col("w").alias("wb"))
    dots = pairs.join(left, "a").join(right, ["b", token]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0)))).alias("cosine"))


def banded(signatures: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, band, hash): the bands of non-empty signatures."""
    full = signatures.where(~H.is_empty_signature(F.col(signature)))
    return full.select(key, F.posexplode(H.band_hashes(F.col(signature))).alias("band", "hash"))


def band_neighbours(queries: DataFrame, signatures: DataFrame, key: str, signature: str, least: float = 0.0) -> DataFrame:
    """(query, key, similarity): signatures that share a band with a query's, by share of equal places.

    One row per key in either table; keys of equal signatures should be
    grouped before, since each shares all its bands with the others.
    """
    q = banded(queries, key, signature).withColumnRenamed(key, "query")
    c = banded(signatures, key, signature)
    pairs = q.join(c, ["band", "hash"]).where(F.col("query") != F.col(key)).select("query", key).distinct()
    left = queries.select(F.col(key).alias("query"), F.col(signature).alias("sa"))
    right = signatures.select(key, F.col(signature).alias("sb"))
    scored = pairs.join(left, "query").join(right, key).select("query", key, H.estimated_jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


# Weights of the views of a symbol.
VIEW_WEIGHTS = {"name": 0.25, "body": 0.30, "signature": 0.20, "behavior": 0.15, "contract": 0.10}


def multi_view(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity): cosines of the views that both documents have, by their weights; 0 without a common view.

    vectors: doc, view, token, w.
    """
    views = vectors.select("doc", "view").distinct()
    common = pairs.join(views.select(F.col("doc").alias("a"), "view"), "a").join(views.select(F.col("doc").alias("b"), "view"), ["b", "view"])
    left = vectors.select(F.col("doc").alias("a"), "view", "token", F.col("w").alias("wa"))
    right = vectors.select(F.col("doc").alias("b"), "view", "token", F.col("w").alias("wb"))
    dots = common.join(left, ["a", "view"]).join(right, ["b", "view", "token"]).groupBy("a", "b", "view").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    weights = F.create_map(*[F.lit(x) for kv in VIEW_WEIGHTS.items() for x in kv])
    scored = common.join(dots, ["a", "b", "view"], "left").withColumn("weight", F.try_element_at(weights, F.col("view")))
    total = scored.groupBy("a", "b").agg((F.sum(F.col("weight") * F.least(F.lit(1.0), F.coalesce("dot", F.lit(0.0)))) / F.sum("weight")).alias("s"))
    return pairs.join(total, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("similarity"))
