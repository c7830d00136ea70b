import math

from conftest import rows
from pyspark.sql import functions as F

from sedgewire.functions import hashing as H
from sedgewire.functions import text as T
from sedgewire.operators import behavior as B
from sedgewire.operators import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words(spark):
    word = lambda w: one(spark, T.normalize_word(F.lit(w)))
    assert [word(w) for w in ("Hello", "item1", "a", "a1", "handler", "service")] == ["hello", "item", "", "", "handle", "serve"]
    assert one(spark, T.split_compound(F.lit("XMLParser_getUserName"))) == ["XML", "Parser", "get", "User", "Name"]
    assert one(spark, T.body_tokens(F.lit("const userName = 'str ing' + 0x1F; // gone\nreturn getUser(12)"))) == ["user", "name", "get", "user"]


def test_trigram_golden(spark):
    assert round(one(spark, T.trigram_similarity(F.lit("word"), F.lit("two words"))), 4) == 0.3636


def test_tf_idf_goldens(spark):
    docs = spark.createDataFrame([("1", "user"), ("1", "user"), ("1", "get"), ("2", "user"), ("3", "other")], "doc string, token string")
    w = V.term_weights(docs)
    tf = {(r["doc"], r["token"]): r["tf"] for r in w.collect()}
    assert math.isclose(tf["1", "user"], 1 + math.log(2)) and tf["1", "get"] == 1
    idf = V.inverse_frequencies(w, spark.sql("select 3L as n"))
    got = {r["token"]: r["idf"] for r in idf.collect()}
    assert math.isclose(got["user"], math.log(2)) and math.isclose(got["get"], math.log(1 + 3 / 2))
    norm = V.tfidf(w, idf).groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(math.isclose(r["n"], 1) for r in norm)


def test_minhash_and_bands(spark):
    df = spark.createDataFrame([(["user", "get"],), ([],), (None,)], "w array<string>").select(H.minhash()(F.col("w")).alias("s"))
    sigs = [r["s"] for r in df.collect()]
    assert all(len(s) == 128 for s in sigs) and set(sigs[1]) == {H.EMPTY} == set(sigs[2])
    a, b = (x.astype(object) for x in H.coefficients())
    assert sigs[0] == [min((int(x) * H._fnv(t) + int(y)) % H.PERMUTATION_PRIME for t in ("user", "get")) for x, y in zip(a, b)]
    bands = df.limit(1).select(H.band_hashes(F.col("s")).alias("b")).first()["b"]
    assert len(bands) == 16 and all(-(1 << 31) <= x < 1 << 31 for x in bands)
    assert one(spark, H.fnv1a(F.lit("user"))) == 1618501362


def test_uncertainty_goldens(spark):
    conf = lambda flags: round(one(spark, B.symbol_confidence(F.array(*[F.lit(f) for f in flags]))), 4)
    assert conf(["parse_error"]) == 0.70 and conf(["parse_error", "eval_usage"]) == 0.455 and conf(["odd"]) == 0.95
    twice = B.snapshot_confidence(spark.createDataFrame([("s", "parse_error")] * 2, "k string, flag string"), "k")
    assert round(twice.first()["confidence"], 4) == 0.637


def test_purity(spark):
    hints = spark.createDataFrame([("a", "network_call", "x"), ("a", "db_read", "q"), ("b", "db_write", "w"), ("c", "cache_op", "c"), ("d", "logging", "l")], "body_hash string, hint_type string, detail string")
    keys = spark.createDataFrame([(k,) for k in "abcde"], "body_hash string")
    got = {r["body_hash"]: r["purity_class"] for r in B.profiles(hints, keys).collect()}
    assert got == {"a": "side_effecting", "b": "read_write", "c": "read_only", "d": "pure", "e": "pure"}


def test_signature_similarity(spark):
    s = lambda a, b: one(spark, T.signature_similarity(F.lit(a), F.lit(b)))
    assert s("f(a: X): Y", "f(a: X): Y") == 1.0 and s("", "f()") == 0.0 and 0 < s("f(a: X): Y", "g(a: X, b: Z): Y") < 1
    assert rows(spark.range(0).select("id")) == []


def test_multi_view(spark):
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    vectors = spark.createDataFrame([("x", "body", "t", 1.0), ("y", "body", "t", 1.0), ("z", "name", "t", 1.0)], "doc string, view string, token string, w double")
    assert rows(V.multi_view(pairs, vectors)) == [("x", "y", 1.0), ("x", "z", 0.0)]
