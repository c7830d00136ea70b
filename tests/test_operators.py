from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from sedgewire.operators import context, graph, sequential, temporal
from sedgewire.streaming import traces


def test_c3():
    assert sequential.merge_orders([["B", "A"], ["C", "A"], ["B", "C"]]) == ["B", "C", "A"]
    assert sequential.merge_orders([["A", "B"], ["B", "A"]]) is None
    mro = sequential.linearize({"D": ["B", "C"], "B": ["A"], "C": ["A"], "A": []})
    assert mro["D"] == (["D", "B", "C", "A"], True)
    assert sequential.linearize({"X": ["Y"], "Y": ["X"]})["X"][0] == ["X"]
    assert not sequential.linearize({"Z": ["P", "Q"], "P": ["A", "B"], "Q": ["B", "A"], "A": [], "B": []})["Z"][1]


def test_normalize_and_split():
    a = sequential.normalize_code("function add(x, y) { const s = x + y; return s; } // sum")
    b = sequential.normalize_code("function plus(left, right) {\n  const total = left + right;\n  return total;\n}")
    assert a == b
    assert sequential.split_parameters("f(a: Map<string, X[]>, cb: (e: E, f: F) => void, c = 1): Y") == ["a: Map<string, X[]>", "cb: (e: E, f: F) => void", "c = 1"]


def test_bisection():
    clique = lambda p: {(f"{p}{i}", f"{p}{j}"): 1.0 for i in range(4) for j in range(i + 1, 4)}
    edges = {**clique("a"), **clique("b"), ("a0", "b0"): 0.1}
    parts = sequential.bisect(sorted({x for e in edges for x in e}), edges, density=0.6)
    assert sorted(map(tuple, parts)) == [("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3")]


def test_reach_and_propagation(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x"), ("y", "c")], "src string, dst string")
    reach = rows(graph.bounded_reach(calls, spark.createDataFrame([("a",), ("w",)], "node string"), 2))
    assert reach == [("a", "b", 1), ("a", "c", 2), ("w", "x", 1), ("w", "y", 2)]
    nodes = spark.createDataFrame([("a", 0, []), ("b", 1, ["r"]), ("c", 2, ["s"]), ("x", 0, ["t"]), ("y", 0, []), ("w", 0, [])], "node string, level int, items array<string>")
    got = {r["node"]: (r["level"], r["items"], r["residual"]) for r in graph.propagate(nodes, calls).collect()}
    assert got == {"c": (2, ["s"], False), "b": (2, ["r", "s"], False), "a": (2, ["r", "s"], False), "x": (2, ["s", "t"], True), "y": (2, ["s", "t"], True), "w": (2, ["s", "t"], True)}


def test_co_change_and_log(spark):
    h = "a" * 40
    lines = spark.createDataFrame([("l", 0, f"{h}|Ann|a@x|2024-01-01|fix: a|b"), ("l", 1, ""), ("l", 2, "f1"), ("l", 3, "f2")], "source string, at int, line string")
    assert rows(temporal.parse_git_log(lines).select("hash", "subject", "file")) == [(h, "fix: a|b", "f1"), (h, "fix: a|b", "f2")]
    items = spark.createDataFrame([("g", c, f) for c in "12" for f in ("p", "q")], "g string, c string, file string")
    dates = spark.createDataFrame([("g", "1", datetime(2024, 1, 1)), ("g", "2", datetime(2024, 1, 2))], "g string, c string, date timestamp")
    assert rows(temporal.co_changes(items, dates).select("a", "b", "n", "jaccard")) == [("p", "q", 2, 1.0)]


def test_pack_skips_and_degrades(spark):
    items = spark.createDataFrame([("k", 1, "big", 90, 20, None, 2), ("k", 2, "mid", 30, 25, 10, 1), ("k", 3, "small", 5, None, None, None)], "k string, rank int, item string, full long, signature long, summary long, name long")
    got = sorted((r["item"], r["form"], r["cost"]) for r in context.pack(items, "k", 50).collect())
    assert got == [("big", "signature", 20), ("mid", "full", 30)]
    assert sorted((r["item"], r["form"]) for r in context.pack(items, "k", 34).collect()) == [("big", "signature"), ("mid", "summary")]


def test_stream_counts_survive_a_second_run(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "caller string, callee string").write.parquet(src)
    for _ in range(2):
        traces.stream_counts(spark, src, "caller string, callee string", out, ck)
    total = spark.read.parquet(out).groupBy("caller", "callee").agg(F.sum("n").alias("n"))
    assert rows(total) == [("a", "b", 2), ("b", "c", 1)]


def test_co_changes_of_a_large_commit(spark):
    """All items of a commit pair, not only its first 50 by name."""
    files = [f"f{i:03}" for i in range(120)]
    items = spark.createDataFrame([("g", c, f) for c in "12" for f in files] + [("g", "3", "f118"), ("g", "3", "once")], "g string, c string, file string")
    dates = spark.createDataFrame([("g", c, datetime(2024, 1, int(c))) for c in "123"], "g string, c string, date timestamp")
    got = {(a, b): (n, j) for a, b, n, j in rows(temporal.co_changes(items, dates).select("a", "b", "n", "jaccard"))}
    assert len(got) == 120 * 119 // 2 and got["f000", "f001"] == (2, 1.0)
    assert got["f117", "f119"] == (2, 1.0) and got["f118", "f119"] == (2, 2 / 3)


def test_call_chains_are_resolved_segment_by_segment(spark):
    from sedgewire.operators import dispatch

    calls = spark.createDataFrame([("b1", 1, "save"), ("b1", 2, "repo.find"), ("b1", 3, "repo.pool.open"), ("b1", 4, "gone.find"), ("b1", 4, "gone.find"), (None, 1, "x"), ("b2", 1, "lost")], "owner string, line_no long, chain string")
    facts = spark.createDataFrame([("b1", "repo", ["Repo", "Cache"], 0.95), ("b3", "pool", ["Pool"], 0.9)], "owner string, field string, types array<string>, confidence double")
    homes = spark.createDataFrame([("b1", "Service"), ("b3", "Repo")], "owner string, class string")
    methods = spark.createDataFrame([("Service", "save", "t1"), ("Repo", "find", "t2"), ("Cache", "find", "t3"), ("Pool", "open", "t4")], "class string, method string, target string")
    got = {(r.line_no, r.chain): (r.targets, r.confidence, r.polymorphic) for r in dispatch.resolve(calls, facts, homes, methods).collect()}
    assert got == {
        (1, "save"): (["t1"], 0.85, False), (2, "repo.find"): (["t2", "t3"], 0.855, True), (3, "repo.pool.open"): (["t4"], round(0.95 * 0.9 * 0.9, 4), False),
        (4, "gone.find"): ([], 0.09, False), (1, "lost"): ([], 0.3, False),
    }
    assert dispatch.resolve(calls.limit(0), facts, homes, methods).count() == 0


def test_homolog_candidates(spark):
    from sedgewire.operators import homolog

    schema = "id string, repo_id string, kind string, purity string, name string, body_hash string, ast_hash string, normalized_ast_hash string, s array<bigint>"
    sig = [i for i in range(128)]
    near = sig[:64] + [1000 + i for i in range(64)]
    data = [("a", "r", "k1", "pure", "loadOrder", "h", "x1", None, sig), ("b", "r", "k2", "pure", "zip", "h", "x2", None, None), ("c", "r", "k3", "pure", "loadOrders", "h3", "x3", None, None), ("d", "r", "k4", "pure", "q", "h4", "x4", None, near), ("e", "q", "k1", "pure", "loadOrder", "h", "x1", None, sig), (None, "r", "k1", "pure", "loadOrder", "h", "x1", None, sig)]
    got = rows(homolog.candidates(spark.createDataFrame(data, schema)))
    assert got == [("a", "b"), ("a", "c"), ("a", "d")]  # body, name, signature; never across repositories
    alike = [(f"i{i:03d}", "r", "k", "pure", None, "h", None, None, None) for i in range(300)]
    assert len(rows(homolog.candidates(spark.createDataFrame(alike, schema)))) <= 300 * 51
    assert rows(homolog.candidates(spark.createDataFrame([], schema))) == []


def test_homolog_pairs_across_blocks(spark, monkeypatch):
    from sedgewire.functions import hashing as H
    from sedgewire.operators import homolog

    sig = list(range(128))
    data = [(f"i{k}", "r", "k", "pure", f"loadOrder{k}", f"h{k}", f"x{k}", None, [1000 * k + 7] * 8 + sig[8:] if k % 2 else None) for k in range(12)]
    symbols = spark.createDataFrame(data, "id string, repo_id string, kind string, purity string, name string, body_hash string, ast_hash string, normalized_ast_hash string, s array<bigint>")
    whole = rows(homolog.candidates(symbols))
    monkeypatch.setattr(homolog, "BLOCK", 4)
    assert rows(homolog.candidates(symbols)) == whole and len(whole) == 66
    # a symbol travels once for each pair of blocks, not once for each pair of symbols
    numbered = H.packed(symbols.selectExpr("cast(substring(id, 2) as bigint) no", "id", "repo_id", "s", "kind", "array(name, kind) words"), "s")
    pairs = numbered.selectExpr("no a", "1 k").join(numbered.selectExpr("no b", "1 k"), "k").where("a < b").select("a", "b")
    got = homolog.beside(numbered, pairs, ["kind"], ["words"], ["id"])
    assert {(r.id_a, r.id_b, r.same_kind, r.shared_words) for r in got.collect()} == {(f"i{a}", f"i{b}", True, 1) for a in range(12) for b in range(a + 1, 12)}
    assert {(r.id_a, r.id_b): r.places for r in got.collect()}["i1", "i3"] == 120
    assert {r.places for r in got.where("id_a = 'i0'").collect()} == {0}


def test_symbols_travel_to_the_blocks_of_their_own_repository_only(spark, monkeypatch):
    from sedgewire.functions import hashing as H
    from sedgewire.operators import homolog

    monkeypatch.setattr(homolog, "BLOCK", 4)
    data = [(n, f"i{n}", "large" if n < 6 else "small", None, "k", ["w"]) for n in range(8)]
    symbols = H.packed(spark.createDataFrame(data, "no long, id string, repo_id string, s array<bigint>, kind string, words array<string>"), "s")
    sent, run = [], type(symbols).mapInArrow
    monkeypatch.setattr(type(symbols), "mapInArrow", lambda df, *args: (sent.append(df.where("part = 0").count()), run(df, *args))[1])
    got = homolog.beside(symbols, spark.createDataFrame([(0, 5), (6, 7)], "a long, b long"), ["kind"], ["words"], ["id"])
    assert sorted((r.id_a, r.id_b, r.same_kind, r.shared_words) for r in got.collect()) == [("i0", "i5", True, 1), ("i6", "i7", True, 1)]
    assert sent == [6 * 2 + 2]  # the small repository shares a block with the large one, but none of its pairs


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from sedgewire.runtime import store

    blocks = lambda: {str(b) for b in iterate(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().iterator()) if str(b).startswith("shuffle")}

    def iterate(found):
        while found.hasNext():
            yield found.next().name()

    before = blocks()
    kept = store(spark.range(1000).repartition(3, "id"))
    assert not blocks() - before and kept.count() == 1000
    spark.range(1000).repartition(3, "id").write.format("noop").mode("overwrite").save()
    assert blocks() - before  # other queries of the session keep theirs


def test_packed_signatures(spark):
    import pyarrow as pa

    from sedgewire.functions import hashing as H

    data = [(1, list(range(128))), (2, [H.EMPTY] * 128), (3, None), (4, [5, None, 1 << 40])]
    got = {r.k: r.s for r in H.packed(spark.createDataFrame(data, "k int, s array<bigint>"), "s").collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == 512
    places = H.unpacked(pa.array([got[1], got[4], None], pa.binary()))
    assert places[0].tolist() == data[0][1] and places[1, :4].tolist() == [5, -1, 1 << 40, -1]
    assert H.equal_places(places, places).tolist() == [128, 2, 0]


BODY = """assert (a > f(b)); if (!user.id) { throw x } if (n === null) return;
typeof v === 'string'; e instanceof TypeError; Array.isArray(xs); isNaN(q);
c ?? 3; o?.p; if (k === undefined) {} Math.max(0, Math.min(9, w)); if (s.length >= 4) {} if (t > 10) {}
['x', 'y'].includes(mode); name.trim(); parseInt(raw, 10); JSON.parse(body)
@Min(3) @Roles('admin') @Length(2, 5)
if (r < 1 || r > 9) {} switch (kind) { case 'a': case "b": }"""


def test_invariants_of_every_family_in_both_engines(spark):
    import duckdb

    from sedgewire.functions import patterns as P

    df = spark.createDataFrame([("h", BODY), ("e", ""), ("n", None)], "body_hash string, body_source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE b (t VARCHAR)")
    con.execute("INSERT INTO b VALUES (?)", [BODY])
    told = {}
    for name, rules in P.INVARIANTS.items():
        got = {r.expression for r in df.selectExpr("*").select(P.invariants(df["body_source"], rules).alias("i")).selectExpr("explode(i) AS i").select("i.*").collect()}
        want = {r[0] for r in con.execute(f"SELECT i.expression FROM (SELECT unnest({P.invariants_sql('t', rules)}) AS i FROM b)").fetchall()}
        assert got == want and got, name
        told[name] = got
    assert told["assertions"] == {"assert:a > f(b)"}
    assert told["guards"] == {"guard_clause:!user.id => throw", "guard_clause:n === null => early_return"}
    assert "type_guard:typeof v === 'string'" in told["type_guards"] and "null_check:k explicitly checked against null/undefined" in told["null_checks"]
    assert {"range_clamp:w clamped to [0, 9]", "boundary_check:t > 10", "length_check:s.length >= 4"} <= told["ranges"]
    assert told["decorators"] == {"decorator_range:min=3", "decorator_auth:requires role 'admin'", "decorator_length:length=[2, 5]"}
    assert told["enums"] == {"enum_restriction:mode in ['x', 'y']"} and "normalization:raw parsed as integer" in told["normalizations"]
