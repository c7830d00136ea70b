import json

from conftest import rows

from sedgewire.sources import readers, writers


def test_discovery_log_traces_pages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("y")
    found = readers.discover_files(spark, str(tmp_path)).collect()
    assert [(r["language"], r["text"]) for r in found] == [("python", "x = 1")]
    log = tmp_path / "log.txt"
    log.write_text(f"{'b' * 40}|N|n@x|2024|s\n\nf.py\n")
    assert rows(readers.read_git_log(spark, str(log)).select("hash", "file")) == [("b" * 40, "f.py")]
    (tmp_path / "t.json").write_text(json.dumps({"source": "run", "call_edges": [{"caller_key": "a", "callee_key": "b", "call_count": 2}] * 3}) + "\n")
    assert len(readers.read_traces(spark, str(tmp_path / "t.json"), most_edges=2).first()["call_edges"]) == 2
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(readers.keyset_page(df, "id", "a", 1)) == [("b",), ("c",)]


def test_writers(spark, tmp_path):
    schema = "snapshot_id string, k string, c double, e string"
    stored = spark.createDataFrame([("s", "a", 0.5, "old"), ("s", "b", 0.9, "old")], schema)
    new = spark.createDataFrame([("s", "a", 0.5, "new"), ("s", "b", 0.1, "new"), ("s", "d", 0.2, "new")], schema)
    merged = writers.upsert_greatest(stored, new, ["snapshot_id", "k"], "c")
    assert rows(merged) == [("s", "a", 0.5, "new"), ("s", "b", 0.9, "old"), ("s", "d", 0.2, "new")]
    path = str(tmp_path / "t")
    writers.replace_partitions(writers.union_all([stored, stored.withColumnRenamed("snapshot_id", "x").selectExpr("'t' as snapshot_id", "k", "c", "e")]), path, "snapshot_id")
    writers.replace_partitions(new, path, "snapshot_id")
    assert spark.read.parquet(path).where("snapshot_id = 't'").count() == 2 and spark.read.parquet(path).where("snapshot_id = 's'").count() == 3
    assert writers.purge_partitions(spark, path, "snapshot_id", ["t", "gone"]) == 1
    files = "file_id string, snapshot_id string, path string, content_hash string"
    old = spark.createDataFrame([("v", "f1", "s1"), ("w", "f2", "s1")], "k string, file_id string, snapshot_id string")
    moved = writers.copy_forward(old, spark.createDataFrame([("f1", "s1", "p", "h"), ("f2", "s1", "q", "h")], files), spark.createDataFrame([("g1", "s2", "p", "h"), ("g2", "s2", "q", "other")], files), old.limit(0), "k")
    assert rows(moved) == [("v", "g1", "s2")]
