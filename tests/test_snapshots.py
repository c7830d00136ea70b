from datetime import datetime

import pytest
from conftest import rows

from sedgewire.operators.snapshots import snapshot_changes

T0 = datetime(2024, 1, 1)
SNAP = "snapshot_id string, repo_id string, branch string, created_at timestamp_ntz, index_status string, indexed_at timestamp_ntz, path string"
FILE = "file_id string, snapshot_id string, path string, content_hash string, loaded_at timestamp_ntz, hash string"
SYM = "symbol_id string, snapshot_id string, body_hash string, line int"


def at(h):
    return T0.replace(hour=h)


def make(spark, snaps, files, syms):
    return spark.createDataFrame(snaps, SNAP), spark.createDataFrame(files, FILE), spark.createDataFrame(syms, SYM)


def test_events_gaps_nulls_and_deliveries(spark):
    snaps = [("s1", "r", "b", at(1), "complete", at(1), "x"), ("s2", "r", "b", at(2), " Complete", at(2), "x"), ("s3", "r", "b", at(3), "complete", at(3), "x"), ("s3", "r", "b", at(3), "failed", at(2), "x"), ("sx", "r", "b", at(2), "partial", at(2), "x")]
    files = [
        ("1", "s1", "a", "AA", at(1), ""), ("2", "s2", "a", " aa", at(1), ""), ("3", "s3", "a", "bb", at(1), ""),  # changed in s3
        ("4", "s1", "gap", "11", at(1), ""), ("5", "s3", "gap", "11", at(1), ""),  # removed in s2, added again in s3
        ("6", "s1", "n", "1", at(1), ""), ("7", "s2", "n", None, at(1), ""), ("8", "s3", "n", "2", at(1), ""),  # null: no change
        ("9", "s3", "late", "old", at(1), ""), ("9", "s3", "late", "new", at(2), ""),  # later delivery counts
        ("9", "sx", "q", "q", at(1), ""), ("0", "s2", None, "q", at(1), ""),
    ]
    syms = [("y", "s1", "h1", 1), ("y", "s2", "h2", 1), ("y", "s2", "h2", 1)]
    got = rows(snapshot_changes(*make(spark, snaps, files, syms)))
    assert got == sorted(
        [("s2", "file", "gap", "removed"), ("s2", "symbol", "y", "changed"), ("s3", "file", "a", "changed"), ("s3", "file", "gap", "added"), ("s3", "file", "late", "added"), ("s3", "symbol", "y", "removed")]
    )


@pytest.mark.parametrize("empty", [0, 1])
def test_empty_tables_and_extra_columns(spark, empty):
    snaps = [] if empty else [("s1", "r", "b", at(1), "complete", at(1), "x")]
    files = [] if empty else [("1", "s1", "a", "AA", at(1), "")]
    assert rows(snapshot_changes(*make(spark, snaps, files, []))) == []
