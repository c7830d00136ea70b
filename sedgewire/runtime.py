"""Session-level helpers: table access, lineage cuts and Arrow-side scans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a session on one machine (tests, notebooks) may do without.

    A machine's own folder is not seen by the other machines of a cluster, so
    a cluster that names no shared folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sedgewire-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """``cut`` that also counts the rows for which ``what`` holds, in the same job."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count_if(what).alias("n")).checkpoint(eager=True)
    return out, seen.get["n"]


def scan_distinct_text(
    df: DataFrame,
    key: str,
    text: str,
    carry: list[str],
    analyse: Callable[[str], list[tuple]],
    fields: list[tuple[str, pa.DataType]],
    sql_schema: str,
) -> DataFrame:
    """Run ``analyse`` over every row's text, once per distinct key of a partition's run of rows.

    Unchanged bodies recur in snapshot after snapshot, so results are kept per
    key while a partition is read; the memory is bounded by ``CACHE_KEYS``
    entries, after which the store is emptied and filled anew (a speed matter
    only, every row still gets its result). Rows with a null text are skipped.
    ``carry`` columns are repeated on each produced row; ``fields`` names the
    values of the tuples that ``analyse`` returns.
    """
    names = [f for f, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        schema = None
        for batch in batches:
            keys, texts = batch.column(key), batch.column(text)
            take: list[int] = []
            out: list[list] = [[] for _ in names]
            for i, k in enumerate(keys.to_pylist()):
                if not texts[i].is_valid:
                    continue
                found = kept.get(k) if k is not None else None
                if found is None:
                    found = analyse(texts[i].as_py())
                    if k is not None:
                        if len(kept) >= CACHE_KEYS:
                            kept.clear()
                        kept[k] = found
                for row in found:
                    take.append(i)
                    for column, v in zip(out, row):
                        column.append(v)
            if not take:
                continue
            index = pa.array(take, pa.int64())
            arrays = [batch.column(c).take(index) for c in carry] + [pa.array(v, t) for v, (_, t) in zip(out, fields)]
            if schema is None:
                schema = pa.schema([pa.field(c, a.type) for c, a in zip([*carry, *names], arrays)])
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*dict.fromkeys([key, text, *carry])).mapInArrow(run, sql_schema)


def scan_keys(df: DataFrame, key: str, text: str, analyse: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType]], sql_schema: str) -> DataFrame:
    """Like ``scan_distinct_text``, but a key's rows come once for each part of the table that holds it.

    ``sql_schema`` begins with the key. Rows with a null key or text are skipped.
    """
    names = [key, *[f for f, _ in fields]]
    types = [pa.string(), *[t for _, t in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            texts, out = batch.column(text), []
            for i, k in enumerate(batch.column(key).to_pylist()):
                if k is None or k in met or not texts[i].is_valid:
                    continue
                if len(met) >= 50 * CACHE_KEYS:
                    met.clear()
                met.add(k)
                out += [(k, *row) for row in analyse(texts[i].as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return df.select(key, text).mapInArrow(run, sql_schema)


#: Distinct texts whose results one Python worker keeps at a time.
CACHE_KEYS = 20_000


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Smaller on disk than a checkpoint of wide rows; removed when the driver ends.
    """
    return stored(df.sparkSession, df.schema, [_write(df)])


def store_counting(df: DataFrame, what: Column) -> tuple[str, int]:
    """Folder of the stored ``df`` and the number of its rows for which ``what`` holds, from one job."""
    seen = Observation()
    path = _write(df.observe(seen, F.count_if(what).alias("n")))
    return path, seen.get["n"]


def stored(spark: SparkSession, schema: StructType | str, paths: list[str]) -> DataFrame:
    """Stored tables of one schema, read as one."""
    return spark.read.schema(schema).parquet(*paths)


def _write(df: DataFrame) -> str:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for a stored table ends with it, not when the driver collects its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _stored.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_stored: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_stored() -> None:
    """Delete the tables written by ``store``."""
    while _stored:
        spark, path = _stored.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone already, and with it the way to the files
            return
