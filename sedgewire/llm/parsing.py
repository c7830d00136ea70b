"""Source files that do not parse: errors per file, rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.syntax import language_of, syntax_errors

_FAULTS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


def check_files(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, language, valid, n_errors, first_line, first_error, errors) of every text with a known language.

    The language is the one the extension of the path stands for; paths with
    another extension, without one or null are left out, as are null file_ids.
    A null text is left out; an empty one, or one of nothing but comments, is
    valid. A file_id with several rows in ``files`` counts once (its greatest
    path); texts are parsed whole; empty tables give no rows. errors are in
    order of place, the first being the first cause.
    """
    paths = files.where("file_id is not null and path is not null").select("file_id", "path").distinct().groupBy("file_id").agg(F.max("path").alias("path"))
    known = texts.where("file_id is not null and source_text is not null").select("file_id", "source_text").join(paths, "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, languages, errors = [], [], []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("source_text"))):
                language = language_of(path)
                if language is None:
                    continue
                source = text.as_py()
                take.append(i)
                languages.append(language)
                found, line, at = [], 1, 0
                for e in sorted(syntax_errors(source, language)):  # lines are counted on from error to error
                    line, at = line + source.count("\n", at, e.at), e.at
                    found.append({"line": line, "message": e.message})
                errors.append(found)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(index), batch.column("path").take(index), pa.array(languages, pa.string()), pa.array(errors, _FAULTS)], names=["file_id", "path", "language", "errors"])

    parsed = known.mapInArrow(run, "file_id string, path string, language string, errors array<struct<line:int,message:string>>")
    first = F.try_element_at("errors", F.lit(1))
    return parsed.select("file_id", "path", "language", (F.size("errors") == 0).alias("valid"), F.size("errors").alias("n_errors"), first["line"].alias("first_line"), first["message"].alias("first_error"), "errors")


def acceptance(checked: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, invalid_rate); each file_id counts once, unknown snapshots have a null repo_id."""
    repo = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("repo_id").alias("repo_id"))
    at = files.where("file_id is not null").groupBy("file_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    placed = checked.select("file_id", "language", "valid").distinct().join(at, "file_id").join(repo, "snapshot_id", "left")
    counted = placed.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return counted.withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
