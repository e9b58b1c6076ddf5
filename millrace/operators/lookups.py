"""Point lookups, filters and counts over the stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import path_prefix


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("id") == chunk_id)


def chunks_of_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path).orderBy("start_line", "id")


def file_record(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def narrow(chunks: DataFrame, language: str | None = None, path: str | None = None) -> DataFrame:
    """Optional language and path-prefix filters; a condition appears in the plan only when it is set."""
    if language is not None:
        chunks = chunks.filter(F.col("language") == language)
    if path is not None:
        chunks = chunks.filter(path_prefix(F.col("file_path"), path))
    return chunks


def workspaces(names: list[str], wanted: list[str] | None) -> list[str]:
    """The workspaces to search: all if none are named; a name that doesn't exist is an error that lists them."""
    if not wanted:
        return list(names)
    found = [n for n in names if n in wanted]
    if not found:
        raise ValueError(f"no workspace matches {wanted}; there are: {', '.join(sorted(names))}")
    return found


def counts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: chunks and files stored."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).join(files.agg(F.count(F.lit(1)).alias("files")), how="cross")


def distinct_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct()


def status(meta: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Stored counters beside live counts, and whether they drifted apart. ``meta`` is the one-row form."""
    live = counts(chunks, files)
    return meta.join(live, how="cross").withColumn("drift", (F.col("chunks_stored") != F.col("chunks")) | (F.col("files_indexed") != F.col("files")))
