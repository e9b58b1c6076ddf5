"""Change detection between stored and current files and chunks, as semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAME = ["path", "mtime", "size", "hash"]


def unchanged(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose path, mtime, size and hash are all as stored."""
    return current.join(stored.select(SAME).distinct(), SAME, "left_semi")


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select(SAME).distinct(), SAME, "left_anti")


def new_chunks(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id and content hash are not stored yet."""
    return current.join(stored.select("id", "content_hash").distinct(), ["id", "content_hash"], "left_anti")


def removed_chunks(current: DataFrame, stored: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored chunks of the given (path) rows that the files no longer have."""
    of = stored.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return of.join(current.select("id").distinct(), "id", "left_anti")


def catch_up(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Tracked files that differ on disk in mtime or size; missing and new files are not reported."""
    d = disk.select("path", F.col("mtime").alias("now_mtime"), F.col("size").alias("now_size"))
    return stored.join(d, "path").filter((F.col("mtime") != F.col("now_mtime")) | (F.col("size") != F.col("now_size"))).select("path", "now_mtime", "now_size")


def per_file(chunks: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """(path, chunks, new_chunks) for each processed file, also those without new chunks."""
    count = lambda df, name: df.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias(name))
    out = processed.select("path").distinct().join(count(chunks, "chunks"), "path", "left").join(count(fresh, "new_chunks"), "path", "left")
    return out.na.fill(0, ["chunks", "new_chunks"])
