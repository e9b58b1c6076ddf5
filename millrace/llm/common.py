"""Plumbing shared by the training-data operators: shared storage, row keys, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of digits, lower-case letters and non-ASCII characters, after A-Z are lower-cased.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a shingle and the similarity that makes near duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; where none is set, a temporary one on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def purge(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; for when its results have been stored."""
    _delete(spark, own_dir(spark))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Deletes a query's shuffle files once it has run; its rows are in the table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = (), arrow_rows: int | None = None, **write: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder, partitioned ``by`` columns, and read it back.

    The rows survive lost executors because the files are not on any executor's own disk. ``arrow_rows`` bounds
    the batches that go to Python while it runs.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    usual, cleaned = spark.conf.get(ARROW_ROWS), spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        if arrow_rows:
            spark.conf.set(ARROW_ROWS, min(arrow_rows, int(usual)) if int(usual) > 0 else arrow_rows)
        df.write.options(**write).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, usual)
        spark.conf.set(CLEANUP, cleaned)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(*dfs: DataFrame, part: str = "") -> None:
    """Delete tables made by ``materialize``, or one partition of each, that nothing still to run reads."""
    for df in dfs:
        path = getattr(df, "_millrace_path", None)
        if path:
            _delete(df.sparkSession, f"{path}/{part}" if part else path)


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def held_out(key: Column, mod: int) -> Column:
    """Rows whose remainder is 2 are held out; a null key is not."""
    return F.coalesce(remainder(key, mod) == 2, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(text: Column) -> Column:
    """Lower case; null becomes empty.

    The Kelvin sign is the one character outside ASCII that lower() makes an ASCII letter of; a text with it has
    only A-Z lower-cased. So words stand where they would if only A-Z were lower-cased, and ASCII ones are equal.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that identify a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def smallest(rows: DataFrame, most: int, seed: int, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``most`` rows whose keys have the smallest hashes, ties by key and ``ties``.

    Rows are counted first, and a bar on the hash lets through half as many again as are wanted, so that what the
    partitions send to the last step does not grow with their number.
    """
    mark = F.xxhash64(key, F.lit(seed))
    n = rows.count()
    if n > 2 * most:
        bar = -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * most / n + 100 / n))
        near = rows.filter(mark <= bar) if bar < 1 << 63 else rows
        rows = near if near.select(key).limit(most).count() == most else rows  # keys that repeat can miss the bar
    return rows.orderBy(mark, key, *ties).limit(most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
