"""Line-window chunks as native expressions, and the byte offsets of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import chunk_id, content_hash
from millrace.functions.text import text_lines

WINDOW, OVERLAP = 50, 10


def line_offsets(files: DataFrame) -> DataFrame:
    """(path, line, byte_start, byte_end) of each line from 1; ends exclude the line break."""
    raw = F.filter(F.split("content", "\n", -1), lambda _: F.lit(True))
    base = files.select("path", raw.alias("l"))
    sizes = F.transform("l", lambda x: F.octet_length(x))
    starts = F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, x: F.struct((s["at"] + x + 1).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    rows = base.select("path", F.posexplode(F.arrays_zip(sizes.alias("size"), starts.alias("start"))).alias("i", "x"), F.size("l").alias("n"), F.element_at("l", -1).alias("tail"))
    rows = rows.filter(~((F.col("i") == F.col("n") - 1) & (F.col("tail") == "")))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.col("x.start").alias("byte_start"), (F.col("x.start") + F.col("x.size")).alias("byte_end"))


def line_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``window`` lines that step by ``window`` - ``overlap``, kind line_block, blank ones left out.

    A file's last window is the first that reaches its end. Input: path, content, language, mtime.
    """
    step = window - overlap
    base = files.select("path", "content", "language", "mtime", text_lines(F.col("content")).alias("lines"), F.split("content", "\n", -1).alias("raw"))
    n = F.size("lines")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    rows = base.select("path", "language", "mtime", "content", "lines", "raw", F.explode(starts).alias("s"))
    text = F.array_join(F.slice("lines", F.col("s") + 1, window), "\n")
    octets = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + F.octet_length(x) + 1)
    before = octets(F.slice("raw", 1, F.col("s")))
    inside = octets(F.slice("raw", F.col("s") + 1, window)) - 1
    end = F.least(F.col("s") + window, F.size("lines"))
    out = rows.select("path", "language", "mtime", (F.col("s") + 1).alias("start_line"), end.alias("end_line"), before.alias("byte_start"), F.least(before + inside, F.octet_length("content")).alias("byte_end"), text.alias("content"))
    out = out.filter(F.trim(F.regexp_replace("content", r"\s+", "")) != "")
    return as_chunks(out.withColumn("symbol", F.lit(None).cast("string")).withColumn("kind", F.lit("line_block")).withColumn("parent_context", F.lit(None).cast("string")))


def as_chunks(rows: DataFrame) -> DataFrame:
    """Rows with path, lines, bytes and content as the chunk relation, ids and hashes made."""
    return rows.select(
        chunk_id(F.col("path"), F.col("byte_start"), F.col("byte_end")).alias("id"), F.col("path").alias("file_path"), "start_line", "end_line", "byte_start", "byte_end", "symbol", "kind", "content", "parent_context", "language", F.col("mtime").alias("file_mtime"), content_hash(F.col("content")).alias("content_hash")
    )
