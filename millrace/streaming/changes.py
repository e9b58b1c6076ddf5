"""File changes as a stream: debounce, last change per path, pending state and incremental sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "path string, is_removal boolean, ts timestamp"
PENDING = "path string, since timestamp, is_pending boolean"


def source(spark: SparkSession, folder: str, schema: str = CHANGES, **options: str) -> DataFrame:
    """Change rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def debounce(changes: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per path and burst: changes at most ``gap`` apart are one session; the last one in time decides.

    Event time, with a watermark. A burst comes out once the watermark has passed its end.
    """
    bursts = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "path")
    return bursts.agg(F.max_by("is_removal", "ts").alias("is_removal"), F.count(F.lit(1)).alias("changes"), F.max("ts").alias("last")).select("path", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "is_removal", "changes", "last")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path in a batch; of equal times the removal wins."""
    return changes.groupBy("path").agg(F.max_by("is_removal", F.struct("ts", "is_removal")).alias("is_removal"), F.max("ts").alias("ts"))


def split(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, modified) paths of a batch; removals are to be applied first."""
    last = latest(changes)
    return last.filter("is_removal").select("path"), last.filter("not is_removal").select("path")


def pending(changes: DataFrame) -> DataFrame:
    """Pending files as keyed state: the first time of a change is kept until the file is removed or synced.

    Input has path, ts and kind ('change', 'removal' or 'synced'); each batch emits the paths whose state moved.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("ts")
        since = state.get[0] if state.exists else None
        for r in rows.itertuples():
            since = (since if since is not None else int(r.ts.value)) if r.kind == "change" else None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
        yield pd.DataFrame({"path": [key[0]], "since": [pd.Timestamp(since) if since is not None else pd.NaT], "is_pending": [since is not None]})

    return changes.groupBy("path").applyInPandasWithState(run, PENDING, "since long", "update", GroupStateTimeout.NoTimeout)


def sync(changes: DataFrame, checkpoint: str, remove: Callable[[DataFrame], None], update: Callable[[DataFrame], None], once: bool = True):
    """Apply a change stream to an index, batch by batch: removals, then modified paths.

    Both callbacks must be idempotent (keyed by path or chunk id), as a batch is replayed after a failure.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = latest(batch).persist()  # both parts come from it; a lost part is made again from the batch
        try:
            for gone, step in ((True, remove), (False, update)):
                paths = last.filter(F.col("is_removal") == gone).select("path")
                if not paths.isEmpty():
                    step(paths)
        finally:
            last.unpersist()

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()


def staleness(results: DataFrame, waiting: DataFrame) -> DataFrame:
    """Stream-static form of the staleness join: search results against pending (path, since) rows."""
    from millrace.operators.graph import stale

    return stale(results, waiting)
