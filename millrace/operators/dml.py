"""Copy-on-write changes: each function returns the relation as it is afterwards.

Tables are Parquet directories; ``Versions`` writes new versions beside the old ones and makes a change of several
tables current by one rename.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import fit_dims


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: that with the largest ``seq``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*").select(rows.columns)


def upsert_vectors(old: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """Vectors padded or cut to ``dims`` replace those of the same chunk."""
    return upsert(old, new.withColumn("embedding", fit_dims(F.col("embedding"), dims)), ["chunk_id"])


def insert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes are upserted (last of equal ids wins by ``seq``); edges are a bag and only appended."""
    new_nodes = last_wins(new_nodes, ["id"], seq).drop(seq) if seq else new_nodes.dropDuplicates(["id"])
    return upsert(nodes, new_nodes, ["id"]), edges.unionByName(new_edges)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(keys).distinct(), keys, "left_anti")


#: Bits of the filter in front of a join: at most 8 MB to broadcast, however many keys there are.
BITS, BITMAP = 1 << 26, 1 << 15


def _maybe(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with _maybe: false only where no row of ``keys`` has the same ``on``. Nothing of ``rows`` is shuffled."""
    at = F.pmod(F.xxhash64(*on), F.lit(BITS))
    bits = keys.select(at.alias("_at")).groupBy(F.expr(f"_at div {BITMAP}").alias("_k")).agg(F.bitmap_construct_agg(F.col("_at") % BITMAP).alias("_bits"))
    marked = rows.withColumn("_at", at).withColumn("_k", F.expr(f"_at div {BITMAP}")).join(F.broadcast(bits), "_k", "left")
    octet = F.conv(F.hex(F.substring("_bits", F.expr(f"cast(_at % {BITMAP} div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_octet, cast(_at % 8 as int)) & 1") == 1
    return marked.withColumn("_octet", octet).withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_k", "_at", "_bits", "_octet")


def _matched(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    k = keys.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    return rows.join(k, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), how)


def within(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows whose ``on`` some row of ``keys`` has, nulls being equal: a semi join that shuffles few of the others.

    A filter of bounded size comes first, over the columns ``by`` of ``on`` if some of the rest are dear to compute.
    """
    return _matched(_maybe(rows, keys, by or on).filter("_maybe").drop("_maybe"), keys, on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The other rows, of which those that the filter tells apart stay where they are."""
    marked = _maybe(rows, keys, on)
    return marked.filter("NOT _maybe").drop("_maybe").unionByName(_matched(marked.filter("_maybe").drop("_maybe"), keys, on, "left_anti"))


def delete_chunks(chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove chunks by id, and their vectors."""
    return delete(chunks, gone, ["id"]), delete(vectors, gone.select(F.col("id").alias("chunk_id")), ["chunk_id"])


def delete_files(chunks: DataFrame, vectors: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove what (path) rows name: chunks, their vectors and file records."""
    gone = chunks.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    return *delete_chunks(chunks, vectors, gone), delete(files, paths, ["path"])


def delete_stale(chunks: DataFrame, vectors: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep chunks of valid (path) rows; then sweep vectors without a chunk."""
    kept = chunks.join(valid.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return kept, vectors.join(kept.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def delete_graph(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes of (path) rows, and the edges that start at them."""
    names = paths.select(F.col("path").alias("file_path")).distinct()
    gone = nodes.join(names, "file_path", "left_semi").select(F.col("id").alias("source_id"))
    return nodes.join(names, "file_path", "left_anti"), edges.join(gone, "source_id", "left_anti")


def clear(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def recreate_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """An empty vector relation for new dimensions, noted in the column's metadata."""
    return vectors.limit(0).withMetadata("embedding", {"dims": dims})


def touch_meta(meta: DataFrame, **values) -> DataFrame:
    """Replace some keys of the key/value metadata."""
    new = meta.sparkSession.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
    return upsert(meta, new, ["key"])


class Versions:
    """Parquet tables under a folder, each version in a directory of its own; one file names the current ones.

    A change is visible when that file is replaced, which is one rename, for all tables of the change together. A
    failed change leaves the tables as they were. A version stays until the change after the one that replaced it, so
    that queries which still read it can end.
    """

    NAMES = "CURRENT.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict[str, str] | None = None

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _state(self) -> dict:
        fs, path = self._fs(), self._path(self.NAMES)
        if not fs.exists(path):
            return {"tables": {}, "old": []}
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self, name: str) -> str | None:
        """The directory of a table's newest version, staged ones included; None if there is none."""
        version = (self._staged or {}).get(name) or self._state()["tables"].get(name)
        return f"{self.root}/{name}/{version}" if version else None

    def stage(self, name: str, df: DataFrame, partition_by: list[str] = ()) -> DataFrame:
        """Write a table's new version, which ``df`` may read the old one of; returns it."""
        version = f"v-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}/{version}"
        with self.change():
            self._staged[name] = version
            df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def change(self):
        """Tables staged inside become current together at the end, or not at all."""
        if self._staged is not None:
            yield
            return
        self._staged = {}
        try:
            yield
            staged = self._staged
            if staged:
                self._publish(staged)
        except BaseException:
            for name, version in self._staged.items():
                self._fs().delete(self._path(name, version), True)
            raise
        finally:
            self._staged = None

    def _publish(self, staged: dict[str, str]) -> None:
        state, fs, jvm = self._state(), self._fs(), self.spark.sparkContext._jvm
        replaced = [f"{n}/{state['tables'][n]}" for n in staged if n in state["tables"]]
        new = {"tables": state["tables"] | staged, "old": replaced}
        fresh = self._path(f"{self.NAMES}.{uuid.uuid4().hex[:8]}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fresh, self._path(self.NAMES), options)
        for gone in state["old"]:
            fs.delete(self._path(gone), True)
