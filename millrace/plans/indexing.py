"""The index pipeline: files to chunks, vectors, lexical postings and graph, whole or for some paths."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import enrich_chunk
from millrace.functions.vectors import fit_dims, mock_embedder
from millrace.operators import diff, dml, parsing
from millrace.sources import files as sources
from millrace.sources.records import meta_rows

TABLES = {
    "chunks": "id string, file_path string, start_line int, end_line int, byte_start int, byte_end int, symbol string, kind string, content string, parent_context string, language string, file_mtime bigint, content_hash string",
    "vectors": "chunk_id string, embedding array<float>",
    "files": "path string, mtime bigint, size bigint, hash string, indexed_at bigint",
    "nodes": "id string, symbol string, kind string, file_path string",
    "edges": "source_id string, target_symbol string, edge_type string",
    "meta": "key string, value string",
    "report": "path string, chunks bigint, new_chunks bigint",
}


@dataclass
class Report:
    files_indexed: int
    files_skipped: int
    chunks_created: int
    chunks_removed: int
    files_stored: int
    chunks_stored: int
    seconds: float
    per_file: DataFrame | None = None


class Store(dml.Versions):
    """The relations of one index as versioned Parquet tables under a folder."""

    def read(self, name: str) -> DataFrame:
        path = self.current(name)
        if path:
            return self.spark.read.schema(TABLES[name]).parquet(path)
        return self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, df: DataFrame) -> DataFrame:
        kinds = dict(self.spark.createDataFrame([], TABLES[name]).dtypes)
        return self.stage(name, df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())))

    def clear(self) -> None:
        with self.change():
            for name in TABLES:
                self.write(name, self.spark.createDataFrame([], TABLES[name]))


def with_hash(files: DataFrame) -> DataFrame:
    """Decoded files with language and content hash."""
    return sources.decode(files).withColumn("language", sources.language(F.col("path"))).withColumn("hash", F.sha2("content", 256))


def index(store: Store, files: DataFrame, embed=None, dims: int = 384, delete_stale: bool = True, now: int | None = None, provider: str = "mock", model: str = "mock") -> Report:
    """Bring the store up to date with ``files`` (path, size, mtime, content bytes).

    Unchanged files (path, mtime, size, hash) are skipped; of the others only new chunks are embedded; removed
    chunks, vectors and graph rows go. All tables change together, so a broken run repeats. A subset of files
    is indexed with ``delete_stale=False``.

    What changes is settled on keys; texts are read where they lie, and only those of changed files and chunks are ever
    shuffled. A file that changes during the run is recorded with the hash from its start, so the next run takes it up.
    """
    began, now = time.time(), int(time.time()) if now is None else now
    embed = embed or mock_embedder(dims)
    folder = f"work-{uuid.uuid4().hex[:12]}"

    def pin(df: DataFrame) -> DataFrame:
        """Keys that several tables are made of, written beside the tables for the run, in partitions of a fit size."""
        at = f"{store.root}/{folder}/{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        return store.spark.read.schema(df.schema).parquet(at)

    path = lambda df: df.select(F.col("path").alias("file_path"))
    current, empty = with_hash(files), store.current("chunks") is None
    stored, old_chunks, old_vectors, old_nodes, old_edges = (store.read(n) for n in ("files", "chunks", "vectors", "nodes", "edges"))
    try:
        keys = pin(current.select("path", "language", "mtime", "size", "hash"))
        todo = pin(diff.changed(keys, stored).select("path", "language", "mtime", "size", "hash"))
        total, work = keys.count(), todo.count()
        languages = {r.language for r in todo.select("language").distinct().collect()}
        texts = current if work == total else dml.within(current, todo, diff.SAME, ["path"])
        # a chunk's id has its path in it, so the new chunks of a file replace all its old ones
        new_chunks = parsing.chunk_files(texts, languages)
        old_keys = old_chunks.select("id", "file_path", "content_hash")
        if not empty:
            gone_paths = path(todo)
            if delete_stale:
                gone_paths = gone_paths.unionByName(old_keys.select("file_path").distinct().join(path(keys), "file_path", "left_anti"))
            new_chunks = dml.without(old_chunks, gone_paths, ["file_path"]).unionByName(new_chunks)
        if delete_stale:
            new_chunks = new_chunks.filter("file_path IS NOT NULL")
        graphed = F.coalesce(F.col("language").isin(*sorted(parsing.GRAPHED)), F.lit(False))
        new_nodes, new_edges = parsing.modules(todo.filter(~graphed)), old_edges.limit(0)
        if parsing.GRAPHED & languages:
            found, new_edges = parsing.extract_graph(texts.filter(graphed))
            new_nodes = new_nodes.unionByName(found)
        left = todo.select("path")
        if delete_stale:
            left = left.unionByName(stored.join(keys.select("path"), "path", "left_anti").select("path"))
        nodes, edges = dml.delete_graph(old_nodes, old_edges, left)
        nodes, edges = dml.insert_graph(nodes, edges, new_nodes, new_edges)
        records = dml.upsert(stored, todo.select("path", "mtime", "size", "hash", F.lit(now).cast("long").alias("indexed_at")), ["path"])
        if delete_stale:
            records = records.join(keys.select("path"), "path", "left_semi")
        with store.change():
            chunks_out = store.write("chunks", new_chunks)
            n_chunks, now_keys = chunks_out.count(), chunks_out.select("id", "file_path", "content_hash")
            made = pin(now_keys if empty else dml.within(now_keys, path(todo), ["file_path"]))
            before = pin(dml.within(old_keys, path(todo), ["file_path"]))
            fresh = pin(diff.new_chunks(made, before))
            gone = pin(before.join(made.select("id").distinct(), "id", "left_anti").select("id"))
            created, removed = fresh.count(), gone.count()
            texts = chunks_out if created == n_chunks else dml.within(chunks_out, fresh, ["id", "content_hash"], ["id"])
            text = enrich_chunk(F.col("language"), F.col("file_path"), F.col("parent_context"), F.col("symbol"), F.col("content"))
            vectors = texts.select(F.col("id").alias("chunk_id"), embed(text).alias("embedding")).withColumn("embedding", fit_dims(F.col("embedding"), dims))
            if not empty:
                out = gone.unionByName(fresh.select("id")).select(F.col("id").alias("chunk_id"))
                if delete_stale:
                    out = out.unionByName(old_vectors.select("chunk_id").join(now_keys.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"))
                vectors = dml.without(old_vectors, out, ["chunk_id"]).unionByName(vectors)
            store.write("vectors", vectors)
            detail = store.write("report", diff.per_file(made, fresh, todo))
            store.write("edges", edges)
            store.write("nodes", nodes)
            files_out = store.write("files", records)
            n_files = files_out.count()
            store.write("meta", meta_rows(store.spark, {"provider": provider, "model": model, "dimensions": dims, "created_at": now, "last_sync_at": now, "files_indexed": n_files, "chunks_stored": n_chunks, "version": "4"}))
        return Report(work, total - work, created, removed, n_files, n_chunks, time.time() - began, detail)
    finally:
        store.drop(folder)


def remove(store: Store, paths: DataFrame) -> None:
    """Take files out of the index: chunks, vectors, graph and records, in one change."""
    chunks, vectors, files = store.read("chunks"), store.read("vectors"), dml.delete(store.read("files"), paths, ["path"])
    gone = chunks.select("id", "file_path").join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    chunks, vectors = dml.without(chunks, gone, ["id"]), dml.without(vectors, gone.select(F.col("id").alias("chunk_id")), ["chunk_id"])
    nodes, edges = dml.delete_graph(store.read("nodes"), store.read("edges"), paths)
    with store.change():  # all of it reads the versions from before
        store.write("vectors", vectors)
        store.write("chunks", chunks)
        store.write("edges", edges)
        store.write("nodes", nodes)
        store.write("files", files)


def reindex(stores: dict[str, tuple[Store, DataFrame]], full: bool = False, **options) -> dict[str, Report]:
    """Index each workspace again; ``full`` empties it first."""
    out = {}
    for name, (store, files) in sorted(stores.items()):
        if full:
            store.clear()
        out[name] = index(store, files, **options)
    return out
