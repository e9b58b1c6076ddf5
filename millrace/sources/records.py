"""Records from outside: index metadata, query sets, baselines, trajectories, JSON vectors."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_KEYS = ("provider", "model", "dimensions", "created_at", "last_sync_at", "files_indexed", "chunks_stored", "version")
QUERIES = "query_id int, text string, kind string, target_symbol string, target_tool string, judgments array<struct<file:string,grade:int>>, expected_symbols array<struct<symbol:string,file:string,grade:int>>"


def read_meta(meta: DataFrame) -> DataFrame:
    """The key/value table as one typed row; no row if the provider is missing, an error if another key is.

    An empty last_sync_at is null.
    """
    wide = meta.groupBy().pivot("key", list(META_KEYS)).agg(F.first("value")).filter("provider IS NOT NULL")
    need = lambda k: F.coalesce(F.col(k), F.raise_error(F.lit(f"index metadata lacks {k}")).cast("string"))
    return wide.select("provider", need("model").alias("model"), need("dimensions").cast("int").alias("dimensions"), need("created_at").alias("created_at"), F.nullif(F.col("last_sync_at"), F.lit("")).alias("last_sync_at"), need("files_indexed").cast("long").alias("files_indexed"), need("chunks_stored").cast("long").alias("chunks_stored"), need("version").alias("version"))


def meta_rows(spark: SparkSession, meta: dict) -> DataFrame:
    """An index's metadata as key/value rows."""
    rows = [(k, "" if meta.get(k) is None else str(meta[k])) for k in META_KEYS]
    return spark.createDataFrame(rows, "key string, value string")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A TOML query set: [[queries]] tables with judgments or expected symbols."""
    rows = []
    for i, q in enumerate(tomllib.loads(Path(path).read_text()).get("queries", [])):
        judged = [(j["file"], int(j["grade"])) for j in q.get("judgments", q.get("relevance", []))]
        expected = [(s["symbol"], s.get("file"), int(s.get("grade", 1))) for s in q.get("expected_symbols", [])]
        rows.append((i, q.get("text", q.get("query", "")), q.get("kind", "semantic"), q.get("target_symbol"), q.get("target_tool"), judged, expected))
    return spark.createDataFrame(rows, QUERIES)


def load_corpus_config(path: str, name: str) -> dict:
    """One named corpus of a TOML file, either a table or a list of tables ('corpora')."""
    found = tomllib.loads(Path(path).read_text()).get("corpora", {}).get(name)
    if found is None:
        raise KeyError(f"no corpus {name} in {path}")
    return {"corpora": found} if isinstance(found, list) else found


def load_baseline(path: str) -> dict:
    """A baseline file: version "1", corpus and embedder not empty, and its metrics."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ValueError(f"unable to load baseline: {e}") from e
    if str(found.get("version")) != "1":
        raise ValueError(f"unable to load baseline: unsupported version {found.get('version')!r}, expected '1'")
    for key in ("corpus", "embedder"):
        if not found.get(key):
            raise ValueError(f"unable to load baseline: {key!r} is empty")
    return found


def metric_rows(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "name string, value double")


def json_vectors(rows: DataFrame) -> DataFrame:
    """(chunk_id, embedding) from vectors kept as JSON text; malformed ones drop out."""
    parsed = rows.select("chunk_id", F.from_json("embedding", "array<float>").alias("embedding"))
    return parsed.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()))


def load_trajectory(spark: SparkSession, path: str, entry_schema: str) -> tuple[dict, DataFrame]:
    """A JSON Lines trajectory: the metadata of its first line, and its entries in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).filter("line <> ''")
    first = lines.filter("i = 0").first()
    entries = lines.filter("i > 0").select("i", F.from_json("line", entry_schema).alias("e")).select(F.col("i").alias("seq"), "e.*")
    return json.loads(first.line) if first else {}, entries


def save_trajectory(entries: DataFrame, meta: dict, path: str) -> None:
    """Write a trajectory as one JSON Lines file: metadata first, then entries by their ``seq``."""
    spark = entries.sparkSession
    head = spark.createDataFrame([(-1, json.dumps(meta))], "seq int, value string")
    body = entries.select("seq", F.to_json(F.struct(*(c for c in entries.columns if c != "seq"))).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)


def coerce_array(column, element: str = "string"):
    """An array from a JSON array, or from a string that holds one."""
    return F.coalesce(F.from_json(column, f"array<{element}>"), F.from_json(F.from_json(F.concat(F.lit("["), column, F.lit("]")), "array<string>")[0], f"array<{element}>"))
