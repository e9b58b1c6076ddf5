"""Ranking quality as DataFrame plans: rankings joined with judgments, all queries at once."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.vectors import seeded_query
from millrace.operators import graph

MODES = {"all": ["dense", "sparse", "hybrid", "hybrid-rerank"]}
SLO_SECONDS, WARM_UPS = 360, 5


def best_per_file(results: DataFrame) -> DataFrame:
    """(query_id, doc, score, rank): each file once with its best chunk's score, not below 0; ties by name."""
    best = results.groupBy("query_id", F.col("file_path").alias("doc")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc")))


def judgments(queries: DataFrame) -> DataFrame:
    """(query_id, doc, grade) of the query set's nested judgments."""
    return queries.select("query_id", F.explode("judgments").alias("j")).select("query_id", F.col("j.file").alias("doc"), F.col("j.grade").alias("grade"))


def relevant(judged: DataFrame) -> DataFrame:
    return judged.filter("grade >= 1")


def metrics(rankings: DataFrame, judged: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10), ndcg_k: int = 10) -> DataFrame:
    """query_id, recall_at_<k>, ndcg_at_<k>, mrr for every query; 0 where nothing is relevant or retrieved.

    Gains are linear, discounts log2(rank + 1), ideals from all judged grades.
    """
    grades = judged.groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))
    joined = rankings.select("query_id", "doc", "rank").join(grades, ["query_id", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = F.col("grade") >= 1
    found = joined.groupBy("query_id").agg(
        *(F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"_h{k}") for k in ks),
        F.sum(F.when(F.col("rank") <= ndcg_k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("_first"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("grade"), "doc")
    ideal = grades.withColumn("_r", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("_r") <= ndcg_k, F.col("grade") / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("_ideal"), F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0)).alias("_n")
    )
    all_ = queries.select("query_id").distinct().join(found, "query_id", "left").join(ideal, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return all_.select("query_id", *(ratio(f"_h{k}", "_n").alias(f"recall_at_{k}") for k in ks), ratio("_dcg", "_ideal").alias(f"ndcg_at_{ndcg_k}"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def symbol_metrics(predicted: DataFrame, expected: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10), precision_k: int = 5) -> DataFrame:
    """query_id, symbol_recall_at_<k>, symbol_precision_at_<k> for (query_id, key, rank) predictions.

    Duplicates in a prediction count each time, so recall can pass 1; precision divides by k.
    """
    right = expected.filter("grade >= 1").select("query_id", "key").distinct()
    marked = predicted.join(right.withColumn("_hit", F.lit(1)), ["query_id", "key"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("_hit")).otherwise(0))
    hits = marked.groupBy("query_id").agg(*(at(k).alias(f"_h{k}") for k in ks), at(precision_k).alias("_p"))
    out = queries.select("query_id").distinct().join(hits, "query_id", "left").join(right.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left")
    return out.select("query_id", *(F.coalesce(F.when(F.col("_n") > 0, F.col(f"_h{k}") / F.col("_n")), F.lit(0.0)).alias(f"symbol_recall_at_{k}") for k in ks), F.coalesce(F.col("_p") / precision_k, F.lit(0.0)).alias(f"symbol_precision_at_{precision_k}"))


def symbol_key(file: Column, symbol: Column) -> Column:
    """file::symbol; external symbols have no file."""
    return F.concat_ws("::", F.coalesce(file, F.lit("")), symbol)


def structural(nodes: DataFrame, edges: DataFrame, kind: str, symbol: str, query_id: int) -> DataFrame:
    """(query_id, key, rank) of a structural query."""
    found = graph.LOOKUPS[kind](nodes, edges, symbol).select(symbol_key(F.col("file_path"), F.col("symbol")).alias("key"))
    return found.select(F.lit(query_id).alias("query_id"), "key", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("key")).alias("rank"))


def aggregate(per_query: DataFrame, by: list[str] = ()) -> DataFrame:
    """The mean of every metric over queries."""
    return per_query.groupBy(*by).agg(*(F.avg(c).alias(c) for c in per_query.columns if c not in ("query_id", *by)))


def run(queries: list[tuple[int, str]], search: Callable[[str], DataFrame], judged: DataFrame, limit: int = 10) -> DataFrame:
    """Search every (query_id, text) and measure; results of all queries are one union."""
    out = None
    for query_id, text in queries:
        one = search(text).limit(limit).select(F.lit(query_id).alias("query_id"), "file_path", "score")
        out = one if out is None else out.unionByName(one)
    asked = judged.sparkSession.createDataFrame(queries, "query_id int, text string")
    return metrics(best_per_file(out), judged, asked)


def run_modes(modes: list[str], one: Callable[[str], DataFrame]) -> DataFrame:
    """Per-query metrics of several modes with a ``mode`` column; 'all' stands for the four search modes."""
    names = [m for x in modes for m in MODES.get(x, [x])]
    out = None
    for m in dict.fromkeys(names):
        df = one(m).withColumn("mode", F.lit(m))
        out = df if out is None else out.unionByName(df)
    return out


def within_slo(seconds: float, limit: float = SLO_SECONDS) -> bool:
    return seconds <= limit


def peak_rss_bytes() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def disk_bytes(files: DataFrame) -> int:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n


def latency(search: Callable[[list[float]], DataFrame], dims: int, sample: int, warm_ups: int = WARM_UPS) -> tuple[float, float]:
    """(p50, p95) milliseconds by nearest rank of ``sample`` seeded queries after warm-ups; zeros without a sample."""
    if not sample:
        return 0.0, 0.0
    times = []
    for i in range(warm_ups + sample):
        q = [float(x) for x in seeded_query(dims, f"query-{i}")]
        began = time.perf_counter()
        search(q).collect()
        times.append((time.perf_counter() - began) * 1000)
    times = sorted(times[warm_ups:])
    rank = lambda q: times[max(0, -(-int(q * 1000) * len(times) // 1000) - 1)]
    return rank(0.5), rank(0.95)


def store_report(backend: str, corpus: str, report, sizes: DataFrame, search, dims: int, sample: int = 0, embedder: str = "mock", limit: int = SLO_SECONDS) -> dict:
    """A store benchmark's row: indexing, memory, disk and query latency."""
    p50, p95 = latency(search, dims, sample)
    return {"backend": backend, "corpus": corpus, "indexing_secs": report.seconds, "files_indexed": report.files_indexed, "chunks_created": report.chunks_created, "peak_rss_bytes": peak_rss_bytes(), "disk_size_bytes": disk_bytes(sizes), "query_p50_ms": p50, "query_p95_ms": p95, "query_sample_size": sample, "slo_passed": within_slo(report.seconds, limit), "slo_limit_secs": limit, "embedder": embedder}
