"""Reciprocal-rank fusion, hybrid search with degradation, reranking and merging over workspaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["file_path", "start_line", "end_line"]
RRF_K, RERANK = 60, 20


def ranked(results: DataFrame, by: list[str] = (), tie: list[str | Column] = KEY) -> DataFrame:
    """Add ``rank`` from 1 by descending score, per ``by`` keys if given."""
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return results.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), *tie)))


def rrf(lists: list[DataFrame], k: int = RRF_K, limit: int | None = 10, by: list[str] = (), key: list[str] = KEY) -> DataFrame:
    """Fuse lists with a ``rank`` column: score is the sum of 1 / (k + rank) per key.

    A key's other columns are those of its first occurrence (list order, then rank). A row that a list repeats
    adds each time. Ties go by key. One shuffle on the key; ``by`` adds query keys for batches.
    """
    keys = [*by, *key]
    columns = [c for c in lists[0].columns if c not in (*keys, "rank", "score")]
    marked = [x.select(*keys, F.col("rank").cast("long").alias("rank"), *columns, F.lit(i).alias("_list")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, marked)
    first = [F.min_by(F.struct(*columns), F.struct("_list", "rank")).alias("_m")] if columns else []
    fused = both.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *first)
    fused = fused.select(*keys, *(["_m.*"] if columns else []), "score")
    if limit is None:
        return fused
    if by:
        return ranked(fused, list(by), key).filter(F.col("rank") <= limit).drop("rank")
    return fused.orderBy(F.desc("score"), *key).limit(limit)


def hybrid(dense: Callable[[], DataFrame], sparse: Callable[[], DataFrame], k: int = RRF_K, limit: int = 10, sparse_tie: list[str | Column] = KEY) -> DataFrame:
    """Fuse both legs; if one fails, in analysis or execution, the other alone; if both fail, an error.

    Each leg has at most its own limit of rows, so it is run and kept before fusing. Equal scores of the dense leg
    rank by key, those of the lexical one by ``sparse_tie``.
    """
    legs, errors = [], []
    for leg, tie in ((dense, KEY), (sparse, sparse_tie)):
        try:
            df = ranked(leg(), tie=tie)
            rows = df.collect()  # a leg returns its top-k
            legs.append(df.sparkSession.createDataFrame(rows, df.schema))
        except (PySparkException, ValueError, RuntimeError) as e:
            errors.append(e)
    if not legs:
        raise RuntimeError(f"both search legs failed: {errors[0]}; {errors[1]}")
    shared = [c for c in legs[0].columns if all(c in x.columns for x in legs)]
    return rrf([x.select(shared) for x in legs], k, limit)


def overlap_scorer(query: str, documents: list[str]) -> list[float]:
    """The built-in relevance score: the share of the query's words that a document has."""
    words = set(query.lower().split())
    return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


def sigmoid_scorer(logits: Callable[[str, list[str]], list[float]]) -> Callable[[str, list[str]], list[float]]:
    """A cross-encoder's logits as scores in (0, 1)."""
    import math

    return lambda query, docs: [1 / (1 + math.exp(-x)) for x in logits(query, docs)]


def rerank(results: DataFrame, query: str, top_k: int = RERANK, scorer: Callable[[str, list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """Score the first ``top_k`` rows (by ``rank``) again; the tail keeps its order behind them.

    A scorer that fails leaves the order as it was. Output has ``rank`` anew; scored rows have the new score.
    """
    names, schema = results.columns, results.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _new double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            try:
                new = list(map(float, scorer(query, pdf["content"].fillna("").tolist())))
            except Exception:  # noqa: BLE001  any failure of a model means the old order
                new = [None] * len(pdf)
            yield pdf.assign(_new=pd.Series(new, pdf.index, dtype=float))

    head = results.filter(F.col("rank") <= top_k).mapInPandas(run, ddl)
    tail = results.filter(F.col("rank") > top_k).withColumn("_new", F.lit(None).cast("double"))
    both = head.withColumn("_seg", F.lit(0)).unionByName(tail.withColumn("_seg", F.lit(1)))
    order = W.partitionBy(F.lit(0)).orderBy("_seg", F.desc_nulls_last("_new"), "rank")  # a result list, not a table
    out = both.withColumn("_r", F.row_number().over(order)).withColumn("score", F.coalesce("_new", "score"))
    return out.select(*(F.col("_r").alias("rank") if c == "rank" else F.col(c) for c in names)).orderBy("rank")


def merge(results: dict[str, DataFrame], limit: int = 10, tie: list[str | Column] = ("repo_name", *KEY)) -> DataFrame:
    """Results of several workspaces with ``repo_name``, by descending score, then ``tie``, cut to ``limit``."""
    marked = [df.withColumn("repo_name", F.lit(name)) for name, df in sorted(results.items())]
    return reduce(DataFrame.unionByName, marked).orderBy(F.desc("score"), *tie).limit(limit)
