"""Exact vector search: brute force over all vectors, one query or a batch, with filters before or after."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.vectors import cosine
from millrace.operators.lookups import narrow

#: The largest batch of query vectors that is sent to all tasks; larger ones meet the vectors block by block.
BATCH = 10_000
#: Queries and vectors of one matrix product.
BLOCK = (512, 4096)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` nearest vectors of one query: the vector relation's columns and score, ties by id.

    The query is a literal, its length is folded, and the limit becomes one partial top-k per partition.
    """
    scored = vectors.withColumn("score", cosine(F.col("embedding"), literal(query)))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.drop("embedding").orderBy(F.desc("score"), "chunk_id").limit(k)


def search(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.0, language: str | None = None, path: str | None = None) -> DataFrame:
    """Dense search: filters narrow the chunks first, so the top-k is exact under them; then chunks join the k hits."""
    source = vectors
    if language is not None or path is not None:
        source = vectors.join(narrow(chunks, language, path).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    hits = knn(source, query, limit, threshold)
    return hits.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").orderBy(F.desc("score"), "chunk_id")


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Equally long vectors as rows, and which of them hold a null."""
    values = column.flatten()
    shape = (len(column), len(values) // max(1, len(column)))
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(shape), values.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(1)


def _norms(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for x in m.T:  # component by component, as the vector expressions add
        out += x * x
    return np.sqrt(out)


def _by_size(column: pa.ListArray):
    """(size, rows) of the vectors that are not null."""
    size = pc.list_value_length(column)
    return [(n, np.flatnonzero(pc.equal(size, n).fill_null(False).to_numpy(zero_copy_only=False))) for n in pc.unique(size).to_pylist() if n is not None]


def _first_copies(v: np.ndarray, null: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have ``k`` equal vectors with smaller ids: such can be in no top-k."""
    key = np.ascontiguousarray(np.column_stack([v, null.astype(float)]))
    _, group = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((place, group))
    start = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)])) < k]


#: Approximate scores closer than this are told apart by exact ones.
MARGIN = 1e-9


def _best(v: np.ndarray, vn: np.ndarray, vnull: np.ndarray, place: np.ndarray, q: np.ndarray, qn: np.ndarray, qnull: np.ndarray, k: int, threshold: float | None):
    """(query row, vector row, score) of each query's ``k`` best vectors of a block.

    A matrix product finds the candidates; their scores are then summed component by component, as Spark and SQL do,
    so equal vectors tie and scores don't depend on blocks. Vectors without a usable length are always candidates.
    """
    tame = lambda n: (n > 1e-100) & (n < 1e100)
    wild = ~tame(qn)[:, None] | ~tame(vn)[None, :]
    with np.errstate(all="ignore"):
        near = (q @ v.T) / (qn[:, None] * vn[None, :])
        near[wild] = -np.inf
        last = np.partition(near, len(v) - k, axis=1)[:, len(v) - k, None] if len(v) > k else np.full((len(q), 1), -np.inf)
        a, b = np.nonzero(wild | (near >= last - MARGIN))
        total, length = np.zeros(len(a)), qn[a] * vn[b]
        for x, y in zip(v.T, q.T, strict=True):
            total += x[b] * y[a]
        score = np.where((length <= 0) | vnull[b] | qnull[a], 0.0, total / length)
    if threshold is not None:
        keep = ~(score < threshold)
        a, b, score = a[keep], b[keep], score[keep]
    order = np.lexsort((place[b], -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), a))
    a, b, score = a[order], b[order], score[order]
    start = np.flatnonzero(np.r_[True, np.diff(a) > 0]) if len(a) else np.zeros(0, int)
    first = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < k
    return a[first], b[first], score[first]


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, id: str = "chunk_id", batch: int = BATCH) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest vectors of each (query_id, embedding) row.

    The query set is stated and its size is counted: up to ``batch`` rows it is broadcast, a larger one is cut
    into blocks by hash that are searched one after another. Vectors are spread over all cores and meet the queries
    in blocks of bounded size; only each block's best rows leave it.
    """
    sc = vectors.sparkSession.sparkContext
    n = queries.count()
    parts = max(1, -(-n // batch))
    tasks = 3 * max(4, sc.defaultParallelism)
    v = vectors.select(F.col(id), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL").repartition(tasks, id)
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    schema = T.StructType([q.schema["query_id"], v.schema[id], T.StructField("score", T.DoubleType())])

    def search_in(asked):
        def run(batches):
            ids, sets = asked.value
            for found in batches:
                values = found.column(0).to_pylist()
                place = np.empty(len(values), int)
                place[sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i]))] = np.arange(len(values))
                for size, rows in _by_size(found.column(1)):
                    if size not in sets:
                        continue
                    m, null = _matrix(found.column(1).take(pa.array(rows)))
                    few = _first_copies(m, null, place[rows], k)
                    rows, m, null = rows[few], m[few], null[few]
                    norms = _norms(m)
                    of, qm, qnorms, qnull = sets[size]
                    for i in range(0, len(of), BLOCK[0]):
                        for j in range(0, len(rows), BLOCK[1]):
                            s, t = slice(i, i + BLOCK[0]), slice(j, j + BLOCK[1])
                            a, b, score = _best(m[t], norms[t], null[t], place[rows[t]], qm[s], qnorms[s], qnull[s], k, threshold)
                            columns = [ids.take(pa.array(of[s][a])), found.column(0).take(pa.array(rows[t][b])), pa.array(score)]
                            yield pa.RecordBatch.from_arrays(columns, names=["query_id", id, "score"])

        return run

    out = None
    for i in range(parts):
        block = q if parts == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        rows = block.toArrow().combine_chunks()  # about ``batch`` rows
        ids, embedded = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        sets = {}
        for size, of in _by_size(embedded):
            m, null = _matrix(embedded.take(pa.array(of)))
            sets[size] = (of, m, _norms(m), null)
        scored = v.mapInArrow(search_in(sc.broadcast((ids, sets))), schema)
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id))).filter(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("query_id", "rank", id, "score")
