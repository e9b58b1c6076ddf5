"""Exact top-k inner products over norm-sorted vectors.

Vectors become whole numbers, floor(scale * x), are rotated by the singular vectors of the whole set (from
the summed Gram matrix) and sorted by length into blocks of bounded size. Query blocks meet vector blocks in
descending length. With t the k-th best score that a query has so far, Cauchy-Schwarz rules out a block whose
longest vector has |q||v| < t, and within a block each vector whose leading rotated terms and residual lengths
give q1.v1 + |q2||v2| < t; the rest get their exact product. Thresholds start from the longest vectors of all (one
block) and rise as a task goes down its blocks. Groups of query blocks meet runs of vector blocks that follow each
other in length, so that short vectors are ruled out whole before anything moves, and a vector moves once per group
of ``GROUP`` query blocks that can reach it.

Products are exact at every size: where |q||v| is below 2^53 all partial sums are whole doubles, and beyond that the
products that could be among the best are summed as Python integers. A score outside +-(2^63 - 1) counts as the
nearer of these two numbers, in rank and result.

Vectors that are null or hold a null or non-finite component (also one that ``scale`` makes infinite) take no part,
nor do null ids. Shorter vectors count as padded with zeros; empty ones score 0. Ties go to the smaller id. Rows
count singly: a query's own row is no candidate, but a repeated row is, and a repeated query row has its own
results. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release

#: Vectors of a candidate block, queries of a query block, leading rotated dimensions.
BLOCK, QUERIES, LEAD = 4096, 512, 16
#: Vector blocks and query blocks that meet in one task; numbers that a block may hold.
RUN, GROUP, NUMBERS = 16, 16, 1 << 20
SCALE = 256
#: No score yet; scores outside this range count as its ends.
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Share of |q||v| that rounding may take or give in what is pruned by.
SLACK = 1e-9


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers) of the vectors that take part; ``row`` numbers the rows."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda e: e.cast("double") * scale)
    fine = F.forall(scaled, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(scaled, lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e))
    out = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(fine)
    return out.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for r, x in zip(out, rows, strict=True):
        r[: len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int, unit: float) -> np.ndarray:
    """Right singular vectors of all rows, largest first, from Gram matrices summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch["v"].to_pylist(), dim) / unit
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "g"])

    cells = vectors.select("v").mapInArrow(run, "i long, g array<double>").select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    lines = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("g")).select("i", "g.x").orderBy("i").collect()  # dim rows
    gram = np.array([r.x for r in lines]) if lines else np.zeros((dim, dim))
    return np.linalg.eigh(gram)[1][:, ::-1]


def blocks(vectors: DataFrame, dim: int, size: int, together: int, by_norm: bool, kind: str) -> DataFrame:
    """Blocks of at most ``size`` vectors as bytes with their longest length; ``team`` joins ``together`` that follow.

    By length, range partitions keep vectors of like length together; otherwise any order does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, pd.DataFrame()
        for pdf in batches:
            held = pd.concat([held, pdf], ignore_index=True)
            while len(held) >= size:
                yield _row(held[:size], (part << 32) + made // together)
                held, made = held[size:], made + 1
        if len(held):
            yield _row(held, (part << 32) + made // together)

    def _row(rows: pd.DataFrame, team: int) -> pd.DataFrame:
        text = lambda c: rows[c].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"team": [team], "ids": [text("vec_id")], "rows": [text("row")], "data": [_matrix(rows["v"].tolist(), dim).astype(kind).tobytes()], "longest": [float(rows["norm"].max())]})

    if by_norm:
        vectors = vectors.orderBy(F.desc("norm"), "row")
    return vectors.select("row", "vec_id", "v", "norm").mapInPandas(run, "team long, ids binary, rows binary, data binary, longest double")


def _merge(best_s, best_i, scores, ids, k):
    """The k best of both, per row, by descending score and ascending id."""
    s, i = np.concatenate([best_s, scores], 1), np.concatenate([best_i, ids], 1)
    order = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Search:
    """One query block going down vector blocks with rising thresholds; lengths are in units of ``unit``."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, unit: float, start: np.ndarray | None = None):
        self.rows, self.q, self.k, self.turn, self.unit = rows, queries, k, turn, unit
        self.lead = min(LEAD, turn.shape[0])
        self.scaled = queries / unit
        rotated = self.scaled @ turn
        self.head, self.tail = rotated[:, : self.lead], np.linalg.norm(rotated[:, self.lead :], axis=1)
        self.norm = np.linalg.norm(self.scaled, axis=1)
        self.scores = np.full((len(rows), k), NONE)
        self.found = np.full((len(rows), k), MOST)
        self.start = np.full(len(rows), NONE) if start is None else start

    def least(self) -> np.ndarray:
        """The score that each query's next candidate must reach, in squared units."""
        t = np.maximum(self.start, self.scores[:, -1])
        return np.where(t == NONE, -np.inf, t / self.unit / self.unit)

    def visit(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, longest: float) -> int:
        """Take in a block; returns the number of exact products."""
        t = self.least()
        slack = SLACK * self.norm * longest
        live = np.flatnonzero(self.norm * longest + slack >= t - SLACK * np.abs(t))
        if not len(live):
            return 0
        scaled = vectors / self.unit
        rotated = scaled @ self.turn
        bound = self.head[live] @ rotated[:, : self.lead].T + np.outer(self.tail[live], np.linalg.norm(rotated[:, self.lead :], axis=1))
        maybe = (bound + slack[live, None] >= (t - SLACK * np.abs(t))[live, None]) & (self.rows[live, None] != rows[None, :])
        columns = np.flatnonzero(maybe.any(0))
        if not len(columns):
            return 0
        maybe = maybe[:, columns]
        if self.norm.max() * longest * self.unit * self.unit < 1 << 53:
            exact = np.where(maybe, self.q[live] @ vectors[columns].T, 0.0).astype(np.int64)
            exact[~maybe] = NONE
        else:
            exact = self.wide(live, vectors[columns], scaled[columns], maybe, slack)
        who = np.broadcast_to(ids[columns], exact.shape)
        if exact.shape[1] > self.k:
            # ties at the cut must go to the smaller id, so all that reach the k-th score stay
            cut = np.partition(exact, exact.shape[1] - self.k, axis=1)[:, exact.shape[1] - self.k]
            most = int((exact >= cut[:, None]).sum(1).max())
            order = np.argsort(~exact, axis=1, kind="stable")[:, :most]
            exact, who = np.take_along_axis(exact, order, 1), np.take_along_axis(who, order, 1)
        who = np.where(exact == NONE, MOST, who)
        self.scores[live], self.found[live] = _merge(self.scores[live], self.found[live], exact, who, self.k)
        return int(maybe.sum())

    def wide(self, live: np.ndarray, vectors: np.ndarray, scaled: np.ndarray, maybe: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Exact scores beyond 2^53 of what rounded products leave among the k best; NONE for the rest."""
        rounded = np.where(maybe, self.scaled[live] @ scaled.T, -np.inf)
        out = np.full(rounded.shape, NONE)
        for r, q in enumerate(live):
            line = rounded[r]
            kth = np.partition(line, len(line) - self.k)[len(line) - self.k] if len(line) > self.k else -np.inf
            # scores beyond the range tie at its end, so all of them stay
            bar = min(kth - 2 * slack[q], float(MOST) / self.unit / self.unit * (1 - 1e-6) - 2 * slack[q])
            numbers = [int(x) for x in self.q[q]]
            for c in np.flatnonzero(maybe[r] & (line >= bar)):
                score = sum(a * int(b) for a, b in zip(numbers, vectors[c], strict=True))
                out[r, c] = max(-int(MOST), min(int(MOST), score))
        return out


def search(vectors: DataFrame, every: int, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialize(whole(vectors, scale), "vectors")
    dim, top = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim, unit = max(1, dim or 1), max(1.0, top or 1.0)
    kind = "<f4" if unit <= 1 << 24 else "<f8"  # both hold the whole numbers exactly
    size = max(1, min(BLOCK, NUMBERS // dim))
    rows_ = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + (e / unit) * (e / unit))))
    turn = rotation(rows, dim, unit)
    by_length = materialize(blocks(rows_, dim, size, RUN, True, kind), "vector-blocks")
    queries = materialize(blocks(rows_.filter(F.pmod("vec_id", F.lit(every)) == 0), dim, min(QUERIES, size), GROUP, False, kind), "query-blocks")
    shared = spark.sparkContext.broadcast(turn)  # dim * dim numbers
    # the longest block of all: one row of at most NUMBERS numbers, whose k-th scores are where thresholds start
    first = by_length.orderBy(F.desc("longest"), "team", F.xxhash64("rows")).limit(1).collect()
    seed = spark.sparkContext.broadcast((bytes(first[0].ids), bytes(first[0].rows), bytes(first[0].data), first[0].longest) if first else None)

    def parts(ids: bytes, numbers: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(numbers, np.int64), np.frombuffer(data, kind).reshape(-1, dim).astype(float)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for team, ids, numbers, data in zip(*(batch[c].to_pylist() for c in ("team", "ids", "rows", "data")), strict=True):
                _, own, q = parts(ids, numbers, data)
                s = Search(own, q, shared.value, k, unit)
                s.visit(*parts(*seed.value[:3]), seed.value[3])
                t = s.least()
                # a run whose longest vector is below this length can hold no candidate of any of these queries
                reach = float(np.min(np.where(np.isneginf(t) | (t <= 0), -np.inf, t * (1 - 1e-6) / np.maximum(s.norm, 1e-300)), initial=np.inf))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
                row = (team, ids, numbers, data, s.scores[:, -1].tobytes(), reach)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["team", "ids", "rows", "data", "least", "reach"])

    ready = materialize(queries.mapInArrow(starts, "team long, ids binary, rows binary, data binary, least binary, reach double"), "queries")
    # numbers only: which groups of query blocks can reach which runs of vector blocks
    runs = by_length.groupBy("team").agg(F.max("longest").alias("longest"))
    groups = ready.groupBy(F.col("team").alias("asks")).agg(F.min("reach").alias("reach"))
    plan = materialize(runs.join(groups, F.col("longest") >= F.col("reach")).select("team", "asks"), "plan")

    def go(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        asking = []
        for q in left.itertuples():
            ids, own, data = parts(q.ids, q.rows, q.data)
            asking.append((ids, Search(own, data, shared.value, k, unit, np.frombuffer(q.least, np.int64))))
        for b in right.sort_values("longest", ascending=False).itertuples():
            block = parts(b.ids, b.rows, b.data)
            for _, s in asking:
                s.visit(*block, b.longest)
        for ids, s in asking:
            hit = s.scores > NONE
            many = hit.sum(1)
            out.append(pd.DataFrame({"row": np.repeat(s.rows, many), "query_id": np.repeat(ids, many), "vec_id": s.found[hit], "score": s.scores[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})

    left = ready.withColumnRenamed("team", "asks").join(plan, "asks")
    right = by_length.join(plan, "team")
    found = left.groupBy("asks", "team").cogroup(right.groupBy("asks", "team")).applyInPandas(go, "row long, query_id long, vec_id long, score long")
    best = found.groupBy("row", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    out = materialize(best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score")), "topk")
    release(rows, by_length, queries, ready, plan)
    return out
