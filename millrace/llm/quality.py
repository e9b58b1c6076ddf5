"""Quality classification by nearest-neighbour voting in a latent semantic space.

Terms are hashed words plus the shapes of words (case, digits, symbols, length, equality with the word
before) in runs of one to three. Term weights are log(1 + tf) * idf, scaled to unit length. A truncated
SVD of a bounded labelled sample gives the latent space; every labelled vector of that sample is broadcast
(``SAMPLE`` x ``RANK`` floats). A document's score is the similarity-weighted share of label 1 among its
``NEIGHBOURS`` nearest labelled vectors by exact cosine, computed in blocks as matrix products.

Null and empty texts get the sample's share of label 1, as do all texts if no row is labelled (0.5 then).
Texts are taken whole. Equal similarities go to the earlier sampled row. Repeated rows are scored as often
as they occur; a document with several labels counts once per label; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import smallest
from millrace.llm.textvec import counted, fresh, lowered, mix, slices, spaced, span_hashes, text_buffers, trim

#: Hash buckets, latent dimensions, the largest labelled sample, neighbours that vote, rows of a block.
TERMS, RANK, SAMPLE, NEIGHBOURS, BLOCK = 4096, 48, 3000, 25, 2048
SEED = 11
#: Share of a document's weight that words have beside shapes.
WORD_WEIGHT = 0.25

_KIND = np.zeros(256, np.uint8)  # bits: 1 lower, 2 upper, 4 digit, 8 symbol
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[(_KIND == 0)] = 8
_KIND[[44, 46, 39, 45]] = 0


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a slice of rows, with counts. The upper half of the buckets has shapes."""
    starts, ends, rows = spaced(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows, np.zeros(0, np.int64)
    hashes = span_hashes(lowered(raw), starts, ends)
    kinds = _KIND[raw]
    bits = np.bitwise_or.reduceat(kinds, np.c_[starts, np.minimum(ends, len(raw) - 1)].ravel())[::2]
    last = ends == len(raw)
    bits[last] = [np.bitwise_or.reduce(kinds[a:b]) for a, b in zip(starts[last], ends[last], strict=True)]
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])]
    shape = (bits.astype(np.uint64) << np.uint64(6)) | (np.minimum(ends - starts, 31).astype(np.uint64) // np.uint64(4) << np.uint64(2)) | (same.astype(np.uint64) << np.uint64(1)) | ((kinds[starts] == 2).astype(np.uint64))
    half = np.uint64(TERMS // 2)
    keys, of = [hashes % half, half + mix(shape) % half], [rows, rows]
    for n in (2, 3):
        k = len(shape) - n + 1
        if k > 0:
            s = shape[:k]
            for j in range(1, n):
                s = s << np.uint64(10) | shape[j : j + k]
            keep = rows[:k] == rows[n - 1 :]
            keys.append(half + mix(s[keep] + np.uint64(n)) % half)
            of.append(rows[:k][keep])
    return counted(np.concatenate(keys), np.concatenate(of))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # (sample, RANK), unit length
    labels: np.ndarray
    prior: float

    def embed(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, self.basis.shape[1]), np.float32)
        for i, j in slices(offsets):
            keys, rows, counts = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(keys):
                continue
            value = (np.log1p(counts) * self.idf[keys.astype(np.int64)]).astype(np.float32)
            bounds = np.r_[0, np.cumsum(np.bincount(rows, minlength=j - i))]
            for r in range(j - i):
                a, z = bounds[r], bounds[r + 1]
                if z > a:
                    v = value[a:z]
                    out[i + r] = (v @ self.basis[keys[a:z].astype(np.int64)]) / max(float(np.sqrt(v @ v)), 1e-12)
        return out

    def score(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(vectors), BLOCK):
            part = vectors[i : i + BLOCK]
            real = np.linalg.norm(part, axis=1) > 1e-9
            sims = _unit(part) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(part), 1))
            least = np.take_along_axis(sims, near, 1).min(1)
            tied = np.flatnonzero((sims >= least[:, None]).sum(1) > k)
            near[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 4 + 1e-9
            out[i : i + BLOCK][real] = ((weight * self.labels[near]).sum(1) / weight.sum(1))[real]
        return np.clip(out, 0.0, 1.0)


def sample(rows: DataFrame, usable: Column, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows: those with the smallest hashes of their ids. The bound is a parameter of the fit."""
    return smallest(rows.filter(usable & F.col("label").isNotNull()), most, SEED, ties=("label",))


def fit(rows: DataFrame) -> Model:
    """Fit on (text, label) rows, which ``sample`` bounds; terms are counted on the executors, the SVD is the driver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            keys, counts = [], []
            for i, j in slices(offsets):
                k, r, c = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = np.r_[0, np.cumsum(np.bincount(r, minlength=j - i))]
                keys += [k[a:z].astype(np.int32).tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                counts += [c[a:z].astype(np.float32).tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["label", "keys", "counts"])

    got = rows.select(F.col("label").cast("double"), "text").mapInArrow(run, "label double, keys binary, counts binary").toArrow()
    labels = np.array(got["label"].to_pylist(), float)
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    dense = np.zeros((len(labels), TERMS), np.float32)
    for row, k, c in zip(dense, got["keys"].to_pylist(), got["counts"].to_pylist(), strict=True):
        row[np.frombuffer(k, np.int32)] = np.log1p(np.frombuffer(c, np.float32))
    idf = np.log((1 + len(labels)) / (1 + (dense > 0).sum(0))).astype(np.float32) + 1
    idf[: TERMS // 2] *= WORD_WEIGHT
    dense *= idf
    dense = _unit(dense).astype(np.float32)
    rank = min(RANK, *dense.shape)
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(dense @ rng.standard_normal((TERMS, rank + 8), np.float32))[0]
    for _ in range(3):  # subspace iteration
        q = np.linalg.qr(dense @ np.linalg.qr(dense.T @ q)[0])[0]
    _, s, vt = np.linalg.svd(q.T @ dense, full_matrices=False)
    basis = np.ascontiguousarray(vt[:rank].T.astype(np.float32))
    return Model(idf, basis, _unit(dense @ basis).astype(np.float32), labels, float(labels.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a ``score`` column added; the text is read whole and dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: SAMPLE x RANK and TERMS x RANK floats
    names = [n for n in docs.columns if n not in ("text", "score")]
    ddl = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        m = shared.value
        for batch in batches:
            found = m.score(m.embed(*text_buffers(batch["text"])))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found)], [*names, "score"])
            trim()

    return docs.select(*(f"`{n}`" for n in names), "text").mapInArrow(run, ddl)
