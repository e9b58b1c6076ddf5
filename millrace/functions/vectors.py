"""Vector expressions. Arithmetic is double; ``cosine`` stays in the JVM, batch forms use numpy over Arrow."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import MASK, poly31

DEFAULT_DIMS = 384


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, zero-length or unequally long vectors."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size), F.lit(0.0))


def fit_dims(v: Column, dims: int) -> Column:
    """Pad with zeros or truncate to ``dims`` components."""
    return F.slice(F.concat(v.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims)


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def encode_blob(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_blob(blob: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, tokens, dims) states averaged over unmasked tokens and scaled to unit length."""
    m = mask[..., None].astype(float)
    pooled = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    length = np.linalg.norm(pooled, axis=1, keepdims=True)
    return np.divide(pooled, length, out=pooled.copy(), where=length > 0)


def mock_vector(text: str, dims: int) -> np.ndarray:
    """A deterministic unit vector without meaning, from the polynomial hash of the text (modulo 2^64)."""
    base = (poly31(text.encode()) * 37) & MASK
    raw = np.array([((base + i) & MASK) % 1000 for i in range(dims)], np.float32)
    v = (raw - np.float32(500)) / np.float32(500)
    length = np.sqrt((v * v).sum(dtype=np.float32))
    return v / length if length > 0 else v


def seeded_query(dims: int, seed: str) -> np.ndarray:
    """A reproducible query vector from a linear congruential generator."""
    state, out = poly31(seed.encode()), []
    for _ in range(dims):
        state = (state * 6364136223846793005 + 1442695040888963407) & MASK
        top = state >> 33
        out.append(np.float32(top - (1 << 32) if top >= 1 << 31 else top) / np.float32(2**31 - 1))
    v = np.array(out, np.float32)
    length = np.linalg.norm(v)
    return v / length if length > 0 else v


def embedder(embed_batch, dims: int):
    """An Arrow-batched UDF from text to vectors; ``embed_batch(list of str)`` gives one vector each, in order."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32)[:dims].tolist() for v in embed_batch(texts.fillna("").tolist())])

    return run


def mock_embedder(dims: int = DEFAULT_DIMS):
    return embedder(lambda texts: [mock_vector(t, dims) for t in texts], dims)
