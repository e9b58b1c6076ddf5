"""Digests that identify chunks, contents, nodes and requests (SHA-256, hexadecimal), and seeded generators."""

from __future__ import annotations

import json
from hashlib import sha256

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def chunk_id(path: Column, byte_start: Column, byte_end: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, byte_start.cast("string"), byte_end.cast("string")), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def node_id(path: Column, symbol: Column) -> Column:
    """Nodes are known by path and symbol; a module node (null symbol) by its path."""
    return F.when(symbol.isNull(), F.sha2(path, 256)).otherwise(F.sha2(F.concat(path, F.lit("|"), symbol), 256))


def request_key(request: dict) -> str:
    """Cache key of a request: the digest of its JSON."""
    return sha256(json.dumps(request, separators=(",", ":")).encode()).hexdigest()


def judge_key(task: str, answer: str, rubric: str) -> str:
    return sha256(f"{task}:{answer}:{rubric}".encode()).hexdigest()


#: Powers of 31 modulo 2^64, falling to 1: as many as bytes are hashed at once.
POWERS = np.cumprod(np.r_[np.uint64(1), np.full((1 << 16) - 1, 31, np.uint64)], dtype=np.uint64)[::-1]


def poly31(data: bytes) -> int:
    """The 31-polynomial hash modulo 2^64."""
    h = 0
    for i in range(0, len(data), len(POWERS)):
        part = np.frombuffer(data[i : i + len(POWERS)], np.uint8).astype(np.uint64)
        h = (h * pow(31, len(part), MASK + 1) + int((part * POWERS[-len(part) :]).sum(dtype=np.uint64))) & MASK
    return h


def mulberry32(seed: int):
    """Uniform numbers in [0, 1) from a 32-bit state (a public-domain generator)."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw
