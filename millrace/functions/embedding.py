"""Embedding back ends for the Arrow-batched embedder: padding and pooling, batching, retries with backoff.

An embedder is any object with ``dims`` and ``embed_batch(texts) -> vectors`` in order; ``vectors.embedder`` makes
it a UDF. Network calls go through an injected ``post`` function.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime

import numpy as np

from millrace.functions.vectors import mean_pool, mock_vector

# The most texts in one request, by provider, and vector sizes.
BATCHES = {"gemini": 100, "ollama": 100, "openai": 2048, "openrouter": 2048}
DIMS = {"onnx": 384, "ollama": 768, "openai": 1536}
MAX_TOKENS = 512
RETRIED = (429, 500, 503)


class Refused(Exception):
    """A response that may be asked for again: its status and Retry-After header."""

    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def wait_seconds(attempt: int, base: float = 1.0, most: float = 60.0, factor: Callable[[], float] = random.random) -> float:
    """Exponential backoff with full jitter."""
    return min(most, base * 2**attempt) * factor()


def retry_after(header: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header, which is a number or a date; None if it is neither."""
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def with_retries(call: Callable[[], object], attempts: int = 5, floor: float = 30.0, sleep: Callable[[float], None] = time.sleep, factor: Callable[[], float] = random.random):
    """Call until it succeeds; statuses 429, 500 and 503 are tried again. 429 waits as its header says, else ``floor`` at least."""
    for attempt in range(attempts):
        try:
            return call()
        except Refused as e:
            if e.status not in RETRIED or attempt == attempts - 1:
                raise
            pause = wait_seconds(attempt, factor=factor)
            if e.status == 429:
                asked = retry_after(e.retry_after)
                pause = max(pause, floor) if asked is None else asked
            sleep(pause)


class MockEmbedder:
    def __init__(self, dims: int = DIMS["onnx"]):
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [mock_vector(t, self.dims) for t in texts]


class RemoteEmbedder:
    """Sends batches of at most a provider's size; ``post(texts)`` gives (index, vector) pairs in any order."""

    def __init__(self, provider: str, post: Callable[[list[str]], list[tuple[int, list[float]]]], dims: int | None = None, **retry):
        self.size, self.post, self.retry = BATCHES[provider], post, retry
        self.dims = dims or DIMS.get(provider) or len(self.embed_batch(["dimension probe"])[0])

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), self.size):
            part = texts[i : i + self.size]
            got = with_retries(lambda part=part: self.post(part), **self.retry)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} vectors for {len(part)} texts")
            out += [v for _, v in sorted(got, key=lambda x: x[0])]
        return out


def padded(token_ids: list[list[int]], most: int = MAX_TOKENS, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a batch: each cut at ``most`` tokens and padded to the longest."""
    cut = [t[:most] for t in token_ids]
    width = max(map(len, cut), default=0)
    ids, mask = np.full((len(cut), width), pad, np.int64), np.zeros((len(cut), width), np.int64)
    for r, t in enumerate(cut):
        ids[r, : len(t)], mask[r, : len(t)] = t, 1
    return ids, mask


class LocalEmbedder:
    """A transformer: ``tokenize(text)`` gives ids, ``forward(ids, mask)`` token states; pooled and scaled to unit length."""

    def __init__(self, tokenize: Callable[[str], list[int]], forward: Callable[[np.ndarray, np.ndarray], np.ndarray], dims: int = DIMS["onnx"], batch: int = 64):
        self.tokenize, self.forward, self.dims, self.batch = tokenize, forward, dims, batch

    @classmethod
    def onnx(cls, model: str, tokenizer: str, **options) -> LocalEmbedder:
        """From model and tokenizer files, where onnxruntime and tokenizers are installed."""
        import onnxruntime
        from tokenizers import Tokenizer

        session, t = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer)
        names = {i.name for i in session.get_inputs()}

        def forward(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in feeds.items() if k in names})[0]

        return cls(lambda text: t.encode(text).ids, forward, **options)

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), self.batch):
            ids, mask = padded([self.tokenize(t) for t in texts[i : i + self.batch]])
            out += list(mean_pool(self.forward(ids, mask), mask))
        return out
