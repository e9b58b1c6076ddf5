"""Language identification with error-correcting output codes.

Every language gets a codeword: its column in the exhaustive code of 2^(k-1) - 1 bits while k is small, else
pseudo-random bits. One linear classifier of hashed character n-grams (1 to 3 characters) predicts each bit,
trained by logistic regression on a bounded sample of labelled documents. A document's bit margins are
decoded to the language whose codeword has the least summed logistic loss; each bit weighs as much as its
training accuracy exceeds chance. The score is the softmax of the negative losses, and a document is flagged
ambiguous where the two best differ by less than ``MARGIN``.

Null texts and texts without a letter are ``und`` with score 0. Texts are taken whole. Rows whose key is null
are scored but not learned from. Without any labelled row every text is ``und``. Repeated rows are scored as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import remainder
from millrace.llm.textvec import fresh, mix, parts_of, slices, text_buffers, trim

#: Hash buckets of the n-grams, and the largest sample of labelled rows that the classifiers are fitted on.
BUCKETS, SAMPLE = 1 << 14, 2000
#: Languages above this number get random codewords of this many bits.
EXHAUSTIVE, BITS = 5, 31
EPOCHS, RATE, SEED = 25, 4.0, 7
#: Rows that a worker judges and gives back at once.
ROWS = 2000
#: Score difference below which a decoding is ambiguous.
MARGIN = 0.1

_LETTER = np.zeros(0x110000, bool)
_FOLD = np.arange(0x110000, dtype=np.uint32)


def _tables() -> None:
    if not _LETTER.any():
        for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
            if c.isalpha():
                _LETTER[ord(c)] = True
                low = c.lower()
                if len(low) == 1:
                    _FOLD[ord(c)] = ord(low)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of each character's 1- to 3-gram, the offsets of rows in characters, and the rows' letters.

    Letters are lower-cased and anything else becomes one blank, so n-grams see word edges.
    """
    _tables()
    chars = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
    letter = _LETTER[chars]
    code = np.where(letter, _FOLD[chars], np.uint32(32)).astype(np.uint64)
    n = len(code)
    # a row's end stands as a blank, so no n-gram spans two rows
    before, second = np.full(n, 32, np.uint64), np.full(n, 32, np.uint64)
    before[1:], second[2:] = code[:-1], code[:-2]
    first = starts[:-1][starts[:-1] < n]
    before[first] = 32
    second[first] = 32
    second[(first + 1)[first + 1 < n]] = 32
    blank = np.uint64(32)
    keep = (code != blank) | (before != blank)
    two = before << np.uint64(21) | code
    grams = [mix(code + np.uint64(1 << 63)), mix(two + np.uint64(1 << 62)), mix(second << np.uint64(42) | two)]
    out = [np.where(keep, g % np.uint64(BUCKETS - 1), np.uint64(BUCKETS - 1)).astype(np.int64) for g in grams]
    return out, starts, _reduce(letter, starts).astype(np.int64)


def _reduce(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows' values; empty rows give 0."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[starts[1:]] - total[starts[:-1]]


def codewords(k: int) -> np.ndarray:
    """A (k, bits) matrix of -1 and 1 with distinct rows; each bit splits the languages."""
    if k < 2:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        bits = [b for b in itertools.product((0, 1), repeat=k) if b[0] == 1 and 0 in b]
        return np.array(bits).T * 2.0 - 1
    rng = np.random.default_rng(SEED)
    best, apart = None, -1
    for _ in range(200):
        m = rng.integers(0, 2, (k, max(BITS, 2 * int(np.ceil(np.log2(k))) + 16)))
        m = m[:, (m.min(0) == 0) & (m.max(0) == 1)]
        d = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if d > apart:
            best, apart = m, d
    return best * 2.0 - 1


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (bits, BUCKETS)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit margins of each row and its number of letters."""
        n = len(offsets) - 1
        out, letters = np.zeros((n, len(self.bias))), np.zeros(n, np.int64)
        for i, j in slices(offsets, 1 << 20):
            grams, starts, letters[i:j] = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.maximum(_reduce((grams[0] != BUCKETS - 1).astype(np.float32), starts), 1.0)
            for b, w in enumerate(self.weights):
                total = w[grams[0]]
                total += w[grams[1]]
                total += w[grams[2]]
                out[i:j, b] = _reduce(total, starts) / size + self.bias[b]
        return out, letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score, and whether the runner-up is near."""
        loss = np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(1) for row in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ordered = np.sort(p, 1)
        gap = ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)
        return best, p[np.arange(len(p)), best], gap < MARGIN


def _histograms(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for i, j in slices(offsets, 1 << 20):
        grams, starts, _ = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a, z in itertools.pairwise(starts):
            h = np.concatenate([g[a:z] for g in grams])
            h = h[h != BUCKETS - 1]
            keys, counts = np.unique(h, return_counts=True)
            out.append((keys.astype(np.int32), (counts / max(1.0, len(h) / 3)).astype(np.float32)))
    return out


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows each label may give so that all together give ``most``; what rare labels leave goes to the others."""
    out, left = {}, most
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(0, left // (len(counts) - i)))
        left -= out[label]
    return out


def sample(docs: DataFrame, usable: Column, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows, about as many of each label; the bound is a parameter of the fit.

    A label gives the rows whose ids and texts have the smallest hashes. A bar on the hash, by the label's count, lets
    through half as many again as are wanted, so that what is ranked does not grow with the table.
    """
    rows = docs.filter(usable & F.col("label").isNotNull() & F.col("text").isNotNull()).withColumn("_mark", F.xxhash64("doc_id", "text", F.lit(SEED)))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    wanted = {k: v for k, v in shares(counts, most).items() if v}
    if not wanted:
        return rows.drop("_mark").limit(0)
    bars = {k: -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * (1.5 * v + 100) / counts[k])) for k, v in wanted.items()}
    of = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("label")]
    near = rows.filter(F.col("label").isin(list(wanted)))
    there = {r.label for r in near.filter(F.col("_mark") <= of(bars)).groupBy("label").count().collect()}
    bars |= dict.fromkeys(set(bars) - there, (1 << 63) - 1)  # rows that are all alike can miss the bar together
    place = F.row_number().over(W.partitionBy("label").orderBy("_mark", "doc_id"))
    ranked = near.filter(F.col("_mark") <= of(bars)).withColumn("_place", place)
    return ranked.filter(F.col("_place") <= of(wanted)).drop("_mark", "_place")


def fit(rows: DataFrame) -> Model:
    """Learn from (text, label) rows; their number is bounded by ``sample``. Features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _histograms(*text_buffers(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([k.tobytes() for k, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["label", "keys", "counts"])

    got = rows.select(F.col("label").cast("string"), "text").mapInArrow(run, "label string, keys binary, counts binary").toArrow()
    labels = got["label"].to_pylist()
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((1, BUCKETS), np.float32), np.zeros(1), np.ones(1))
    sizes = [len(k.as_py()) // 4 for k in got["keys"]]
    keys = np.frombuffer(b"".join(got["keys"].to_pylist()), np.int32).astype(np.int64)
    counts = np.frombuffer(b"".join(got["counts"].to_pylist()), np.float32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    target = code[[languages.index(x) for x in labels]]  # (rows, bits)
    share = np.bincount([languages.index(x) for x in labels], minlength=len(languages))
    each = (1 / share[[languages.index(x) for x in labels]]) / len(languages)  # languages count alike
    weights, bias = np.zeros((code.shape[1], BUCKETS)), np.zeros(code.shape[1])
    scale = np.zeros((code.shape[1], BUCKETS)) + 1e-8
    trust = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        for _ in range(EPOCHS):  # full-batch steps, each coordinate scaled by its gradients so far
            z = np.bincount(row, counts * weights[b][keys], len(sizes)) + bias[b]
            g = -target[:, b] * each / (1 + np.exp(np.clip(target[:, b] * z, -50, 50)))
            grad = np.bincount(keys, counts * g[row], BUCKETS) + 1e-6 * weights[b]
            scale[b] += grad**2
            weights[b] -= RATE * grad / np.sqrt(scale[b])
            bias[b] -= 0.1 * np.sign(g.sum()) * abs(g.sum())
        right = float((each * ((z > 0) == (target[:, b] > 0))).sum())
        trust[b] = max(2 * right - 1, 0.05)
    return Model(languages, code, weights.astype(np.float32), bias, trust)


def fit_documents(docs: DataFrame) -> Model:
    """Learn from text and lang of documents; those whose crc32 of the id leaves 2 modulo 4 are held out."""
    rows = docs.select("doc_id", "text", F.col("lang").alias("label"))
    return fit(sample(rows, remainder(F.col("doc_id"), 4) != 2))


ADDED = ("lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, model: Model, keep_text: bool = True, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with three columns ``added`` (they replace columns so named); the text is read whole, others pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x bits
    schema = docs.schema
    names = [n for n in docs.columns if n not in (*added, "" if keep_text else "text")]
    ddl = ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names) + ", {} string, {} double, {} boolean".format(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        m = shared.value
        for batch in parts_of(batches, ROWS):
            margins, letters = m.margins(*text_buffers(batch["text"]))
            if m.languages:
                best, score, near = m.decode(margins)
            else:
                best, score, near, letters = np.zeros(len(letters), int), np.zeros(len(letters)), np.ones(len(letters), bool), letters * 0
            pred = pa.array([m.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], pa.string())
            none = letters == 0
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pred, pa.array(np.where(none, 0.0, score)), pa.array(near | none)], [*names, *added])
            del batch
            trim()

    return docs.select(*(f"`{n}`" for n in dict.fromkeys([*names, "text"]))).mapInArrow(run, ddl)
