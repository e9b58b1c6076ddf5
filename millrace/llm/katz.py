"""Katz backoff language model over words, of order ``ORDER``, counted and evaluated in hash buckets.

Tokens are runs without white space (A-Z lower-cased) and one end token per text; the end token also stands for what
is before a text, so each token has a history of every length. With c a count in the training tokens, h a history
and h' the same without its first word:

    p(w | h) = d(c(h,w)) c(h,w) / T(h)   if (h, w) was seen, else  a(h) p(w | h')
    p(w)     = d(c(w)) c(w) / N          if w was seen,      else  the mass left, for all unseen words

d are the order's Good-Turing discounts of counts up to ``K``; larger counts are left alone. T(h) is c(h); only where
none of the counts after h is discounted it is c(h) + 1, so that every history keeps mass for backoff. a(h) = (1 - sum
of seen p(w|h)) / (1 - sum of those p(w|h')), so each history sums to one over the seen words and the unseen class. A
history that was not seen passes its token on: p(w | h) = p(w | h').

Work moves as compressed arrays instead of rows. Documents become batches of token numbers (the state, a table in
shared storage). Level 1 sends each batch's distinct words to word buckets, which total the training counts and
answer. Level n sends each batch's distinct n-grams, grouped by history, to buckets of their history, with what the
level below found out about them; a bucket totals the counts, keeps them as a part of the model, and answers each
batch with its n-grams' counts and, for histories with unseen words, with what their weight is made of. The answers
become part of the state, and the next level starts. The last answers end in the documents' sums, by the recursion
above. A level is done in ``PASSES`` shares of its buckets, one after the other, which bounds what is on disk at once.

A key takes one entry per batch however frequent it is. A history with many tokens is spread over all buckets by its
next word, and its sums are added up by Spark. Each level's counts (kind = model), counts of counts (stats) and the
words' hashes are tables partitioned by kind. Weights follow from counts and are not stored: they would take as much
again as the input.

Null text counts as empty: one end token. Rows with a null key are scored but not learned from. Repeated rows
count as often as they occur. With nothing to learn from, every token is unseen and base and model agree.
Texts are taken whole; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, partitions, release
from millrace.llm.textvec import fresh, lowered, mix, slices, spaced, span_hashes, text_buffers, trim

#: Words in the longest n-gram. Counts up to K are discounted. Shares in which a level is done.
ORDER, K, PASSES = 3, 5, 2
#: Bytes of text in a batch. Word entries and tokens that a bucket may take.
BATCH, WORDS, PAIRS = 12 << 20, 1_500_000, 1_000_000
#: A history is spread over buckets from this many tokens, and from this share of all tokens on.
HOT, SHARE = 1 << 20, 1e-4
END = np.uint64(0xE0D0_E0D0_E0D0_E0D1)

STATE = "batch_id long, nulls binary, docs binary, train binary, sizes binary, tokens binary, end long, words binary, levels binary, n_tokens long, n_train long, n_words long"
PARTS = "kind string, bucket long, batch_id long, data binary"
COUNTS = "kind string, bucket long, batch_id long, data binary, history array<long>, sums array<double>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of like weight lie together."""
    import zstandard

    head, body = [np.array([len(arrays)], "<u4").tobytes()], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str[1:].encode() + np.array([len(a)], "<u8").tobytes())
        body.append((a.view(np.uint8).reshape(-1, a.itemsize).T if len(a) else a.view(np.uint8)).tobytes())
    return zstandard.ZstdCompressor(level=5).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    out, at = [], 4 + 10 * n
    for i in range(n):
        kind, size = np.dtype("<" + raw[4 + 10 * i : 6 + 10 * i].decode()), int(np.frombuffer(raw, "<u8", 1, 6 + 10 * i)[0])
        cells = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(cells.reshape(kind.itemsize, size).T).view(kind).ravel() if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The array in the least unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def good_turing(seen: list[int], k: int = K) -> np.ndarray:
    """Discounts d[0..k] from counts of counts seen[1..k+1]; d[0] is unused. Too sparse counts shorten k.

    Those below one are d[1] to d[t] for some t, so a count is discounted if it is at most t.
    """
    d = np.ones(K + 1)
    for top in range(k, 0, -1):
        n = seen[: top + 2]
        if min(n[1 : top + 2]) <= 0:
            continue
        rest = (top + 1) * n[top + 1] / n[1]
        if rest >= 1:
            continue
        r = np.arange(1, top + 1)
        got = ((r + 1) * np.array(n[2 : top + 2]) / (r * np.array(n[1 : top + 1])) - rest) / (1 - rest)
        if (got > 0).all() and (got < 1).all():
            d[1 : top + 1] = got
            return d
    d[1:] = 0.5 if seen[1] else 1.0
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


def batches(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, train, text) as batches of token numbers with each batch's distinct words and their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fresh()
        part, made = TaskContext.get().partitionId(), 0
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        names, types = zip(*(x.split() for x in STATE.split(", ")), strict=True)
        for batch in parts:
            raw, offsets = text_buffers(batch["text"])
            keys = batch["doc_id"].to_pylist()
            null = np.array([x is None for x in keys], bool)
            ids = np.array([0 if x is None else x for x in keys], np.int64)
            train = np.array(batch["train"].to_pylist(), bool)
            for i, j in slices(offsets, BATCH):
                low = lowered(raw[offsets[i] : offsets[j]])
                starts, ends, rows = spaced(low, offsets[i : j + 1] - offsets[i])
                hashes = span_hashes(low, starts, ends)
                size = np.bincount(rows, minlength=j - i) + 1
                last = np.cumsum(size) - 1
                every = np.empty(int(size.sum()), np.uint64)
                inner = np.ones(len(every), bool)
                inner[last] = False
                every[inner], every[last] = hashes, END
                words, tokens = np.unique(every, return_inverse=True)
                learned = np.repeat(train[i:j], size)
                counts = np.bincount(tokens[learned], minlength=len(words))
                row = ((part << 32) + made, pack(null[i:j].astype("u1")), pack(ids[i:j]), pack(train[i:j].astype("u1")), pack(small(size)), pack(small(tokens)), int(tokens[-1]), pack(words, small(counts)), b"", len(tokens), int(learned.sum()), len(words))
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(row, types, strict=True)], list(names))
                trim()

    return docs.select("doc_id", "train", "text").mapInArrow(run, STATE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "batch_id", "data"]).astype({"bucket": "int64", "batch_id": "int64"})


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, positions) for each bucket that occurs, positions in their order."""
    order = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    for a, z in zip(edges, np.r_[edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:z]


def word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    return (words % np.uint64(n)).astype(np.int64)


def count_words(made: DataFrame, n: int) -> DataFrame:
    """Word buckets: kind ``reply`` (numbers and total counts for a batch's words), ``words`` and ``stats``."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                words, counts = unpack(row.words)
                yield _frame([("ask", b, row.batch_id, pack(words[at], counts[at])) for b, at in by_bucket(word_bucket(words, n), n)])

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b, got = int(key[0]), [unpack(x) for x in pdf["data"]]
        words, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([g[1] for g in got]).astype(float), len(words)).astype(np.int64)
        # frequent words get small numbers, which pack better
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        number = rank * n + b
        rows, at = [], 0
        for batch, g in zip(pdf["batch_id"], got, strict=True):
            mine = back[at : at + len(g[0])]
            rows.append(("reply", b, batch, pack(small(number[mine]), small(counts[mine]))))
            at += len(g[0])
        rows.append(("stats", b, -1, pack(counted(counts))))
        rows.append(("words", b, -1, pack(words[counts > 0], small(number[counts > 0]), small(counts[counts > 0]))))
        return _frame(rows)

    asked = made.select("batch_id", "words").mapInPandas(ask, PARTS)
    return asked.repartition(n, "bucket").groupBy("bucket").applyInPandas(total, PARTS)


def counted(counts: np.ndarray) -> np.ndarray:
    """Counts of counts 0 to K + 1 and above, and the total."""
    return np.r_[np.bincount(np.minimum(counts, K + 2), minlength=K + 3), counts.sum()].astype("<i8")


def summed_stats(table: DataFrame) -> np.ndarray:
    """Counts of counts and the total over all buckets, summed by Spark."""
    names = [f"s{i}" for i in range(K + 4)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([unpack(x)[0] for x in pdf["data"]], columns=names, dtype="int64")

    got = table.filter("kind = 'stats'").select("data").mapInPandas(run, ", ".join(f"{x} long" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
    return np.array([x or 0 for x in got], np.int64)


def unseen_mass(stats: np.ndarray, total: int, d: np.ndarray) -> float:
    """What the discounted unigrams leave."""
    return 1 - sum(float(d[r]) * r * int(stats[r]) for r in range(1, K + 1)) / total - (total - sum(r * int(stats[r]) for r in range(1, K + 1))) / total if total else 1.0


class Model:
    """What is known of the model as a whole: token total, types, discounts per order, mass of unseen words."""

    def __init__(self, stats: np.ndarray):
        self.total, self.types = int(stats[-1]), int(stats[1 : K + 3].sum())
        self.d = [None, good_turing([int(x) for x in stats[: K + 2]])]
        self.spare = unseen_mass(stats, self.total, self.d[1])
        if self.total and self.spare <= 0:  # no word has a small count
            self.d[1] = np.r_[1.0, np.full(K, 1 - 1 / (self.total + self.types + 1))]
            self.spare = unseen_mass(stats, self.total, self.d[1])
        if self.total and self.spare <= 0:
            self.spare = 1 / (self.total + self.types + 1)
        self.hot = max(HOT, int(self.total * SHARE))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d[1]) / max(self.total, 1), self.spare)

    def top(self, n: int) -> int:
        """The largest count that order n discounts."""
        return int((self.d[n][1:] < 1).sum())


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ascending values, a position of each, each position's rank) of non-negative integers."""
    bits = max(1, (len(values) - 1).bit_length())
    if len(values) and int(values.max()) < 1 << (63 - bits):
        code = np.sort((values << bits) | np.arange(len(values)))
        pos, value = code & ((1 << bits) - 1), code >> bits
    else:
        pos = np.argsort(values, kind="stable")
        value = values[pos]
    new = changes(value)
    rank = np.empty(len(values), np.int32)
    rank[pos] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return value[new], pos[new], rank


class Level:
    """The distinct n-grams of a batch in order of history and word: entries; runs are those with one history."""

    def __init__(self, batch: Batch, n: int):
        below = batch.grams[n - 1]
        history = np.zeros(len(batch.tokens), np.int64)  # 0: nothing before the text's first token
        history[1:] = below[:-1] + 1
        history[batch.first] = 0
        value, self.pos, batch.grams[n] = grouped(history * len(batch.number) + batch.tokens)
        of = value // len(batch.number)
        new = changes(of)
        self.run, self.head = np.cumsum(new, dtype=np.int32) - np.int32(1), np.flatnonzero(new)
        self.suffix = below[self.pos]
        # a history's total is its own count as a gram; that of no words is the count of the end token
        self.total = np.where(of[new] > 0, batch.counts[n - 1][np.maximum(of[new] - 1, 0)], batch.count[batch.end])
        self.word = batch.tokens[self.pos]
        self.before = [batch.word_before(self.pos[self.head], k) for k in range(n - 1, 0, -1)]
        self.n, self.hot = n, self.total >= batch.model.hot

    def buckets(self, batch: Batch, n_buckets: int) -> np.ndarray:
        """The bucket of each entry: of its history, for hot ones also of its word."""
        spot = np.zeros(len(self.head), np.uint64)
        for w in self.before:
            spot = mix(spot + batch.number[w].astype(np.uint64))
        spot = spot[self.run]
        spot = np.where(self.hot[self.run], mix(spot ^ mix(batch.number[self.word].astype(np.uint64))), spot)
        return (spot % np.uint64(n_buckets)).astype(np.int64)


class Batch:
    """A batch's tokens, numbers and counts, with the levels that are known so far."""

    def __init__(self, row, model: Model):
        self.model, self.end = model, int(row.end)
        self.null, self.ids, self.train, size, tokens = (unpack(x)[0] for x in (row.nulls, row.docs, row.train, row.sizes, row.tokens))
        self.size, self.tokens = size.astype(np.int64), tokens.astype(np.int32)
        self.first = np.cumsum(self.size) - self.size
        self.start = np.repeat(self.first.astype(np.int32), self.size)
        self.number, self.count = (x.astype(np.int64) for x in unpack(row.words))
        self.grams: dict[int, np.ndarray] = {1: self.tokens}
        self.counts: dict[int, np.ndarray] = {1: self.count}
        self.levels: dict[int, Level] = {}
        #: Per level, by run: the total by which its counts are divided, and the logarithm of its weight.
        self.divisor: dict[int, np.ndarray] = {}
        self.weight: dict[int, np.ndarray] = {}
        known = unpack(row.levels) if row.levels else []
        for i in range(0, len(known), 3):
            self.add(i // 3 + 2, *known[i : i + 3])

    def word_before(self, pos: np.ndarray, k: int) -> np.ndarray:
        return np.where(pos - k >= self.start[pos], self.tokens[np.maximum(pos - k, 0)], self.end)

    def level(self, n: int) -> Level:
        if n not in self.levels:
            self.levels[n] = Level(self, n)
        return self.levels[n]

    def add(self, n: int, counts: np.ndarray, plus: np.ndarray, weight: np.ndarray) -> None:
        level = self.level(n)
        self.counts[n], self.weight[n] = counts.astype(np.int64), weight
        self.divisor[n] = level.total + plus

    def logs(self, n: int) -> np.ndarray:
        """log10 of the probability of each distinct n-gram's last word, by recursion."""
        if n == 1:
            return np.log10(self.model.unigram(self.count))
        level, c = self.levels[n], self.counts[n]
        seen = discounted(c, self.model.d[n]) / np.maximum(self.divisor[n][level.run], 1)
        return np.where(c > 0, np.log10(np.where(c > 0, seen, 1.0)), self.weight[n][level.run] + self.logs(n - 1)[level.suffix])


def ask_grams(model: Model, n: int, n_buckets: int, share: int):
    """Map a state to what its batches ask of the buckets of this share."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                batch = Batch(row, model)
                level = batch.level(n)
                learned = np.bincount(batch.grams[n][np.repeat(batch.train, batch.size) > 0], minlength=len(level.pos))
                below = batch.counts[n - 1][level.suffix]
                divisor = batch.divisor[n - 1][batch.levels[n - 1].run[level.suffix[level.head]]] if n > 2 else np.zeros(len(level.head), np.int64)
                rows = []
                for b, at in by_bucket(level.buckets(batch, n_buckets), n_buckets):
                    if b % PASSES == share:
                        new = np.flatnonzero(changes(level.run[at]))
                        runs, many = level.run[at[new]], np.diff(np.r_[new, len(at)])
                        rows.append(("ask", b, row.batch_id, pack(small(many), small(divisor[runs]), level.hot[runs].astype("u1"), small(batch.number[level.word[at]]), small(below[at]), small(learned[at]), *(small(batch.number[w[runs]]) for w in level.before))))
                del batch, level
                yield _frame(rows)
        trim()

    return run


def count_grams(model: Model, n: int):
    """A bucket's counts: kinds ``reply`` for each batch, ``model``, ``stats`` and ``hot``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b, got = int(key[0]), [unpack(x) for x in pdf["data"]]
        join = lambda k: np.concatenate([g[k] for g in got]).astype(np.int64)
        many, divisor, hot, w, below, learned = (join(k) for k in range(6))
        words = [join(k) for k in range(6, 5 + n)]
        # histories of all runs, told apart by their words
        order = np.lexsort(words[::-1])
        new = np.r_[True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in words])]
        history = np.empty(len(order), np.int64)
        history[order] = np.cumsum(new) - 1
        one = order[new]  # a run of each history
        run_of = np.repeat(np.arange(len(many)), many)
        entry = history[run_of]
        order = np.lexsort((w, entry)) if w.max() >= 1 << 40 else np.argsort((entry << 40) | w)
        new = np.r_[True, (np.diff(entry[order]) != 0) | (np.diff(w[order]) != 0)]
        head = np.flatnonzero(new)
        count = np.add.reduceat(learned[order], head)
        c = np.empty(len(w), np.int64)
        c[order] = count[np.cumsum(new) - 1]
        of, lower = entry[order][head], below[order][head]
        seen = count > 0
        p = model.unigram(lower) if n == 2 else discounted(lower, model.d[n - 1]) / np.maximum(divisor[one[of]], 1)
        size = len(one)
        least = np.full(size, K + 1)
        np.minimum.at(least, of[seen], np.minimum(count[seen], K + 1))
        sums = np.stack([*(np.bincount(of[count == r], minlength=size) for r in range(1, K + 1)), np.bincount(of[seen], p[seen], size)], 1)
        rows = [("stats", b, -1, pack(counted(count)), None, None)]
        at_seen = of[seen]
        kept, runs = np.unique(at_seen, return_counts=True)
        rows.append(("model", b, -1, pack(small(runs), small(w[order][head][seen]), small(count[seen]), *(small(x[one[kept]]) for x in words)), None, None))
        for h in np.flatnonzero(hot[one] > 0):
            rows.append(("hot", b, -1, None, [int(x[one[h]]) for x in words], [*sums[h], float(least[h])]))
        missed = np.zeros(len(many), bool)
        missed[run_of[c == 0]] = True
        missed &= (np.bincount(of[seen], minlength=size) > 0)[history] & (hot == 0)
        r = e = 0
        for batch, g in zip(pdf["batch_id"], got, strict=True):
            rs, es = slice(r, r + len(g[0])), slice(e, e + len(g[3]))
            r, e = rs.stop, es.stop
            asked = sums[history[rs][missed[rs]]]
            rows.append(("reply", b, batch, pack(small(c[es]), least[history[rs]].astype("u1"), missed[rs].astype("u1"), *(small(asked[:, x].astype(np.int64)) for x in range(K)), asked[:, K]), None, None))
        trim()
        return pd.DataFrame(rows, columns=["kind", "bucket", "batch_id", "data", "history", "sums"]).astype({"bucket": "int64", "batch_id": "int64"})

    return run


def weights(sums: np.ndarray, total: np.ndarray, plus: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of backoff weights; sums: how many words have each count 1..K, and their mass in the order below."""
    r = np.arange(1, K + 1)
    kept = (sums[:, :K] * r * d[1:]).sum(1) + total - (sums[:, :K] * r).sum(1)
    return np.log10((1 - kept / (total + plus)) / np.maximum(1 - sums[:, K], 1e-300))


def answered(batch: Batch, replies: pd.DataFrame, n: int, n_buckets: int, hot: dict[tuple, list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts by entry, what is added to totals by run, weights by run) of a level from its replies."""
    level, d = batch.level(n), batch.model.d[n]
    counts, least = np.zeros(len(level.pos), np.int64), np.full(len(level.head), K + 1)
    sums, missed = np.zeros((len(level.head), K + 1)), np.zeros(len(level.head), bool)
    reply = {int(r.bucket): r.data for r in replies.itertuples()}
    for b, at in by_bucket(level.buckets(batch, n_buckets), n_buckets):
        c, low, miss, *rest = unpack(reply[b])
        counts[at] = c
        runs = level.run[at]
        runs = runs[changes(runs)]
        least[runs] = low
        missed[runs[miss > 0]] = True
        sums[runs[miss > 0]] = np.stack([x.astype(float) for x in rest], 1)
    for r in np.flatnonzero(level.hot):
        got = hot[tuple(int(batch.number[w[r]]) for w in level.before)]
        sums[r], least[r], missed[r] = got[: K + 1], got[K + 1], True
    plus = ((level.total > 0) & (least > batch.model.top(n))).astype(np.int64)
    weight = np.zeros(len(level.head))
    missed &= level.total > 0
    weight[missed] = weights(sums[missed], level.total[missed], plus[missed], d)
    return counts, plus, weight


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for (doc_id, train, text) rows."""
    spark = docs.sparkSession
    width = partitions(spark)
    state = materialize(batches(docs), "batches", compression="none")
    made = state.agg(F.sum("n_tokens"), F.sum("n_words"), F.count(F.lit(1))).first()
    n_words, n_buckets, n_batches = max(width, -(-(made[1] or 0) // WORDS)), max(width, -(-(made[0] or 0) // PAIRS)), max(width, made[2])
    replies = materialize(count_words(state, n_words), "words", by=("kind",), arrow_rows=1, compression="none")
    model = Model(summed_stats(replies))

    def number(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        [words] = [unpack(x)[0] for x in left["words"]]
        out, reply = np.zeros((2, len(words)), np.int64), {int(r.bucket): r.data for r in right.itertuples()}
        for b, at in by_bucket(word_bucket(words, n_words), n_words):
            out[:, at] = unpack(reply[b])
        return left.assign(words=[pack(small(out[0]), small(out[1]))])

    def with_replies(step, schema: str) -> DataFrame:
        """Each batch of the state with its replies."""
        asked = replies.filter("kind = 'reply'").select("batch_id", "bucket", "data")
        sides = (x.repartition(n_batches, "batch_id").groupBy("batch_id") for x in (state, asked))
        left, right = sides
        return left.cogroup(right).applyInPandas(step, schema)

    state, old = materialize(with_replies(number, STATE), "batches", compression="none"), state
    release(old)
    release(replies, part="kind=reply")
    for n in range(2, ORDER + 1):
        shares = []
        for share in range(PASSES):
            asked = state.mapInPandas(ask_grams(model, n, n_buckets, share), PARTS)
            counts = asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(count_grams(model, n), COUNTS)
            shares.append(materialize(counts, f"katz-{n}", by=("kind",), arrow_rows=1, compression="none"))
        replies = shares[0]
        for more in shares[1:]:
            replies = replies.unionByName(more)
        model.d.append(good_turing([int(x) for x in summed_stats(replies)[: K + 2]]))
        # at most 1 / SHARE histories are hot
        parts = replies.filter("kind = 'hot'").groupBy("history").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(K + 1)), F.min(F.col("sums")[K + 1]).alias("least"))
        hot = spark.sparkContext.broadcast({tuple(r.history): list(r)[1:] for r in parts.collect()})

        def keep(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            [row] = left.itertuples()
            counts, plus, weight = answered(Batch(row, model), right, n, n_buckets, hot.value)
            before = unpack(row.levels) if row.levels else []
            trim()
            return left.assign(levels=[pack(*before, small(counts), small(plus), weight)])

        def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            [row] = left.itertuples()
            batch = Batch(row, model)
            batch.add(n, *answered(batch, right, n, n_buckets, hot.value))
            c = batch.count[batch.tokens]
            total = lambda x: np.add.reduceat(x, batch.first)
            base = total(np.log10((c + 1) / (model.total + model.types + 1)))
            out = {"doc_id": batch.ids, "no_id": batch.null > 0, "n_tokens": batch.size, "n_known": total((c > 0).astype(np.int64)), "train_tokens": np.full(len(batch.ids), model.total), "base_score": base, "score": total(batch.logs(n)[batch.grams[n]])}
            trim()
            return pd.DataFrame(out)

        if n < ORDER:
            state, old = materialize(with_replies(keep, STATE), "batches", compression="none"), state
            release(old)
            release(*shares, part="kind=reply")
    scored = with_replies(finish, "doc_id long, no_id boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
