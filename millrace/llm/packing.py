"""Best-fit packing by the sum-of-squares rule.

Each document becomes its token ids and an end token; longer ones are cut at the capacity. A piece is
put where the sum over gaps g of (open sequences with g tokens left) squared comes out smallest, which
keeps the gaps varied so that later pieces find one that fits. Pieces are dealt at random to groups of
bounded size, equal ones too; a group is packed in one task, longest pieces first, and leaves few open sequences.

Null text counts as empty (one end token). Repeated rows and repeated or null ids are packed as often as
they occur. Equal choices go to the smallest gap; a new sequence counts as a gap of the whole capacity.
Very long texts are encoded whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.textvec import kept, slices, spaced, span_hashes, text_buffers, trim

CAPACITY, END = 4096, 1
#: Pieces of one group, packed by one task.
GROUP = 40_000
#: Entries of a worker's caches of words and of their pieces, which start afresh when full.
CACHED = 250_000

#: Bytes of text whose words are looked up together.
SLICE = 6 << 20

#: Rows of a batch that goes to Python.
ROWS = 2000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters whose splitting, case and normal form need no library: printable ASCII and precomposed Latin letters.
_PLAIN = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250)) if unicodedata.is_normalized("NFC", chr(c)) and c != 0xAD]


def _class(*kinds: str) -> str:
    return "".join(re.escape(c) for c in sorted({d for c in _PLAIN for d in (c, *c.lower())}) if unicodedata.category(c)[0] in kinds)


_UNUSUAL = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L', 'N')}]+")


#: The byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others follow from 256 on.
_SEEN = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SEEN))}


class WordEncoder:
    """Encodes texts with a word-level BPE. A slice's distinct words are looked up once; the rest is array work.

    ``rows`` equals the tokenizer's own output as little-endian 32-bit ids. Texts with characters whose case or
    normal form could reach over a word (``_UNUSUAL``), or with one of its added tokens, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # added tokens are found in the text before it is split, so a word that holds one leaves its text to the tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[int, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            # a piece is one word of the model, in its byte-level form, which for ASCII is itself
            form = piece if piece.isascii() else "".join(map(_BYTES.__getitem__, piece.encode()))
            got = self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(form)])
        return got

    def _word(self, word: str) -> bytes | None:
        """A word's ids; None if its text must be encoded whole."""
        if not word.isprintable() if word.isascii() else _UNUSUAL.search(word):
            return None
        for token in self.added:
            if token in word:
                return None
        if word.isalpha():  # one piece
            return self._piece(word.lower())
        return b"".join(map(self._piece, _SPLIT.findall(word.lower())))

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each row of UTF-8 texts."""
        starts, ends, of = spaced(raw, offsets)
        n = len(offsets) - 1
        if not len(starts):
            return [b""] * n
        keys, first, back = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        keys, known, data = keys.tolist(), self.words, raw.tobytes()
        if len(known) > CACHED:
            known.clear()
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        values = list(map(known.get, keys, itertools.repeat(b"")))
        for i in [i for i, v in enumerate(values) if v == b""]:
            a, z = starts[first[i]], ends[first[i]]
            values[i] = got = self._word(data[a:z].decode())
            if z - a < 64:
                known[keys[i]] = got
        odd = np.array([v is None for v in values])
        values = [v or b"" for v in values]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool, at = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        many = size[back]
        total = np.cumsum(many)
        ids = pool[np.arange(int(total[-1])) + np.repeat(at[back] - (total - many), many)].tobytes()
        edge = 4 * np.r_[0, np.cumsum(np.bincount(of, many, n).astype(np.int64))]
        out = [ids[a:z] for a, z in itertools.pairwise(edge.tolist())]
        for r in np.unique(of[odd[back]]).tolist():
            out[r] = self.whole(data[offsets[r] : offsets[r + 1]].decode())
        return out

    def ids(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.rows(raw, np.array([0, len(raw)]))[0]


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process, so that tasks which follow each other share its caches."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end token."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.asarray([END], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows, keys = [], batch["doc_id"].to_pylist()
            raw, offsets = text_buffers(batch["text"])
            for i, j in slices(offsets, SLICE):
                made = encoder.rows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows += [(key, *p) for key, ids in zip(keys[i:j], made, strict=True) for p in pieces_of(ids + end, capacity)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the order given."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences per gap; the last place stands for a new one
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        gaps = counts[size:]  # gap g is at g - size
        change = counts[: capacity + 1 - size] - gaps  # half the change of the sum, but for what is added below
        change[0] = -counts[size] if size else 0
        # N[g]^2 falls by 2N[g]-1 and N[g-size]^2 rises by 2N[g-size]+1; a full sequence is no longer open
        score = 2 * change + 2
        score[0] -= 1
        score[:-1][gaps[:-1] == 0] = np.iinfo(np.int64).max
        score[-1] = 2 * counts[capacity - size] + 1 if size < capacity else 0
        g = int(np.argmin(score)) + size
        if g == capacity:
            number, opened = opened, opened + 1
        else:
            number = stacks[g].pop()
            counts[g] -= 1
        sequence[i], offset[i] = number, capacity - g
        if g > size:
            counts[g - size] += 1
            stacks[g - size].append(number)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (any frame with a ``length`` of at most ``capacity``).

    A row's place decides its group, so that equal rows spread; pieces are a stored table, whose places stay.
    """
    if not hasattr(pieces, "_millrace_path"):
        pieces = materialize(pieces, "pieces")
    rows = pieces.count()
    groups = max(1, -(-rows // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *sorted(set(pdf.columns) - {"length", "_group"})], ascending=False, kind="stable")
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = int(pdf["_group"].iloc[0]) * (1 << 32) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns="_group")

    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.withColumn("_group", spread).groupBy("_group").applyInPandas(run, schema)


def default_tokenizer() -> str:
    """The path of the public tokenizer that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack documents: the columns of ``tokenize`` with sequence_id and offset."""
    return pack(materialize(tokenize(docs, tokenizer, capacity), "pieces", arrow_rows=ROWS), capacity)
