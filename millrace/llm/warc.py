"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles of bounded size, and each bundle
ends in a seek table (a skippable frame that lists the frames' compressed and raw sizes). An index maps a
record to its bundle, frame and offset in the frame, so one record is read by decompressing one frame.
Bundles are rows of a table (binary column), which any store that Spark writes can hold; ``export`` puts
them into plain .warc.zst files.

Null html is an empty payload. Of records with equal payloads (SHA-1 and length) the one with the largest
page_id is the response and others revisit it; a record with a null page_id is a response only if no record
of its payload has an id. Where the largest id occurs in repeated rows, all of those are responses.
Payloads below ``least`` bytes are never revisits. Very long payloads get a frame of their own. An empty
table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Raw bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME, BUNDLE = 256 << 10, 8 << 20
LEVEL = 3
#: The most repeated payloads (a digest, a length and an id each) that are sent to all tasks; tasks of one payload beyond that.
BROADCAST, SALTS = 100_000, 16
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLES = "bundle_id string, data binary, ids array<long>, frames array<int>, offsets array<long>, sizes array<long>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle_id string, frame int, frame_offset long, target_uri string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_record(page_id, url: str, kind: str, refers_to, sha: str, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its digest, length and the id it refers to."""
    body = payload if kind == "response" else b""
    clean = "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: memoryview | bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and the offset after the record that starts at ``at``."""
    raw = bytes(raw) if not isinstance(raw, bytes) else raw
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    return headers, raw[end + 4 : end + 4 + size], end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with each frame's compressed and raw size."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.unpack(f"<{2 * count}I", data[-9 - 8 * count : -9])
    out, at = [], 0
    for c, d in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, c, d))
        at += c
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    import zstandard

    at, size, raw = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(raw, 1))


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    return parse_record(read_frame(data, frame), offset)[:2]


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame: int, level: int):
        import zstandard

        self.zstd, self.most = zstandard.ZstdCompressor(level=level), frame
        self.open, self.raw, self.frames, self.index, self.data, self.name = [], 0, [], [], [], hashlib.sha1()

    def add(self, key, record: bytes) -> None:
        self.index.append((key, len(self.frames), self.raw, len(record)))
        self.open.append(record)
        self.raw += len(record)
        if self.raw >= self.most:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.name.update(packed)
            self.data.append(packed)
            self.frames.append((len(packed), self.raw))
            self.open, self.raw = [], 0

    @property
    def size(self) -> int:
        return sum(c for c, _ in self.frames)

    def finish(self) -> tuple:
        self.close_frame()
        keys, frames, offsets, sizes = zip(*self.index, strict=True)
        return self.name.hexdigest()[:24], b"".join(self.data) + seek_table(self.frames), list(keys), list(frames), list(offsets), list(sizes)


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload_bytes, record_type and refers_to.

    Digests and ids are grouped; payloads that occur again are then sent to the pages, which stay where they are. Beyond
    ``BROADCAST`` such payloads pages are joined by digest instead, with every payload's pages dealt to ``SALTS`` tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(payload).alias("payload_key"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    keys = ["payload_key", "payload_bytes"]
    again = materialize(pages.filter(F.col("payload_bytes") >= least).groupBy(*keys).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payloads")
    if again.count() <= BROADCAST:
        joined = pages.join(F.broadcast(again), keys, "left")
    else:
        salted = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "html", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def write_bundles(classified: DataFrame, frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL) -> DataFrame:
    """The bundle table with each bundle's part of the index; written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bundle_id", "data", "ids", "frames", "offsets", "sizes"]
        kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        out = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
        writer = BundleWriter(frame, level)
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", "record_type", "refers_to")), strict=True):
                key, url, html, kind, refers = (x.as_py() for x in row)
                payload = html.encode()
                writer.add(key, frame_record(key, url, kind, refers, digest(payload), payload))
                if writer.size >= bundle:
                    yield out(writer.finish())
                    writer = BundleWriter(frame, level)
        if writer.index:
            yield out(writer.finish())

    return materialize(classified.mapInArrow(run, BUNDLES), "warc-bundles", compression="none")


def read_records(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, read back through the seek table and the record index.

    Each frame is decompressed once; a record's digest and length are those of its headers, and for responses
    are checked against the payload. Without ``payloads`` that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda uri: int(v) if (v := uri[len("<urn:page:") : -1]) else None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name, data, frames, offsets in zip(*(batch[c].to_pylist() for c in ("bundle_id", "data", "frames", "offsets")), strict=True):
                rows, at, raw = [], -1, b""
                for f, o in zip(frames, offsets, strict=True):
                    if f != at:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, at, raw = [], f, read_frame(data, f)
                    head, body, _ = parse_record(raw, o)
                    kind, sha = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(body) != sha or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append({"page_id": number(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": sha, "record_type": kind, "refers_to": number(head["WARC-Refers-To"]) if kind == "revisit" else None, "bundle_id": name, "frame": f, "frame_offset": o, "target_uri": head["WARC-Target-URI"], "payload": body if payloads else None})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return bundles.mapInArrow(run, RECORDS)


def index(bundles: DataFrame) -> DataFrame:
    """page_id, bundle_id, frame, frame_offset, record_bytes of every record."""
    return bundles.select("bundle_id", F.explode(F.arrays_zip("ids", "frames", "offsets", "sizes")).alias("r")).select(F.col("r.ids").alias("page_id"), "bundle_id", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("frame_offset"), F.col("r.sizes").alias("record_bytes"))


def export(bundles: DataFrame, folder: str) -> int:
    """Write each bundle to ``folder`` as a .warc.zst file, one at a time through the driver; returns their number."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in bundles.select("bundle_id", "data").toLocalIterator():
        n += 1
        with open(os.path.join(folder, f"{row.bundle_id}-{zlib.crc32(row.data):08x}.warc.zst"), "wb") as out:
            out.write(row.data)
    return n


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as bundles in shared storage and return the bundle table."""
    return write_bundles(classify(pages, least))
