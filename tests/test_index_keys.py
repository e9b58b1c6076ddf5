"""What index runs move: keys, and the texts of changed files only; the joins that see to it."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml, parsing
from millrace.plans import indexing


@pytest.fixture
def store(spark, tmp_path):
    return indexing.Store(spark, str(tmp_path / "index"))


def test_index_moves_keys_not_texts(spark, store):
    """A first run, a run over a tenth of the files and a removal shuffle less than a tenth of the text."""
    draw = random.Random(7)
    rows = [(f"d/{i}.txt", 1, bytes(draw.choices(b"0123456789abcdefghijklmnopqrstuvwxyz", k=20000))) for i in range(200)]
    files = spark.createDataFrame(rows, "path string, mtime bigint, content binary").withColumn("size", F.octet_length("content").cast("bigint"))
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    first = indexing.index(store, files, dims=4, now=1)
    later = files.withColumn("mtime", F.when(F.col("path").rlike("0.txt$"), 2).otherwise(F.col("mtime")).cast("bigint"))
    second = indexing.index(store, later, dims=4, now=2)
    indexing.remove(store, files.filter("path rlike '1.txt$'").select("path"))
    assert (first.files_indexed, first.chunks_created, second.files_indexed, second.chunks_created, second.chunks_removed) == (200, 200, 20, 0, 0)
    assert store.read("chunks").count() == store.read("vectors").count() == store.read("files").count() == store.read("nodes").count() == 180
    assert 0 < moved() - before < 400_000


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15, 8])
def test_within_and_without_are_exact(spark, monkeypatch, bits):
    """Also where the filter tells few keys apart, and for null and repeated keys."""
    monkeypatch.setattr(dml, "BITS", bits)
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, "a" if i % 2 else None, i) for i in range(200)], "k int, s string, n int")
    keys = spark.createDataFrame([(None, "a"), (3, None), (3, None), (4, "a"), (11, "a"), (99, "a")], "k int, s string")
    wanted = {(None, "a"), (3, None), (4, "a"), (11, "a"), (99, "a")}
    data = [tuple(r) for r in rows.collect()]
    order = lambda found: sorted((tuple(r) for r in found), key=lambda r: r[2])
    assert order(dml.within(rows, keys, ["k", "s"]).collect()) == [r for r in data if r[:2] in wanted]
    assert order(dml.within(rows, keys, ["k", "s"], ["k"]).collect()) == [r for r in data if r[:2] in wanted]
    assert order(dml.without(rows, keys, ["k", "s"]).collect()) == [r for r in data if r[:2] not in wanted]
    assert dml.without(rows, keys.limit(0), ["k", "s"]).count() == 200 and dml.within(rows, keys.limit(0), ["k", "s"]).count() == 0


def test_chunks_of_mixed_languages(spark):
    """Languages that have no parser skip it; with or without the languages given, the chunks are the same."""
    body = "\n".join(f"    x{i} = {i}  # some words to fill the line" for i in range(5))
    rows = [("a.py", f"def f():\n{body}\n", "python", 1), ("b.py", "x = 1\n", "python", 1), ("c.txt", "one\ntwo\n", "unknown", 1), ("d.txt", "three", None, 1)]
    files = spark.createDataFrame(rows, "path string, content string, language string, mtime bigint")
    found = {(r.file_path, r.kind) for r in parsing.chunk_files(files).collect()}
    assert found == {("a.py", "function_definition"), ("b.py", "line_block"), ("c.txt", "line_block"), ("d.txt", "line_block")}
    plain = files.filter("path like '%.txt'")
    assert sorted(map(tuple, parsing.chunk_files(plain, {"unknown", None}).collect())) == sorted(map(tuple, parsing.chunk_files(plain).collect()))
