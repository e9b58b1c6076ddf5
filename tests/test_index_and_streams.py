"""The index pipeline end to end, incremental runs, search over it, and the change stream."""

import datetime as dt

import pytest

from millrace.functions.vectors import mock_vector
from millrace.operators import sparse
from millrace.plans import indexing, report, search
from millrace.streaming import changes


def source(spark, rows):
    ddl = "path string, size long, mtime long, content binary"
    return spark.createDataFrame([(p, len(t), m, bytearray(t.encode())) for p, m, t in rows], ddl)


BODY = "\n".join(f"    total = total + {i}  # step" for i in range(8))
A = f"def alpha(total):\n{BODY}\n    return beta(total)\n"
B = f"import alpha\n\ndef beta(total):\n{BODY}\n    return total\n"


@pytest.fixture
def store(spark, tmp_path):
    return indexing.Store(spark, str(tmp_path / "index"))


def test_incremental(spark, store):
    r = indexing.index(store, source(spark, [("a.py", 1, A), ("b.py", 1, B)]), dims=8, now=5)
    assert (r.files_indexed, r.chunks_created, r.chunks_stored) == (2, 2, 2)
    r = indexing.index(store, source(spark, [("a.py", 1, A), ("b.py", 1, B)]), dims=8, now=6)
    assert (r.files_indexed, r.files_skipped, r.chunks_created) == (0, 2, 0)
    r = indexing.index(store, source(spark, [("a.py", 2, A.replace("step", "move"))]), dims=8, now=7, delete_stale=False)
    assert (r.chunks_created, r.files_stored) == (1, 2)
    space = search.Workspace(store.read("chunks"), store.read("vectors"), sparse.index(store.read("chunks")), store.read("nodes"), store.read("edges"), lambda t: [mock_vector(x, 8) for x in t])
    for mode in search.MODES:
        got = search.search({"w": space}, "who calls beta" if mode == "graph" else "move" if mode == "sparse" else "total move", search.Options(mode=mode, threshold=-1.0))
        assert got.count() >= 1
    both = {"w": space, "v": space}
    assert search.search(both, "total", search.Options(mode="hybrid", threshold=-1.0)).count() >= 2
    assert search.search(both, "callers of beta", routing="auto").select("repo_name").distinct().count() == 2
    assert "beta" in search.to_text(search.search({"w": space}, "beta", search.Options(mode="sparse")))
    assert search.graph_tool({"w": space}, "callers", "beta").first().symbol == "alpha"
    assert "score" in report.table(search.search({"w": space}, "beta", search.Options(mode="sparse")).select("file_path", "score"))
    r = indexing.index(store, source(spark, [("b.py", 1, B)]), dims=8, now=8)
    assert (r.files_stored, r.chunks_stored) == (1, 1) and store.read("vectors").count() == 1
    indexing.remove(store, spark.createDataFrame([("b.py",)], "path string"))
    assert store.read("chunks").count() == 0 and store.read("nodes").count() == 0
    with pytest.raises(ValueError):
        search.Options(mode="x").check()


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", False, t), ("a", True, t + dt.timedelta(seconds=1)), ("b", False, t), ("c", True, t), ("c", False, t + dt.timedelta(seconds=1))]
    spark.createDataFrame(rows, changes.CHANGES).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = changes.source(spark, str(tmp_path / "in"))
    changes.sync(stream, str(tmp_path / "ck"), lambda d: seen.append(("gone", sorted(r.path for r in d.collect()))), lambda d: seen.append(("new", sorted(r.path for r in d.collect())))).awaitTermination(120)
    assert seen == [("gone", ["a"]), ("new", ["b", "c"])]
    burst = changes.debounce(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert {(r.path, r.changes, r.is_removal) for r in burst} == {("a", 2, True), ("b", 1, False), ("c", 2, False)}


def test_pending_state(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "change"), ("a", t + dt.timedelta(seconds=5), "change"), ("b", t, "change"), ("b", t + dt.timedelta(seconds=1), "synced")]
    spark.createDataFrame(rows, "path string, ts timestamp, kind string").write.parquet(str(tmp_path / "p"))
    s = changes.source(spark, str(tmp_path / "p"), "path string, ts timestamp, kind string")
    q = changes.pending(s).writeStream.outputMode("update").format("memory").queryName("pending_files").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {r.path: r for r in spark.table("pending_files").collect()}
    assert got["a"].is_pending and got["a"].since == t and not got["b"].is_pending


def test_late_rows_and_replay(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    folder, ck = str(tmp_path / "d"), str(tmp_path / "ck")
    s = changes.debounce(_stream(spark, folder, [("a", False, t), ("a", False, t + dt.timedelta(seconds=1)), ("z", False, t + dt.timedelta(hours=1))]))
    q = s.writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).option("checkpointLocation", ck).start()
    q.awaitTermination(120)
    assert {r.path for r in spark.table("bursts").collect()} <= {"a", "z"}


def _stream(spark, folder, rows):
    spark.createDataFrame(rows, changes.CHANGES).write.parquet(folder)
    return changes.source(spark, folder)


def test_status_banner(spark):
    r = spark.createDataFrame([("a/b.py", 100)], "file_path string, since long")
    assert "Stale: a/b.py changed 2m ago" in search.banner(r, 230)
