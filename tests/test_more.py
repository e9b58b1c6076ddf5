"""Changes, benchmark runs and reports that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import mock_vector
from millrace.operators import dml
from millrace.plans import evaluation, experiments, gate, indexing, report
from millrace.sources import files, records


def keys(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_vectors_and_graph(spark):
    old = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, embedding array<float>")
    new = spark.createDataFrame([("b", [9.0]), ("c", [1.0, 2.0, 3.0])], "chunk_id string, embedding array<float>")
    got = {r.chunk_id: list(r.embedding) for r in dml.upsert_vectors(old, new, 2).collect()}
    assert got == {"a": [1, 2], "b": [9, 0], "c": [1, 2]}
    n = spark.createDataFrame([("1", "f", "fn", "a")], "id string, symbol string, kind string, file_path string")
    e = spark.createDataFrame([("1", "g", "call")], "source_id string, target_symbol string, edge_type string")
    again = n.withColumn("symbol", F.lit("h")).withColumn("seq", F.lit(2)).unionByName(n.withColumn("seq", F.lit(1)))
    nodes, edges = dml.insert_graph(n, e, again, e, "seq")
    assert keys(nodes, "id", "symbol") == [("1", "h")] and edges.count() == 2
    assert dml.delete_graph(nodes, edges, spark.createDataFrame([("a",)], "path string"))[1].count() == 0
    assert dml.clear(old).count() == 0 and dml.recreate_vectors(old, 7).schema["embedding"].metadata == {"dims": 7}
    meta = records.meta_rows(spark, {"provider": "p", "model": "m", "dimensions": 3, "created_at": "t", "files_indexed": 1, "chunks_stored": 2, "version": "4"})
    assert records.read_meta(dml.touch_meta(meta, chunks_stored=9)).first().chunks_stored == 9
    assert records.read_meta(meta.filter("key <> 'provider'")).count() == 0
    with pytest.raises(Exception, match="lacks model"):
        records.read_meta(meta.filter("key <> 'model'")).collect()


def test_delete_files(spark):
    c = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, file_path string")
    v, f = c.select(F.col("id").alias("chunk_id")), c.select(F.col("file_path").alias("path"))
    left = dml.delete_files(c, v, f, f.filter("path = 'a'"))
    assert [x.count() for x in left] == [1, 1, 1]


def test_reindex(spark, tmp_path):
    body = "def f():\n" + "    x = 1  # something\n" * 8 + "    return x\n"
    src = spark.createDataFrame([("a.py", 9, 1, bytearray(body.encode()))], "path string, size long, mtime long, content binary")
    store = indexing.Store(spark, str(tmp_path / "s"))
    indexing.index(store, src, dims=4)
    again = indexing.reindex({"w": (store, src)}, dims=4)["w"]
    full = indexing.reindex({"w": (store, src)}, full=True, dims=4)["w"]
    assert (again.chunks_created, full.chunks_created) == (0, 1) and full.per_file.first().new_chunks == 1
    sizes = files.scan(spark, str(tmp_path / "s"))
    r = evaluation.store_report("parquet", "c", full, sizes, lambda q: store.read("vectors").limit(1), 4, sample=3)
    assert r["disk_size_bytes"] > 0 and r["query_p50_ms"] <= r["query_p95_ms"] and r["slo_passed"]


def test_runs(spark):
    judged = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "query_id int, doc string, grade int")
    found = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", -0.2)], "file_path string, score double")
    out = evaluation.run([(1, "x"), (2, "y")], lambda _: found, judged)
    assert {r.query_id: r.mrr for r in out.collect()} == {1: 1.0, 2: 0.5}
    modes = evaluation.run_modes(["all", "dense"], lambda m: out)
    assert evaluation.aggregate(modes, ["mode"]).count() == 4
    assert evaluation.aggregate(out).first().mrr == 0.75


def test_experiment_reports(spark):
    rows = [(c, t, "m", arm, r, True, 0.9 if arm == "tool" else 0.5 + r / 100, (100 if arm == "tool" else 300) + r, 3) for c in ("x", "y") for t in ("t1", "t2") for arm in ("tool", "traditional") for r in range(12)]
    trials = spark.createDataFrame(rows, "corpus string, task_id string, model string, arm string, repetition int, success boolean, correctness double, tokens long, steps int")
    tasks = spark.createDataFrame([("t1", 4), ("t2", 1)], "task_id string, difficulty int")
    c = experiments.compare(trials)
    by = {r.hypothesis: r.supported for r in experiments.hypotheses(trials, tasks, c).collect()}
    assert by["H1"] and not by["H2"] and not by["H3"] and by["H4"]
    assert {r.task_id: r.any_significant for r in experiments.task_efficiency(c).collect()} == {"t1": True, "t2": True}
    i = experiments.intervals(trials, "tool", 100).filter("metric = 'tokens'").first()
    assert 100 <= i.lo <= i.mean <= i.hi <= 112
    text = report.experiment("E", {"ratios": experiments.ratios(trials)})
    assert text.startswith("# E") and "| x |" in text and report.to_json(tasks).count("t1") == 1
    assert '"version": "1"' in report.baseline("c", "e", {"mrr": 1})
    s = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 0.5)], "k string, criterion string, score double")
    rubric = spark.createDataFrame([("p", 3.0), ("q", 1.0), ("r", 1.0)], "criterion string, weight double")
    assert experiments.rubric_score(s, rubric, ["k"]).first().score == 0.7
    tokens = trials.withColumn("tokens", F.struct(F.col("tokens").alias("total"))).withColumn("tool_calls", F.array(F.struct(F.lit("g").alias("name")), F.struct(F.lit("g").alias("name"))))
    assert experiments.flat(tokens).first().unique_tools == 1


def test_exit_codes(spark):
    now = records.metric_rows(spark, {"mrr": 0.5})
    same = gate.compare(now, now, gate.tolerances(spark))
    assert gate.exit_code(same) == 0 and gate.exit_code(same, slo_passed=False) == 75
    worse = gate.compare(now, records.metric_rows(spark, {"mrr": 0.51}), gate.tolerances(spark))
    assert gate.exit_code(worse) == 2  # the limit itself regresses
    assert len(mock_vector("", 3)) == 3


def test_corpus_tools(spark, tmp_path):
    for name, body in (("a/x.py", "one\ntwo 42\n"), ("b.RS", "three"), ("c.md", "42")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    f = files.scan(spark, str(tmp_path))
    s = files.corpus_summary(f).first()
    assert s.file_count == 3 and list(s.languages) == ["python", "rust"]
    hits, n = files.grep(files.decode(f), r"\d+")
    assert n == 2 and [r.hit for r in hits.collect()] == ["a/x.py:2:two 42", "c.md:1:42"]
    assert [r.path for r in files.find_names(f, "*X.P?")[0].collect()] == ["a/x.py"]
    assert keys(files.list_dir(f), "name", "type") == [("a", "dir"), ("b.RS", "file"), ("c.md", "file")]
    both = files.corpus(spark, {"corpora": [{"type": "local", "path": str(tmp_path), "extensions": [".py"]}, {"path": str(tmp_path)}]})
    assert keys(both, "path")[0] == ("corpus_0/a/x.py",) and both.count() == 4


def test_versions(spark, tmp_path):
    from millrace.operators import dml

    store = dml.Versions(spark, str(tmp_path / "v"))
    rows = lambda: sorted(r.id for r in spark.read.parquet(store.current("a")).collect())
    store.stage("a", spark.range(3))
    store.stage("a", spark.read.parquet(store.current("a")).filter("id > 0"))
    assert rows() == [1, 2]
    with pytest.raises(RuntimeError), store.change():
        store.stage("a", spark.range(9))
        store.stage("b", spark.range(9))
        raise RuntimeError
    assert rows() == [1, 2] and store.current("b") is None
    before = spark.read.parquet(store.current("a"))
    with store.change():
        store.stage("a", spark.range(1))
        store.stage("b", spark.range(2))
    assert rows() == [0] and store.current("b") and before.count() == 2  # the replaced version stays for one more change


def test_stored_lexical_index(spark, tmp_path):
    from millrace.operators import sparse

    chunks = spark.createDataFrame([("a", "x", "one two two", "f", "en"), ("b", "y", "two three", "g", "en")], "id string, symbol string, content string, file_path string, language string")
    made = sparse.index(chunks)
    kept = sparse.store(made, str(tmp_path / "i"))
    score = lambda i: sorted(sparse.score(i, [["two"]]).collect())
    assert score(kept) == score(made) and kept.postings.filter("term = 'two'").select("bucket").distinct().count() == 1
    again = sparse.refresh(kept, chunks.filter("id = 'a'").withColumn("content", F.lit("nine")), chunks.filter("id = 'b'").select("id"))
    assert sparse.score(again, [["two"]]).count() == 0 and sparse.score(again, [["nine"]]).count() == 1
