import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, stats, text, vectors
from millrace.operators import chunking, dense, fusion, graph, parsing, sparse
from millrace.plans import evaluation, experiments, gate
from millrace.sources import config, files, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([0, 0], [1, 0], 0), ([1, 0], [1], 0), ([], [], 0)])
def test_cosine_edges(spark, a, b, want):
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v)).cast("array<float>")
    assert one(spark, vectors.cosine(lit(a), lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("raw,want", [("", ""), ('*^"():;-+', ""), ("key-based  search", '"keybased" "search"'), ("a\tb", '"a" "b"')])
def test_sanitize(spark, raw, want):
    assert one(spark, text.sanitize(F.lit(raw))) == want


def test_fold_and_prefix(spark):
    assert one(spark, text.tokens(F.lit("Café user_login.x"))) == ["cafe", "user", "login", "x"]
    assert one(spark, text.path_prefix(F.lit("SRC/a%b"), "src/a%"))
    assert not one(spark, text.path_prefix(F.lit("src/axb"), "src/a%"))
    assert text.escape_like("a%_\\") == "a\\%\\_\\\\%"


@pytest.mark.parametrize("raw,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("\n\n", ["", ""])])
def test_lines(spark, raw, want):
    assert one(spark, text.text_lines(F.lit(raw))) == want


def test_dims_and_mock(spark):
    assert one(spark, vectors.fit_dims(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1, 2, 0]
    v = vectors.mock_vector("abc", 8)
    assert math.isclose(float((v**2).sum()), 1, rel_tol=1e-5) and (v == vectors.mock_vector("abc", 8)).all()
    assert vectors.decode_blob(vectors.encode_blob([1.5, -2])) == [1.5, -2]
    assert len(vectors.seeded_query(5, "s")) == 5


def test_normal(spark):
    assert one(spark, stats.normal_cdf(F.lit(-1.96))) == pytest.approx(0.025, abs=1e-4)
    assert 2 * one(spark, stats.normal_cdf(F.lit(-1.96), compat=True)) == pytest.approx(0.03805, abs=1e-4)


def test_generator():
    draw = hashing.mulberry32(1)
    got = [draw() for _ in range(100)]
    assert all(0 <= x < 1 for x in got) and len(set(got)) == 100
    order = experiments.task_order([("a", 1), ("b", 2), ("c", 3), ("d", 5)], "x", 1)
    assert sorted(order[:2]) == ["a", "b"] and order[2:] == ["c", "d"]


def chunk(spark, rows):
    ddl = "id string, file_path string, start_line int, end_line int, symbol string, kind string, content string, parent_context string, language string"
    return spark.createDataFrame([(f"c{i}", p, 1, 2, s, "k", t, None, lang) for i, (p, s, t, lang) in enumerate(rows)], ddl)


def test_bm25_and(spark):
    c = chunk(spark, [("a.py", None, "login page", "python"), ("b.py", "user_login", "café", "python"), ("c.rs", None, "tax login", "rust")])
    idx = sparse.index(c)
    ids = lambda q, **k: {r.chunk_id for r in sparse.search(c, idx, q, **k).collect()}
    assert ids("login") == {"c0", "c1", "c2"}
    assert ids("login tax") == {"c2"}
    assert ids("user_login") == {"c1"} and ids("login_user") == set()
    assert ids("cafe") == {"c1"} and ids('"') == set()
    assert ids("login", language="rust") == {"c2"} and ids("login", path="A.") == {"c0"}
    again = sparse.refresh(idx, c.filter("id = 'c0'").withColumn("content", F.lit("zebra")), c.filter("id = 'c2'").select("id"))
    assert {r.chunk_id for r in sparse.search(c, again, "zebra").collect()} == {"c0"}
    assert sparse.lexical(c, "tax nothing").first().score == 0.5


def test_rrf_edges(spark):
    c = chunk(spark, [("a", None, "x", "l"), ("b", None, "y", "l")])
    a = c.withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("id")))
    both = {r.file_path: r.score for r in fusion.rrf([a, a]).collect()}
    assert both["a"] == pytest.approx(2 / 61) and both["b"] == pytest.approx(2 / 62)
    twice = {r.file_path: r.score for r in fusion.rrf([a.union(a)]).collect()}
    assert twice == both
    assert fusion.rrf([a.limit(0), a], limit=1).count() == 1
    fails = lambda q, d: 1 / 0
    assert [r.file_path for r in fusion.rerank(a, "q", 5, fails).collect()] == ["a", "b"]


def test_hybrid_degrades(spark):
    good = lambda: chunk(spark, [("a", None, "x", "l")]).withColumn("score", F.lit(1.0))

    def bad():
        return good().select("missing")

    assert fusion.hybrid(good, bad).count() == 1
    assert fusion.hybrid(bad, good).count() == 1
    with pytest.raises(RuntimeError):
        fusion.hybrid(bad, bad)


def test_batch_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id long, embedding array<float>")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(dense.knn_batch(v, q, 3)) == key(dense.knn_batch(v, q, 3, batch=4))


def test_graph(spark):
    n = spark.createDataFrame([("1", "f", "fn", "a"), ("2", "g", "fn", "a"), ("3", "g", "fn", "b")], "id string, symbol string, kind string, file_path string")
    e = spark.createDataFrame([("1", "g", "call"), ("1", "g", "call"), ("1", "out", "call"), ("2", "ext", "import")], "source_id string, target_symbol string, edge_type string")
    assert graph.callers(n, e, "g").count() == 2
    assert graph.callers(n, e, "g", "b").count() == 2
    assert graph.callers(n, e, "out").count() == 1
    assert graph.callees(n, e, "f").count() == 4
    assert [r.id for r in graph.imports(n, e, "g").collect()] == ["ext:ext"]
    assert one(spark, graph.route(F.lit(" Who calls Foo ")))["symbol"] == "foo"


@pytest.mark.parametrize("n,want", [(0, []), (1, [(1, 1)]), (50, [(1, 50)]), (51, [(1, 50), (41, 51)]), (90, [(1, 50), (41, 90)]), (91, [(1, 50), (41, 90), (81, 91)])])
def test_windows(spark, n, want):
    f = spark.createDataFrame([("p", "\n".join(f"line {i}" for i in range(n)), "unknown", 1)], "path string, content string, language string, mtime long")
    got = chunking.line_windows(f).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == want
    for r in got:
        assert f.first().content.encode()[r.byte_start : r.byte_end].decode() == r.content


PY = "import os\nfrom a import b as c\n\n@deco\ndef first(x):\n    return second(x, '" + "x" * 90 + "')\n\nclass K:\n    def m(self):\n        return first(1)\n" + "    # pad\n" * 12 + "    z = 1\n"
RS = 'use std::io::{self, Read};\npub fn run(a: u32) -> u32 {\n    let s = "}{";\n    helper(a) // ' + "y" * 80 + "\n}\n\npub struct P {\n    x: u32,\n" + "    // pad\n" * 12 + "}\n"


def test_parsing(spark):
    assert [n.name for n in parsing.parse(PY, "python")] == ["first", "K"]
    assert [n.name for n in parsing.parse(RS, "rust")] == ["run", "P"]
    nodes, edges = parsing.file_graph("a.py", PY, "python")
    assert {n[1] for n in nodes} >= {"first", "K", "m"} and {e[1] for e in edges if e[2] == "import"} == {"os", "b"}
    assert {(e[1]) for e in edges if e[2] == "call"} >= {"second", "first"}
    assert {e[1] for e in parsing.file_graph("a.rs", RS, "rust")[1]} >= {"helper", "self", "Read"}
    assert parsing.outline_file(RS, "rust")[0][2:] == ("pub fn run(a: u32) -> u32", 2, "pub")
    f = spark.createDataFrame([("a.py", PY, "python", 1), ("b.rs", RS, "rust", 1), ("c.go", "x\n" * 3, "go", 1)], "path string, content string, language string, mtime long")
    c = {(r.file_path, r.symbol, r.kind) for r in parsing.chunk_files(f).collect()}
    assert ("a.py", "first", "decorated_definition") in c and ("b.rs", "run", "function_item") in c and ("c.go", None, "line_block") in c
    assert parsing.outline(f).filter("path = 'a.py'").count() == 3


def test_metrics_edges(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, doc string, rank int")
    j = spark.createDataFrame([(1, "b", 2), (2, "a", 0), (3, "a", 1)], "query_id int, doc string, grade int")
    m = {x.query_id: x for x in evaluation.metrics(r, j, q).collect()}
    assert m[1].mrr == 0.5 and m[1].recall_at_5 == 1 and m[1].ndcg_at_10 == pytest.approx(1 / math.log2(3))
    assert m[2].recall_at_5 == 0 and m[3].mrr == 0


def test_gate(spark, tmp_path):
    for bad in ("{", '{"version": "2", "corpus": "c", "embedder": "e"}', '{"version": "1", "corpus": "", "embedder": "e"}'):
        p = tmp_path / "b.json"
        p.write_text(bad)
        assert gate.run(spark, {}, str(p)) == gate.FAILED
    p.write_text('{"version": "1", "corpus": "c", "embedder": "e", "metrics": {"mrr": 0.5}}')
    assert gate.run(spark, {"mrr": 0.505}, str(p)) == gate.PASSED
    assert gate.run(spark, {"mrr": 0.52}, str(p)) == gate.REGRESSED
    nan = gate.compare(records.metric_rows(spark, {"mrr": float("nan")}), records.metric_rows(spark, {"mrr": 1}), gate.tolerances(spark))
    assert nan.first().status == "regress"


def test_sources(spark, tmp_path):
    (tmp_path / "src/tests").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src/b.min.js").write_text("1")
    (tmp_path / "src/skip.rs").write_text("1")
    (tmp_path / "src/tests/t.py").write_text("1")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    os.symlink("/etc/hostname", tmp_path / "src/out.py")
    f = files.scan(spark, str(tmp_path / "src"))
    kept = {r.path for r in files.discover(f, gitignore=["skip.*", "# no"]).collect()}
    assert {"a.py", "bad.py"} <= kept and not kept & {"b.min.js", "skip.rs", "tests/t.py"}
    assert [r.path for r in files.decode(files.discover(f)).filter("path in ('a.py', 'bad.py')").collect()] == ["a.py"]
    d = files.decode(f.filter("path = 'a.py'"))
    assert [r.text for r in files.read_lines(d, "a.py", 2, 9).collect()] == ["y = 2"]
    with pytest.raises(ValueError):
        files.read_lines(d, "a.py", 3, 4)
    assert files.guard_links(str(tmp_path / "src"), ["a.py", "out.py"]) == ["a.py"]
    assert files.resolve({"w": str(tmp_path / "src")}, "../x") is None
    c = config.load(environ={"MILLRACE_LIMIT": "7"})
    assert c.limit == 7
    with pytest.raises(ValueError):
        config.load(environ={"MILLRACE_LIMIT": "0"})
    (tmp_path / "q.toml").write_text('[[queries]]\ntext = "t"\njudgments = [{file = "a", grade = 2}]\n')
    assert records.load_queries(spark, str(tmp_path / "q.toml")).first().judgments[0].grade == 2
    entries = spark.createDataFrame([(0, "x"), (1, "y")], "seq int, a string")
    records.save_trajectory(entries, {"m": 1}, str(tmp_path / "t"))
    meta, back = records.load_trajectory(spark, str(tmp_path / "t"), "a string")
    assert meta == {"m": 1} and [r.a for r in back.orderBy("seq").collect()] == ["x", "y"]


def test_bootstrap_and_tests(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(10)], "k string, v double")
    r = stats.bootstrap(df, ["k"], "v", 300).first()
    assert r.lo < r.mean < r.hi
    p = spark.createDataFrame([("k", 1.0, 1.0), ("j", 1.0, 3.0), ("j", 2.0, 1.0), ("j", 5.0, 1.0)], "k string, x double, y double")
    w = {r.k: r for r in stats.wilcoxon(p, ["k"], "x", "y").collect()}
    assert w["k"].p_value == 1 and w["j"].n == 3 and w["j"].statistic == 2


def test_bootstrap_broadcasts_no_draws(spark):
    df = spark.createDataFrame([("k", float(i % 7)) for i in range(50)] + [("j", 2.0)], "k string, v double")
    out = stats.bootstrap(df, ["k"], "v", 40)
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x and "_i" in x for x in joins)
    got = {r.k: r for r in out.collect()}
    assert (got["j"].lo, got["j"].mean, got["j"].hi) == (2.0, 2.0, 2.0) and got["k"].lo < got["k"].mean < got["k"].hi


def test_enclosing_blocks(spark):
    import random

    rng = random.Random(5)
    nodes = [(rng.choice("ab"), f"n{i}", s, s + rng.choice([-1, 0, 1, 2, 7, 30, 300])) for i, s in enumerate(rng.choices(range(-40, 200), k=150))] + [("a", None, 5, None), (None, "x", 0, 9)]
    spots = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(-60, 600)) for i in range(400)] + [(400, "a", None)]
    e, n = spark.createDataFrame(spots, "i int, file_path string, pos long"), spark.createDataFrame(nodes, "file_path string, id string, start long, end long")
    out = graph.enclosing(e, n)
    inside = lambda f, p: [(y - x, d) for g, d, x, y in nodes if None not in (f, p, g, y) and f == g and x <= p <= y]
    want = {i: min(inside(f, p))[1] if inside(f, p) else f and hashlib.sha256(f.encode()).hexdigest() for i, f, p in spots}
    assert {r.i: r.source_id for r in out.collect()} == want and len(want) == 401
    # many nodes around one position leave one row a block: before, every position met every node of its bucket
    many = spark.range(3000).select(F.lit("a").alias("file_path"), F.col("id").cast("string").alias("id"), F.lit(0).alias("start"), F.col("id").alias("end"))
    p = graph.enclosing(spark.range(3000).select(F.lit("a").alias("file_path"), F.lit(1).alias("pos")), many)
    plan = p._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and {r.source_id for r in p.collect()} == {"1"}
    assert all("_b" in x for x in plan.splitlines() if "SortMergeJoin" in x and "_k" in x)


def test_batch_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [rng.integers(-3, 4, 6).astype(float).tolist() for _ in range(120)]
    rows += rows[:40] * 2 + [[0.0] * 6] * 9 + [[float("nan"), 1.0, 0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [], None]
    v = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(rows)], "chunk_id string, embedding array<float>")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
    found = dense.knn_batch(v, q, 5, -0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # no pair of vectors is a row of the plan
    pairs = v.join(q.select("query_id", F.col("embedding").alias("_q")), F.size("embedding") == F.size("_q"))
    size = vectors.norm(F.col("embedding")) * vectors.norm(F.col("_q"))
    scored = pairs.select("query_id", "chunk_id", F.when(size > 0, vectors.dot(F.col("embedding"), F.col("_q")) / size).otherwise(0.0).alias("score")).filter("score >= -0.5")
    want = fusion.ranked(scored, ["query_id"], ["chunk_id"]).filter("rank <= 5").select("query_id", "rank", "chunk_id", "score")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(want)


def test_counted_dependents(spark):
    n = spark.createDataFrame([(f"n{i % 17}", f"s{i % 5}", "k", f"f{i % 3}") for i in range(40)] + [("x", None, "k", "f0")], "id string, symbol string, kind string, file_path string")
    e = spark.createDataFrame([(f"n{i % 20}", f"s{i % 7}", ["call", "import", "extends", "reference"][i % 4]) for i in range(300)] + [("n1", None, "import")], "source_id string, target_symbol string, edge_type string")
    for options in ({}, {"symbol": "s3"}, {"file": "f1"}):
        rows = graph.dependents(n, e, **options)
        want = rows.groupBy(rows.columns).count()
        assert sorted(want.collect()) == sorted(graph.dependents(n, e, **options, counted=True).collect())
    assert graph.dependents(n, e, counted=True).count() < graph.dependents(n, e).count()


def test_postings_shuffle_no_tokens(spark):
    texts = ["b a b, c; b", "", None, "x", "é É e"]
    idx = sparse.index(chunk(spark, [("f", None, t, "en") for t in texts]))
    assert "Exchange" not in idx.postings._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term): r.positions for r in idx.postings.filter("field = 'content'").collect()}
    assert got == {("c0", "b"): [0, 2, 4], ("c0", "a"): [1], ("c0", "c"): [3], ("c3", "x"): [0], ("c4", "e"): [0, 1, 2]}
