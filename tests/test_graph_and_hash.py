"""Graph lookups of all names at once, and the polynomial hash."""

import os
import time
from collections import Counter

from pyspark.sql import Row

from millrace.functions.hashing import MASK, poly31
from millrace.operators import graph


def test_callees_come_name_by_name(spark):
    """A merge join deals one frequent name to several tasks and gives each edge and node once."""
    nodes = spark.createDataFrame([(f"n{i}", "hot" if i < 40 else f"f{i}", "f", "a" if i % 2 else "b") for i in range(60)], "id string, symbol string, kind string, file_path string")
    edges = spark.createDataFrame([(f"n{i % 60}", "hot" if i % 3 else "f50", "call") for i in range(300)] + [("n1", None, "call"), ("n1", "gone", "call"), ("none", "hot", "call")], "source_id string, target_symbol string, edge_type string")
    found = graph.callees(nodes, edges, file="a")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    names, symbol = {}, {}
    for n in nodes.collect():
        names.setdefault(n.symbol, []).append(n.id)
        if n.file_path == "a":
            symbol[n.id] = n.symbol
    wanted = sorted((t, symbol[e.source_id]) for e in edges.collect() if e.source_id in symbol for t in names.get(e.target_symbol, []))
    assert sorted((r.id, r.source_symbol) for r in found.collect()) == wanted and len(wanted) > 3000


def test_rows_are_repeated_and_not_joined_node_by_node(spark):
    """Callers of a file's nodes and dependents: a row meets a name once, also one with more nodes than a block has."""
    many = 2 * graph.BLOCK + 7
    nodes = spark.createDataFrame([(f"n{i}", "hot", "f", "a") for i in range(many)] + [("m0", "one", "f", "a"), ("m1", "hot", "f", "b"), ("m2", None, "f", "a"), (None, "two", "f", "a")], "id string, symbol string, kind string, file_path string")
    edges = spark.createDataFrame([(s, t, k) for k in ("call", "import") for s, t in [("m0", "hot"), ("m0", "hot"), ("m1", "one"), ("m1", "gone"), ("m1", None), ("m1", "two"), (None, "hot"), ("lost", "hot"), ("n5", "hot")]], "source_id string, target_symbol string, edge_type string")
    found = {True: graph.callers(nodes, edges, file="a"), False: graph.dependents(nodes, edges, file="a")}
    for got in found.values():
        assert Counter((r.id, r.target_symbol) for r in got.collect()) == {("m0", "hot"): 2 * many, ("n5", "hot"): many, ("m1", "one"): 1, ("m1", "two"): 1}
        assert "Generate explode(_copies" in got._jdf.queryExecution().executedPlan().toString()
    assert graph.callers(nodes, edges, "hot", "a").count() == 3 * many and graph.dependents(nodes, edges, "one").collect() == [("m1", "hot", "f", "b", "one")]


def test_imports_meet_blocks_of_nodes(spark):
    """A row per edge and node from joins of blocks; unresolved names and nodes with nulls get the external values."""
    many = graph.BLOCK + 3
    nodes = spark.createDataFrame([(f"n{i}", "hot", "f", f"p{i % 3}") for i in range(many)] + [("n1", "hot", "f", "p1"), ("m0", "one", "f", "a"), (None, "one", None, None), ("m1", None, "f", "b")], "id string, symbol string, kind string, file_path string")
    edges = spark.createDataFrame([(s, t, "import") for s, t in [("m0", "hot"), ("m0", "hot"), ("m1", "one"), ("m1", "gone"), ("m0", None), ("lost", "hot"), (None, "hot"), ("n5", "gone")]] + [("m0", "one", "call")], "source_id string, target_symbol string, edge_type string")
    found = graph.imports(nodes, edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Generate explode(coalesce(_nodes" in plan
    source, names = {n.id: n.symbol for n in nodes.collect() if n.id}, {}
    for n in nodes.collect():
        names.setdefault(n.symbol, []).append(n)
    wanted = Counter()
    for e in edges.filter("edge_type = 'import'").collect():
        name, ext = e.target_symbol, e.target_symbol and "ext:" + e.target_symbol
        if e.source_id in source:
            wanted.update((n.id or ext, name, n.kind or "external", n.file_path or "", source[e.source_id]) for n in (name and names.get(name)) or [Row(id=ext, kind="external", file_path="")])
    assert Counter(map(tuple, found.collect())) == wanted and wanted["n1", "hot", "f", "p1", "one"] == 4 and wanted["ext:gone", "gone", "external", "", None] == 1
    one = {k: v for k, v in wanted.items() if k[4] == "one"}
    assert Counter(map(tuple, graph.imports(nodes, edges, "one").collect())) == one


def test_poly31_is_the_sum_by_bytes():
    for n in (0, 1, 2, 1000, 65535, 65536, 65537, 200001):
        data, h = os.urandom(n), 0
        for b in data:
            h = (h * 31 + b) & MASK
        assert poly31(data) == h
    began = time.process_time()
    poly31(bytes(32 << 20))
    assert time.process_time() - began < 1
