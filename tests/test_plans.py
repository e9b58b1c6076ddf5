"""What the physical plans must look like: pushed filters, partial top-k, no cross products where keys exist."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import embedding
from millrace.functions.text import path_prefix
from millrace.operators import dense, graph, sparse
from millrace.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_knn_is_a_partial_top_k(spark, sf):
    p = plan(dense.knn(Q.vecs(spark, sf), [1.0] * 64, 5))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p


def test_batch_top_k_limits_before_the_shuffle(spark, sf):
    v = Q.vecs(spark, sf)
    assert plan(dense.knn_batch(v, v.select(F.col("chunk_id").alias("query_id"), "embedding"), 5)).count("WindowGroupLimit") >= 2


def test_prefix_filter_reaches_the_scan(spark, sf):
    docs = Q.read(spark, sf, "documents")
    assert "StringStartsWith(source,src1)" in plan(docs.filter(path_prefix(F.col("source"), "src1", case_sensitive=True)))


def test_columns_are_pruned(spark, sf):
    p = plan(Q.QUERIES["dense_knn"](spark, sf))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in p
    assert "text:string" not in plan(Q.QUERIES["all_files"](spark, sf))


@pytest.mark.parametrize("name", ["graph_callers", "graph_callees", "graph_dependents", "graph_imports", "enclosing_nodes", "stale_results", "changed_files", "rank_fusion"])
def test_no_nested_loops(spark, sf, name):
    p = plan(Q.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_posting_filter(spark, sf, tmp_path):
    idx = sparse.index(Q.chunks(spark, sf))
    idx.postings.write.parquet(str(tmp_path / "p"))
    idx.lengths.write.parquet(str(tmp_path / "l"))
    stored = sparse.Index(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "l")))
    assert "PushedFilters: [In(term, [license,mit])" in plan(sparse.score(stored, [["mit"], ["license"]])) or "EqualTo(term" in plan(sparse.score(stored, [["mit"]]))


def test_symbol_filter_reaches_the_edges(spark, sf, tmp_path):
    Q.edges(spark, sf).write.parquet(str(tmp_path / "e"))
    p = plan(graph.callers(Q.nodes(spark, sf), spark.read.parquet(str(tmp_path / "e")), "part_7"))
    assert "EqualTo(target_symbol,part_7)" in p and "EqualTo(edge_type,call)" in p


def test_retries():
    waits, calls = [], iter([embedding.Refused(503), embedding.Refused(429, "7"), embedding.Refused(429), None])

    def call():
        e = next(calls)
        if e:
            raise e
        return "ok"

    assert embedding.with_retries(call, sleep=waits.append, factor=lambda: 1.0) == "ok" and waits == [1.0, 7.0, 30.0]
    with pytest.raises(embedding.Refused):
        embedding.with_retries(lambda: (_ for _ in ()).throw(embedding.Refused(400)), sleep=waits.append)
    assert embedding.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", now=30) == 30 and embedding.retry_after("soon") is None
    assert embedding.wait_seconds(10, factor=lambda: 1.0) == 60


def test_embedders():
    sizes = []

    def post(texts):
        sizes.append(len(texts))
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    e = embedding.RemoteEmbedder("gemini", post, dims=1)
    assert [v[0] for v in e.embed_batch(["x" * i for i in range(250)])] == list(range(250)) and sizes == [100, 100, 50]
    assert embedding.RemoteEmbedder("gemini", post).dims == 1
    local = embedding.LocalEmbedder(lambda t: list(map(len, t.split())), lambda ids, mask: np.stack([ids, ids * 0.0], -1).astype(float), dims=2, batch=2)
    got = local.embed_batch(["a bb", "ccc", ""])
    assert np.allclose(got[:2], [[1, 0], [1, 0]]) and np.allclose(got[2], 0)
    ids, mask = embedding.padded([[1, 2, 3], [4]], most=2)
    assert ids.tolist() == [[1, 2], [4, 0]] and mask.tolist() == [[1, 1], [1, 0]]
