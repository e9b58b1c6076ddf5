"""The engine's operators as queries over the shared tables, each with SQL for comparison.

Relations: a document is a file and a chunk, an embedding row a vector, suppliers and parts are graph nodes with
line items as edges, orders are trials of two arms, events are file changes. Real results are rounded to six
decimals, as engines add in different orders.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import stats, text, vectors
from millrace.operators import chunking, dense, diff, dml, fusion, graph, lookups, sparse
from millrace.plans import evaluation, experiments, gate, indexing, search
from millrace.session import scratch
from millrace.sources import files as sources
from millrace.sources import records
from millrace.streaming import changes as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# relations, and the same as SQL


def files(spark, d):
    return read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("hash"))


FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS path, text AS content, lang AS language, doc_id AS mtime, n_chars AS size, sha256(text) AS hash FROM documents)"


def chunks(spark, d):
    return read(spark, d, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 100).cast("string"), F.lit(".txt")).alias("file_path"), F.col("doc_id").cast("int").alias("start_line"), (F.col("doc_id") + 9).cast("int").alias("end_line"), F.col("source").alias("symbol"),
        F.lit("document").alias("kind"), F.col("text").alias("content"), F.lit(None).cast("string").alias("parent_context"), F.col("lang").alias("language"), F.sha2("text", 256).alias("content_hash"),
    )


CHUNKS = "chunks AS (SELECT 'c' || doc_id AS id, source || '/' || (doc_id % 100) || '.txt' AS file_path, doc_id::INTEGER AS start_line, (doc_id + 9)::INTEGER AS end_line, source AS symbol, 'document' AS kind, text AS content, NULL::VARCHAR AS parent_context, lang AS language, sha256(text) AS content_hash FROM documents)"


def nodes(spark, d):
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("symbol"), F.lit("supplier").alias("kind"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("file_path"))
    p = read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("part_"), (F.col("p_partkey") % 500).cast("string")).alias("symbol"), F.lit("part").alias("kind"), F.col("p_brand").alias("file_path"))
    return s.unionByName(p)


def edges(spark, d):
    target = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("lib_"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("part_"), (F.col("l_partkey") % 600).cast("string")))
    kind = F.when(F.col("l_linenumber").isin(1, 2, 3), "call").when(F.col("l_linenumber").isin(4, 7), "import").when(F.col("l_linenumber") == 5, "extends").otherwise("reference")
    return read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), target.alias("target_symbol"), kind.alias("edge_type"))


GRAPH = """nodes AS (SELECT 's' || s_suppkey AS id, 'supplier_' || s_suppkey AS symbol, 'supplier' AS kind, 'nation/' || s_nationkey AS file_path FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'part_' || (p_partkey % 500), 'part', p_brand FROM part),
edges AS (SELECT 's' || l_suppkey AS source_id, CASE WHEN l_linenumber = 7 THEN 'lib_' || l_partkey ELSE 'part_' || (l_partkey % 600) END AS target_symbol,
  CASE WHEN l_linenumber IN (1, 2, 3) THEN 'call' WHEN l_linenumber IN (4, 7) THEN 'import' WHEN l_linenumber = 5 THEN 'extends' ELSE 'reference' END AS edge_type FROM lineitem)"""


def vecs(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def trials(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("corpus"), F.concat(F.lit("t"), (F.col("o_custkey") % 12).cast("string")).alias("task_id"), F.col("o_orderstatus").alias("model"), F.when(F.col("o_orderkey") % 2 == 0, "tool").otherwise("traditional").alias("arm"), F.col("o_orderkey").alias("repetition"), (F.col("o_custkey") % 3 > 0).alias("success"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 101 / 100.0).alias("correctness"), F.floor("o_totalprice").cast("long").alias("tokens"), (F.col("o_orderkey") % 7 + 1).alias("steps"))


TRIALS = "trials AS (SELECT o_orderpriority AS corpus, 't' || (o_custkey % 12) AS task_id, o_orderstatus AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'tool' ELSE 'traditional' END AS arm, o_orderkey AS repetition, o_custkey % 3 > 0 AS success, ((o_orderkey * 7 + o_custkey) % 101) / 100.0::DOUBLE AS correctness, floor(o_totalprice)::BIGINT AS tokens, o_orderkey % 7 + 1 AS steps FROM orders)"


def change_rows(spark, d):
    return read(spark, d, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 200).cast("string")).alias("path"), (F.col("event_type") == "error").alias("is_removal"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


CHANGES = "changes AS (SELECT 'f' || (user_id % 200) AS path, event_type = 'error' AS is_removal, ts, event_id FROM events)"


# scans and sources


@query(f"WITH {CHUNKS} SELECT id, start_line, language FROM chunks WHERE file_path = 'src3/3.txt'")
def chunks_of_file(spark, d):
    return lookups.chunks_of_file(chunks(spark, d), "src3/3.txt").select("id", "start_line", "language")


@query(f"WITH {FILES} SELECT path, size, mtime FROM files")
def all_files(spark, d):
    return lookups.all_files(files(spark, d)).select("path", "size", "mtime")


@query("SELECT 'p' AS provider, 'm' AS model, count(*)::INTEGER AS dimensions, 'now' AS created_at, NULL::VARCHAR AS last_sync_at, count(*) AS files_indexed, count(*) AS chunks_stored, '4' AS version FROM documents")
def meta_record(spark, d):
    n = read(spark, d, "documents").agg(F.count(F.lit(1)).cast("string").alias("n"))
    keys = {"provider": F.lit("p"), "model": F.lit("m"), "dimensions": F.col("n"), "created_at": F.lit("now"), "last_sync_at": F.lit(""), "files_indexed": F.col("n"), "chunks_stored": F.col("n"), "version": F.lit("4")}
    rows = n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()))).alias("r")).select("r.*")
    return records.read_meta(rows)


@query(f"WITH {FILES} SELECT 'corpus_0/' || path AS path, size FROM files WHERE language = 'en' UNION ALL SELECT 'corpus_1/' || path, size FROM files WHERE language <> 'en'")
def multi_corpus(spark, d):
    f = files(spark, d).select("path", "size", "language")
    return sources.multi_corpus([f.filter("language = 'en'").drop("language"), f.filter("language <> 'en'").drop("language")])


@query("SELECT vec_id AS chunk_id, len(embedding)::INTEGER AS dims FROM embeddings WHERE vec_id % 7 <> 0")
def json_vectors(spark, d):
    v = vecs(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 7 == 0, "[1, oops").otherwise(F.to_json("embedding")).alias("embedding"))
    return records.json_vectors(v).select("chunk_id", F.size("embedding").alias("dims"))


@query(f"""WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files WHERE content <> ''), c AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM l)
SELECT path, i::INTEGER AS line, length(l[i]) AS chars FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM c)""")
def file_lines(spark, d):
    rows = files(spark, d).select("path", F.posexplode(text.text_lines(F.col("content"))).alias("i", "t"))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.length("t").cast("long").alias("chars"))


@query(f"WITH {FILES} SELECT path, CASE WHEN mtime % 5 = 0 THEN 'missing' ELSE 'modified' END AS problem FROM files WHERE mtime % 5 = 0 OR mtime % 5 = 1")
def manifest_problems(spark, d):
    f = files(spark, d).withColumn("content", F.encode("content", "utf-8"))
    now = f.filter("mtime % 5 <> 0").withColumn("content", F.when(F.col("mtime") % 5 == 1, F.encode(F.lit("x"), "utf-8")).otherwise(F.col("content")))
    return sources.verify_manifest(sources.manifest(f), sources.manifest(now))


@query(f"WITH {FILES}, hits AS (SELECT path || ':' || i || ':' || l[i] AS hit FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)) WHERE regexp_matches(l[i], '[0-9]{{4}}')) SELECT hit FROM hits ORDER BY hit LIMIT 50")
def grep_lines(spark, d):
    return sources.grep(files(spark, d), "[0-9]{4}")[0]


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(lower(path), 'c1/.*7.*en') ORDER BY path LIMIT 50")
def name_search(spark, d):
    return sources.find_names(files(spark, d), "C1/*7*EN")[0]


@query(f"WITH {FILES} SELECT string_split(path, '/')[1] AS name, 'dir' AS type, sum(size)::BIGINT AS size FROM files GROUP BY 1")
def folder_listing(spark, d):
    return sources.list_dir(files(spark, d).select("path", "size"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'tsx' WHEN 3 THEN 'cpp' WHEN 4 THEN 'kotlin' ELSE 'unknown' END AS language FROM events")
def language_by_extension(spark, d):
    names = F.array(*map(F.lit, ("a.py", "b.RS", "c/d.Tsx", "e.hpp", "f.kts", "README")))
    return read(spark, d, "events").select("event_id", sources.language(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("language"))


# sinks and changes


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN start_line % 10 = 0 THEN 'new' ELSE language END AS language FROM chunks UNION ALL SELECT 'x' || id, 'new' FROM chunks WHERE start_line % 10 = 0")
def upsert_chunks(spark, d):
    c = chunks(spark, d).select("id", "language", "start_line")
    new = c.filter("start_line % 10 = 0").withColumn("language", F.lit("new"))
    return dml.upsert(c, new.unionByName(new.withColumn("id", F.concat(F.lit("x"), "id"))), ["id"]).select("id", "language")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_event_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("seq"))
    return dml.last_wins(e, ["user_id"], "seq").drop("seq")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE file_path IN (SELECT file_path FROM chunks WHERE language = 'de')")
def delete_stale(spark, d):
    c = chunks(spark, d)
    kept, _ = dml.delete_stale(c, c.select(F.col("id").alias("chunk_id")), c.filter("language = 'de'").select(F.col("file_path").alias("path")))
    return kept.select("id")


@query(f"WITH {GRAPH} SELECT edge_type, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE file_path IN ('nation/1', 'nation/2')) GROUP BY edge_type")
def delete_graph(spark, d):
    gone = spark.createDataFrame([("nation/1",), ("nation/2",)], "path string")
    return dml.delete_graph(nodes(spark, d), edges(spark, d), gone)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS chunk_id, round(list_sum(list_transform(embedding[1:70], lambda x: x::DOUBLE)), 4) AS total, 80 AS dims FROM embeddings")
def fit_dimensions(spark, d):
    v = vecs(spark, d).select("chunk_id", vectors.fit_dims(F.col("embedding"), 80).alias("v"))
    return v.select("chunk_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size("v").alias("dims"))


# filters and counts


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE language = 'fr' AND starts_with(lower(file_path), 'src1')")
def filtered_chunks(spark, d):
    return lookups.narrow(chunks(spark, d), "fr", "SRC1").select("id")


@query(f"WITH {CHUNKS}, {FILES} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT file_path) FROM chunks) AS paths")
def stored_counts(spark, d):
    c = chunks(spark, d)
    return lookups.counts(c, files(spark, d)).join(lookups.distinct_paths(c).agg(F.count(F.lit(1)).alias("paths")), how="cross")


# change detection


@query(f"WITH {FILES} SELECT path FROM files WHERE mtime % 3 = 0")
def changed_files(spark, d):
    f = files(spark, d).select("path", "mtime", "size", "hash")
    old = f.withColumn("hash", F.when(F.col("mtime") % 3 == 0, F.lit("?")).otherwise(F.col("hash")))
    return diff.changed(f, old).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE mtime % 3 <> 0")
def unchanged_files(spark, d):
    f = files(spark, d).select("path", "mtime", "size", "hash")
    return diff.unchanged(f, f.withColumn("size", F.when(F.col("mtime") % 3 == 0, F.lit(-1)).otherwise(F.col("size")))).select("path")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE start_line % 4 = 1")
def new_chunks(spark, d):
    c = chunks(spark, d).select("id", "content_hash", "start_line")
    return diff.new_chunks(c, c.withColumn("content_hash", F.when(F.col("start_line") % 4 == 1, F.lit("")).otherwise(F.col("content_hash")))).select("id")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE start_line % 2 = 1 AND file_path IN (SELECT file_path FROM chunks WHERE language = 'es')")
def removed_chunks(spark, d):
    c = chunks(spark, d)
    return diff.removed_chunks(c.filter("start_line % 2 = 0"), c, c.filter("language = 'es'").select(F.col("file_path").alias("path"))).select("id")


@query(f"WITH {FILES} SELECT path, mtime + 1 AS now_mtime, size AS now_size FROM files WHERE mtime % 6 = 0")
def catch_up(spark, d):
    f = files(spark, d).select("path", "mtime", "size")
    disk = f.filter("mtime % 4 <> 1").withColumn("mtime", F.when(F.col("mtime") % 6 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return diff.catch_up(f, disk)


# vector search

_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT v.vec_id AS chunk_id, v.label, round({_COS}, 6) AS score FROM embeddings v, (SELECT list_transform(range(64), lambda i: (i % 7 - 3)::DOUBLE) AS embedding) q ORDER BY {_COS} DESC, v.vec_id LIMIT 10")
def dense_knn(spark, d):
    return dense.knn(vecs(spark, d), [i % 7 - 3 for i in range(64)], 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id)::INTEGER AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {_COS} >= 0.1) WHERE rank <= 5")
def dense_knn_batch(spark, d):
    v = vecs(spark, d)
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return dense.knn_batch(v, q, 5, 0.1).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS} SELECT c.id AS chunk_id, c.file_path, round({_COS}, 6) AS score FROM embeddings v JOIN chunks c ON c.id = 'c' || v.vec_id, (SELECT list_transform(range(64), lambda i: (i % 5 - 2)::DOUBLE) AS embedding) q WHERE c.language = 'en' AND starts_with(c.file_path, 'src1') AND {_COS} >= 0 ORDER BY {_COS} DESC, c.id LIMIT 10")
def dense_search(spark, d):
    v = vecs(spark, d).select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "embedding")
    out = dense.search(chunks(spark, d), v, [i % 5 - 2 for i in range(64)], 10, 0.0, "en", "src1")
    return out.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


# lexical search

_TOK = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def stored_index(spark, d) -> sparse.Index:
    """The lexical index of the chunks, written once for an application and then read."""
    path = f"{scratch(spark)}/lexical-{zlib.crc32(d.encode()):08x}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lengths/_SUCCESS")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return sparse.load(spark, path)
    return sparse.store(sparse.index(chunks(spark, d)), path)


def _bm25(words: list[list[str]], relations: str = CHUNKS) -> str:
    """BM25 over symbol, content, path and language, with weights 10, 5, 2 and 1, as SQL over the CTE chunks."""
    fields = {"symbol": 10.0, "content": 5.0, "file_path": 2.0, "language": 1.0}
    lit = lambda w: "[" + ", ".join(f"'{t}'" for t in w) + "]"
    count = lambda f, w: f"len(list_filter(range(1, len({f}_t) + 1), lambda i: {f}_t[i:i + {len(w) - 1}] = {lit(w)}))"
    cells = ", ".join(" + ".join(f"{v} * {count(f, w)}" for f, v in fields.items()) + f" AS f{i}" for i, w in enumerate(words))
    toks = ", ".join(f"{_TOK.format(f)} AS {f}_t" for f in fields)
    idf = lambda i: f"greatest(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END, 0)"
    terms = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_ / avg_))" for i in range(len(words)))
    return f"""WITH {relations}, t AS (SELECT id, {toks} FROM chunks), f AS (SELECT id, {" + ".join(f"len({x}_t)" for x in fields)} AS len_, {cells} FROM t),
s AS (SELECT count(*) AS n, avg(len_) AS avg_, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(words)))} FROM f),
b AS (SELECT id, {terms} AS bm25 FROM f, s WHERE {" AND ".join(f"f{i} > 0" for i in range(len(words)))})"""


@query(_bm25([["license"], ["version"]]) + " SELECT id AS chunk_id, round(bm25 / (1 + bm25), 6) AS score FROM b")
def bm25_words(spark, d):
    return sparse.score(stored_index(spark, d), sparse.phrases(spark, "licénse version")).select("chunk_id", F.round("score", 6).alias("score"))


@query(_bm25([["mit", "license"]]) + " SELECT id AS chunk_id, round(bm25 / (1 + bm25), 6) AS score FROM b ORDER BY bm25 DESC, id LIMIT 10")
def bm25_phrase(spark, d):
    c = chunks(spark, d)
    return sparse.search(c, stored_index(spark, d), "(mit_license)*").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT id, round((contains(lower(content), 'under')::INTEGER + contains(lower(content), 'license')::INTEGER + (contains(lower(content), 'src2') OR contains(symbol, 'src2'))::INTEGER) / 3, 6) AS score FROM chunks WHERE contains(lower(content), 'under') OR contains(lower(content), 'license') OR contains(symbol, 'src2') OR contains(lower(content), 'src2') ORDER BY score DESC, id LIMIT 10")
def lexical_score(spark, d):
    return sparse.lexical(chunks(spark, d), "under license src2").select("id", F.round("score", 6).alias("score"))


@query("SELECT event_id, '\"' || event_type || '\" \"' || user_id || 'x\"' AS cleaned, CASE WHEN event_id % 2 = 0 THEN 'code that ' || event_type || ' it' ELSE 'a b ' || event_type END AS enriched FROM events")
def query_text(spark, d):
    e = read(spark, d, "events")
    raw = F.concat(F.lit("^("), "event_type", F.lit(")   *+"), F.col("user_id").cast("string"), F.lit("-x; \""))
    q = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(" it"))).otherwise(F.concat(F.lit("a b "), "event_type"))
    return e.select("event_id", text.sanitize(raw).alias("cleaned"), text.enrich_query(q).alias("enriched"))


@query(f"WITH {CHUNKS} SELECT id, sha256(language || ' | ' || file_path || ' |  | ' || symbol || chr(10) || content) AS digest FROM chunks")
def chunk_text(spark, d):
    made = text.enrich_chunk(*(F.col(c) for c in ("language", "file_path", "parent_context", "symbol", "content")))
    return chunks(spark, d).select("id", F.sha2(made, 256).alias("digest"))


# fusion


def two_lists(spark, d):
    base = chunks(spark, d).select(*fusion.KEY, "id", F.length("content").cast("double").alias("n"))
    a = fusion.ranked(base.withColumn("score", F.col("n")).orderBy(F.desc("score"), *fusion.KEY).limit(50))
    b = fusion.ranked(base.withColumn("score", -F.abs(F.col("n") - 20000)).orderBy(F.desc("score"), *fusion.KEY).limit(50))
    return a.drop("n"), b.drop("n")


_LISTS = f"""WITH {CHUNKS}, base AS (SELECT file_path, start_line, end_line, id, length(content)::DOUBLE AS n FROM chunks),
a AS (SELECT *, row_number() OVER (ORDER BY n DESC, file_path, start_line, end_line) AS rank FROM base QUALIFY rank <= 50),
b AS (SELECT *, row_number() OVER (ORDER BY -abs(n - 20000) DESC, file_path, start_line, end_line) AS rank FROM base QUALIFY rank <= 50),
f AS (SELECT file_path, start_line, end_line, min(id) AS id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3)"""


@query(_LISTS + " SELECT file_path, start_line, end_line, id, round(score, 6) AS score FROM f ORDER BY f.score DESC, 1, 2, 3 LIMIT 20")
def rank_fusion(spark, d):
    a, b = two_lists(spark, d)
    return fusion.rrf([a, b], 60, 20).withColumn("score", F.round("score", 6))


@query(_LISTS + """, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, file_path, start_line, end_line) AS rank FROM f), h AS (SELECT id, rank, rank % 3 AS s FROM r WHERE rank <= 12)
SELECT id, (CASE WHEN rank <= 12 THEN (SELECT count(*) FROM h x WHERE x.s > r.rank % 3 OR x.s = r.rank % 3 AND x.rank <= r.rank) ELSE rank END)::INTEGER AS rank FROM r WHERE rank <= 20""")
def reranked(spark, d):
    a, b = two_lists(spark, d)
    fused = fusion.ranked(fusion.rrf([a, b], 60, 20)).withColumn("content", F.col("rank").cast("string"))
    return fusion.rerank(fused, "q", 12, lambda _, docs: [int(x) % 3 for x in docs]).select("id", "rank")


@query(_LISTS + " SELECT * FROM (SELECT 'one' AS repo_name, id, n AS score FROM a UNION ALL SELECT 'two', id, -abs(n - 20000) + 15000 FROM b) ORDER BY score DESC, repo_name LIMIT 10")
def merged_workspaces(spark, d):
    base = chunks(spark, d).select(*fusion.KEY, "id", F.length("content").cast("double").alias("n"))
    return fusion.merge({"one": base.withColumn("score", F.col("n")), "two": base.withColumn("score", 15000 - F.abs(F.col("n") - 20000))}).select("repo_name", "id", "score")


# graph


@query(f"WITH {GRAPH} SELECT s.id, e.target_symbol, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id WHERE edge_type = 'call' GROUP BY 1, 2")
def graph_callers(spark, d):
    return graph.callers(nodes(spark, d), edges(spark, d)).groupBy("id", "target_symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH} SELECT s.id, s.file_path, t.symbol AS target_symbol FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.symbol = e.target_symbol WHERE edge_type = 'call' AND t.file_path = 'Brand#11'")
def graph_callers_of_file(spark, d):
    return graph.callers(nodes(spark, d), edges(spark, d), file="Brand#11").select("id", "file_path", "target_symbol")


@query(f"WITH {GRAPH} SELECT t.id, s.symbol AS source_symbol FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.symbol = e.target_symbol WHERE edge_type = 'call' AND s.file_path = 'nation/3'")
def graph_callees(spark, d):
    return graph.callees(nodes(spark, d), edges(spark, d), file="nation/3").select("id", "source_symbol")


@query(f"WITH {GRAPH} SELECT s.id, e.target_symbol, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.symbol = e.target_symbol WHERE edge_type IN ('import', 'extends', 'reference') GROUP BY 1, 2")
def graph_dependents(spark, d):
    return graph.dependents(nodes(spark, d), edges(spark, d), counted=True).groupBy("id", "target_symbol").agg(F.sum("n").alias("n"))


@query(f"WITH {GRAPH} SELECT coalesce(t.id, 'ext:' || e.target_symbol) AS id, coalesce(t.kind, 'external') AS kind, coalesce(t.file_path, '') AS file_path, s.symbol AS source_symbol FROM edges e JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.symbol = e.target_symbol WHERE edge_type = 'import'")
def graph_imports(spark, d):
    return graph.imports(nodes(spark, d), edges(spark, d)).select("id", "kind", "file_path", "source_symbol")


@query(f"WITH {GRAPH}, f AS (SELECT DISTINCT ON (s.rowid_) s.* FROM (SELECT row_number() OVER () AS rowid_, s.id, s.symbol, s.file_path FROM edges e JOIN nodes s ON s.id = e.source_id WHERE edge_type = 'call' AND target_symbol = 'part_7') s), r AS (SELECT *, row_number() OVER (ORDER BY file_path, id) AS i FROM f) SELECT 'c_' || id AS id, round(1.0 / i, 6)::DOUBLE AS score FROM r WHERE id NOT LIKE '%3' ORDER BY score DESC, id LIMIT 10")
def graph_search(spark, d):
    n = nodes(spark, d)
    fake = n.filter("id not like '%3'").select(F.concat(F.lit("c_"), "id").alias("id"), "symbol", "file_path", "kind", F.lit(1).alias("start_line"))
    return graph.search(n, edges(spark, d), fake, "Who calls part_7?").select("id", F.round("score", 6).alias("score"))


_ROUTED = ["'who calls ' || event_type", "'Callers of  ' || event_type", "'what depends on ' || event_type", "'dependents of ' || event_type", "'imports of ' || event_type", "'what does ' || event_type || ' import'", "'find ' || event_type"]


@query("SELECT event_id, ['callers', 'callers', 'dependents', 'dependents', 'imports', 'imports', NULL][event_id % 7 + 1] AS kind, CASE WHEN event_id % 7 = 6 THEN NULL ELSE event_type END AS symbol, CASE WHEN event_id % 7 = 6 THEN 'hybrid' ELSE 'graph' END AS route FROM events")
def routed_queries(spark, d):
    q = F.get(F.array(*map(F.expr, _ROUTED)), (F.col("event_id") % 7).cast("int"))
    return read(spark, d, "events").select("event_id", graph.route(q).alias("r")).select("event_id", "r.kind", "r.symbol", "r.route")


@query(f"WITH {CHUNKS} SELECT symbol, arg_min(id, (start_line, id)) AS id, min(start_line) AS start_line FROM chunks GROUP BY symbol")
def first_chunks(spark, d):
    c = chunks(spark, d).withColumn("file_path", F.lit("f"))
    n = c.select(F.col("symbol").alias("id"), "symbol", "kind", "file_path").distinct()
    return graph.first_chunks(n, c).select("symbol", "id", "start_line")


@query("""WITH n AS (SELECT doc_id AS id, source AS file_path, (doc_id * 37) % 9000 AS s, (doc_id * 37) % 9000 + n_chars AS e FROM documents), p AS (SELECT event_id, 'src' || (user_id % 20) AS file_path, (event_id * 13) % 12000 AS pos FROM events)
SELECT p.event_id, coalesce(arg_min(n.id::VARCHAR, (n.e - n.s, n.id::VARCHAR)), sha256(p.file_path)) AS source_id FROM p LEFT JOIN n ON n.file_path = p.file_path AND p.pos BETWEEN n.s AND n.e GROUP BY p.event_id, p.file_path""")
def enclosing_nodes(spark, d):
    n = read(spark, d, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").cast("string").alias("id"), ((F.col("doc_id") * 37) % 9000).alias("start"), ((F.col("doc_id") * 37) % 9000 + F.col("n_chars")).alias("end"))
    p = read(spark, d, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("file_path"), ((F.col("event_id") * 13) % 12000).alias("pos"))
    return graph.enclosing(p, n).select("event_id", "source_id")


@query(f"WITH {CHUNKS} SELECT c.id, arg_min('/repo/' || p.file_path, (p.start_line, '/repo/' || p.file_path)) AS pending_path FROM chunks c JOIN chunks p ON p.start_line % 9 = 0 AND ends_with('/repo/' || p.file_path, '/' || c.file_path) GROUP BY c.id")
def stale_results(spark, d):
    c = chunks(spark, d)
    pending = c.filter("start_line % 9 = 0").select(F.concat(F.lit("/repo/"), "file_path").alias("path"), F.col("start_line").alias("since"))
    return graph.stale(c, pending).select("id", "pending_path")


# chunking


@query(f"""WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files WHERE content <> ''), c AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM l)
SELECT path AS file_path, (s * 5 + 1)::INTEGER AS start_line, least(s * 5 + 7, len(l))::INTEGER AS end_line, sha256(array_to_string(l[s * 5 + 1:s * 5 + 7], chr(10))) AS content_hash
FROM (SELECT path, l, unnest(range(0, greatest((len(l) - 2 + 4) // 5, 1))) AS s FROM c) WHERE trim(array_to_string(l[s * 5 + 1:s * 5 + 7], '')) <> ''""")
def line_windows(spark, d):
    return chunking.line_windows(files(spark, d), 7, 2).select("file_path", "start_line", "end_line", "content_hash")


@query(f"""WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files), r AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM l)
SELECT path, i::INTEGER AS line, (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: strlen(x) + 1)), 0))::BIGINT AS byte_start, (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: strlen(x) + 1)), 0) + strlen(l[i]))::BIGINT AS byte_end FROM r WHERE NOT (i = len(l) AND l[i] = '')""")
def line_offsets(spark, d):
    return chunking.line_offsets(files(spark, d))


# evaluation


def rankings(spark, d):
    docs = read(spark, d, "documents")
    r = docs.select((F.col("doc_id") % 40).cast("int").alias("query_id"), F.concat(F.lit("f"), (F.col("doc_id") % 17).cast("string")).alias("file_path"), ((F.col("doc_id") * 31) % 97 / 97.0 - 0.2).alias("score"))
    return evaluation.best_per_file(r)


def judged(spark, d):
    return read(spark, d, "labels").select((F.col("doc_id") % 45).cast("int").alias("query_id"), F.concat(F.lit("f"), (F.col("doc_id") % 23).cast("string")).alias("doc"), (F.col("quality") * (F.col("doc_id") % 4)).cast("int").alias("grade"))


_RANK = """r AS (SELECT (doc_id % 40)::INTEGER AS query_id, 'f' || (doc_id % 17) AS doc, greatest(max((doc_id * 31) % 97 / 97.0::DOUBLE - 0.2), 0.0) AS score FROM documents GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INTEGER AS rank FROM r),
j AS (SELECT (doc_id % 45)::INTEGER AS query_id, 'f' || (doc_id % 23) AS doc, max(quality * (doc_id % 4))::INTEGER AS grade FROM labels GROUP BY 1, 2)"""


@query(f"WITH {_RANK} SELECT query_id, doc, round(score, 6) AS score, rank FROM k")
def best_per_file(spark, d):
    return rankings(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH {_RANK}, q AS (SELECT DISTINCT query_id FROM j), m AS (SELECT k.query_id, k.rank, coalesce(j.grade, 0) AS grade FROM k LEFT JOIN j USING (query_id, doc)),
f AS (SELECT query_id, count(*) FILTER (grade >= 1 AND rank <= 5) AS h5, count(*) FILTER (grade >= 1 AND rank <= 10) AS h10, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS dcg, min(rank) FILTER (grade >= 1) AS first_ FROM m GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc) AS i FROM j), i AS (SELECT query_id, sum(grade / log2(i + 1)) FILTER (i <= 10) AS ideal, count(*) FILTER (grade >= 1) AS n FROM o GROUP BY 1)
SELECT query_id, round(coalesce(h5 / nullif(n, 0), 0), 6)::DOUBLE AS recall_at_5, round(coalesce(h10 / nullif(n, 0), 0), 6)::DOUBLE AS recall_at_10, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg_at_10, round(coalesce(1.0 / first_, 0), 6)::DOUBLE AS mrr FROM q LEFT JOIN f USING (query_id) LEFT JOIN i USING (query_id)""")
def ranking_metrics(spark, d):
    j = judged(spark, d)
    out = evaluation.metrics(rankings(spark, d), j, j.select("query_id"))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"""WITH {_RANK}, e AS (SELECT query_id, doc FROM j WHERE grade >= 1), h AS (SELECT k.query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM k JOIN e USING (query_id, doc) GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1)
SELECT q.query_id, round(coalesce(h5 / n, 0), 6)::DOUBLE AS symbol_recall_at_5, round(coalesce(h10 / n, 0), 6)::DOUBLE AS symbol_recall_at_10, round(coalesce(h5 / 5, 0), 6)::DOUBLE AS symbol_precision_at_5 FROM (SELECT DISTINCT query_id FROM k) q LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)""")
def symbol_metrics(spark, d):
    r, j = rankings(spark, d), judged(spark, d)
    out = evaluation.symbol_metrics(r.select("query_id", F.col("doc").alias("key"), "rank"), j.groupBy("query_id", F.col("doc").alias("key")).agg(F.max("grade").alias("grade")), r)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[round((count(*) - 1) * 0.95)::INTEGER + 1] AS p95_rounded FROM events GROUP BY event_type")
def percentiles(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(stats.percentile_nearest("value", 0.5).alias("p50"), stats.percentile_nearest("value", 0.95).alias("p95"), stats.percentile_rounded("value", 0.95).alias("p95_rounded"))


# gates


@query("""WITH m AS (SELECT * FROM (VALUES ('mrr', 0.5, 0.505), ('ndcg_at_10', 0.5, 0.52), ('recall_at_5', 0.3, NULL), ('indexing_secs', 14.9, 10.0), ('peak_rss_bytes', 120.0, 100.0), ('query_p95_ms', 3.0, 0.0), ('disk_size_bytes', 1.0, 9.0), ('extra', NULL, 1.0)) t(name, c, b))
SELECT name, c::DOUBLE AS current, b::DOUBLE AS baseline, round(c - b, 6)::DOUBLE AS delta, CASE name WHEN 'mrr' THEN 'pass' WHEN 'indexing_secs' THEN 'pass' WHEN 'disk_size_bytes' THEN 'pass' ELSE 'regress' END AS status FROM m""")
def baseline_gate(spark, d):
    now = records.metric_rows(spark, {"mrr": 0.5, "ndcg_at_10": 0.5, "recall_at_5": 0.3, "indexing_secs": 14.9, "peak_rss_bytes": 120, "query_p95_ms": 3, "disk_size_bytes": 1})
    old = records.metric_rows(spark, {"mrr": 0.505, "ndcg_at_10": 0.52, "indexing_secs": 10, "peak_rss_bytes": 100, "query_p95_ms": 0, "disk_size_bytes": 9, "extra": 1})
    return gate.compare(now, old, gate.tolerances(spark)).withColumn("delta", F.round("delta", 6))


@query("""SELECT s_suppkey AS candidate, ((s_suppkey % 10) > 6)::INTEGER + (s_acctbal > 5000)::INTEGER + (s_nationkey > 20)::INTEGER AS n_reasons, CASE WHEN (s_suppkey % 10) > 6 OR s_acctbal > 5000 OR s_nationkey > 20 THEN 'stay' ELSE 'migrate' END AS verdict FROM supplier""")
def backend_verdicts(spark, d):
    report = lambda secs, rss, slo: F.struct(secs.cast("double").alias("indexing_secs"), rss.cast("double").alias("peak_rss_bytes"), F.lit(1.0).alias("disk_size_bytes"), F.lit(0.0).alias("query_p95_ms"), slo.alias("slo_passed"), F.lit(360).alias("slo_limit_secs"))
    s = read(spark, d, "supplier").select("s_suppkey", report(F.lit(9.0), F.lit(5000 / 1.2), F.lit(True)).alias("incumbent"), report(F.col("s_suppkey") % 10, F.col("s_acctbal"), F.col("s_nationkey") <= 20).alias("candidate"))
    out = gate.migration_reasons(s)
    return out.select(F.col("s_suppkey").alias("candidate"), F.size("reasons").alias("n_reasons"), "verdict")


# experiments


@query(f"WITH {TRIALS} SELECT corpus, task_id, model, arm, count(*) AS trials, round(avg(success::INTEGER), 6) AS tsr, round(avg(correctness), 6) AS mcs, round(avg(tokens), 3) AS mean_tokens, round(avg(steps), 6) AS mean_steps, round(avg(correctness * ln(1 + 1 / greatest(tokens, 1.0)) * success::INTEGER), 9) AS aei FROM trials GROUP BY ALL")
def trial_groups(spark, d):
    g = experiments.groups(trials(spark, d))
    return g.select("corpus", "task_id", "model", "arm", "trials", *(F.round(c, 6).alias(c) for c in ("tsr", "mcs")), F.round("mean_tokens", 3).alias("mean_tokens"), F.round("mean_steps", 6).alias("mean_steps"), F.round("aei", 9).alias("aei"))


@query(f"WITH {TRIALS} SELECT corpus, round(avg(tokens) FILTER (arm = 'traditional') / avg(tokens) FILTER (arm = 'tool'), 6) AS ter, round(avg(steps) FILTER (arm = 'traditional') / avg(steps) FILTER (arm = 'tool'), 6) AS ser FROM trials GROUP BY corpus")
def efficiency_ratios(spark, d):
    return experiments.ratios(trials(spark, d)).select("corpus", F.round("ter", 6).alias("ter"), F.round("ser", 6).alias("ser"))


_PAIRS = f"""WITH {TRIALS}, n AS (SELECT *, row_number() OVER (PARTITION BY corpus, task_id, model, arm ORDER BY repetition) AS n FROM trials),
p AS (SELECT a.corpus, a.task_id, a.model, m.* FROM n a JOIN n b USING (corpus, task_id, model, n), LATERAL (VALUES ('correctness', a.correctness, b.correctness), ('tokens', a.tokens::DOUBLE, b.tokens::DOUBLE), ('steps', a.steps::DOUBLE, b.steps::DOUBLE)) m(metric, x, y) WHERE a.arm = 'tool' AND b.arm = 'traditional')"""


@query(_PAIRS + """, z AS (SELECT *, x - y AS d FROM p WHERE x <> y), r AS (SELECT *, rank() OVER (PARTITION BY corpus, task_id, model, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY corpus, task_id, model, metric, abs(d)) - 1) / 2 AS r FROM z),
w AS (SELECT corpus, task_id, model, metric, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r GROUP BY ALL),
e AS (SELECT corpus, task_id, model, metric, count(*) AS pairs, CASE WHEN count(*) > 1 THEN (avg(x) - avg(y)) / greatest(sqrt((var_pop(x) * (count(*) - 1) + var_pop(y) * (count(*) - 1)) / (2 * count(*) - 2)), 1e-10) ELSE 0 END AS effect FROM p GROUP BY ALL)
SELECT e.corpus, e.task_id, e.model, e.metric, coalesce(w.n, 0) AS n, round(coalesce(w.w, 0), 6)::DOUBLE AS statistic, round(e.effect, 6) AS effect_size FROM e LEFT JOIN w USING (corpus, task_id, model, metric)""")
def paired_tests(spark, d):
    c = experiments.compare(trials(spark, d))
    return c.select("corpus", "task_id", "model", "metric", "n", F.round("statistic", 6).alias("statistic"), F.round("effect_size", 6).alias("effect_size"))


@query()
def hypotheses(spark, d):
    tasks = spark.range(12).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"), (F.col("id") % 5 + 1).cast("int").alias("difficulty"))
    return experiments.hypotheses(trials(spark, d), tasks)


@query(f"WITH {TRIALS}, s AS (SELECT task_id, corpus, avg(correctness) AS s FROM trials WHERE corpus <> '5-LOW' OR task_id <> 't1' GROUP BY 1, 2), r AS (SELECT DISTINCT corpus, length(corpus)::DOUBLE AS w FROM trials) SELECT t.task_id, round(sum(coalesce(s, 0) * w) / sum(w), 4) AS score FROM (SELECT DISTINCT task_id FROM s) t CROSS JOIN r LEFT JOIN s ON s.task_id = t.task_id AND s.corpus = r.corpus GROUP BY 1")
def rubric_scores(spark, d):
    t = trials(spark, d)
    scores = t.filter("corpus <> '5-LOW' OR task_id <> 't1'").groupBy("task_id", F.col("corpus").alias("criterion")).agg(F.avg("correctness").alias("score"))
    rubric = t.select(F.col("corpus").alias("criterion"), F.length("corpus").cast("double").alias("weight")).distinct()
    return experiments.rubric_score(scores, rubric, ["task_id"])


@query()
def bootstrap_means(spark, d):
    e = read(spark, d, "supplier").select("s_nationkey", "s_acctbal")
    return stats.bootstrap(e, ["s_nationkey"], "s_acctbal", 200)


# change streams, in batch form


@query(f"WITH {CHANGES} SELECT path, arg_max(is_removal, (ts, is_removal)) AS is_removal, max(ts) AS ts FROM changes GROUP BY path")
def latest_changes(spark, d):
    return streams.latest(change_rows(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {CHANGES}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM changes), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT path, count(*) AS changes, min(ts) AS first, max(ts) AS last FROM s GROUP BY path, s.s""")
def debounced_changes(spark, d):
    b = streams.debounce(change_rows(spark, d), "2 hours")
    return b.select("path", "changes", F.col("start").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query()
def mock_embeddings(spark, d):
    e = vectors.mock_embedder(16)
    return read(spark, d, "benchmark").select("item_id", e("text").alias("embedding"))


@query("SELECT event_id, ['a', user_id::VARCHAR] AS items FROM events")
def coerced_arrays(spark, d):
    e = read(spark, d, "events")
    plain = F.to_json(F.array(F.lit("a"), F.col("user_id").cast("string")))
    quoted = F.to_json(F.array(plain))
    return e.select("event_id", records.coerce_array(F.when(F.col("event_id") % 2 == 0, plain).otherwise(F.substring(quoted, 2, 1 << 20).substr(F.lit(1), F.length(quoted) - 2))).alias("items"))


@query("SELECT count(*) AS chunks, count(*) AS files, count(*) - 1 AS chunks_stored, true AS drift FROM documents")
def status_drift(spark, d):
    c = chunks(spark, d)
    meta = c.agg((F.count(F.lit(1)) - 1).alias("chunks_stored"), F.count(F.lit(1)).alias("files_indexed"))
    return lookups.status(meta, c, files(spark, d)).select("chunks", "files", "chunks_stored", "drift")


@query(f"""WITH {TRIALS}, g AS (SELECT corpus, task_id, model, arm, avg(correctness * ln(1 + 1 / greatest(tokens, 1.0)) * success::INTEGER) AS aei FROM trials GROUP BY ALL)
SELECT corpus, task_id, model, arm, (substr(task_id, 2)::INTEGER % 6)::INTEGER AS difficulty, round(CASE WHEN substr(task_id, 2)::INTEGER % 6 = 0 THEN 0 ELSE aei / (substr(task_id, 2)::INTEGER % 6) END, 9) AS dae FROM g""")
def adjusted_efficiency(spark, d):
    tasks = spark.range(12).filter("id % 6 <> 0").select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"), (F.col("id") % 6).cast("int").alias("difficulty"))
    return experiments.adjusted(experiments.groups(trials(spark, d)), tasks).select("corpus", "task_id", "model", "arm", "difficulty", F.round("dae", 9).alias("dae"))


@query("""SELECT m.m AS model, r.r::INTEGER AS repetition, a.a AS arm, CASE WHEN (r.r % 2 = 1) = (a.a = 'tool') THEN 0 ELSE 1 END AS arm_order, 't' || (n_nationkey) AS task_id FROM nation, (VALUES ('x'), ('y')) m(m), range(1, 4) r(r), (VALUES ('tool'), ('traditional')) a(a)""")
def trial_design(spark, d):
    return experiments.design(spark, ["x", "y"], 3, [f"t{r.n_nationkey}" for r in read(spark, d, "nation").collect()])


@query("SELECT o_orderpriority AS hypothesis, max(CASE WHEN o_orderstatus = 'F' THEN 'supported' END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN 'not supported' END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN 'not supported' END) AS P FROM orders GROUP BY 1")
def verdict_summary(spark, d):
    v = read(spark, d, "orders").select(F.col("o_orderstatus").alias("corpus"), F.col("o_orderpriority").alias("hypothesis"), (F.col("o_orderstatus") == "F").alias("supported")).distinct()
    return experiments.summary(v)


@query(f"WITH {CHANGES}, l AS (SELECT path, arg_max(is_removal, (ts, is_removal)) AS r FROM changes GROUP BY path) SELECT path, r AS removed FROM l")
def change_split(spark, d):
    gone, touched = streams.split(change_rows(spark, d))
    return gone.withColumn("removed", F.lit(True)).unionByName(touched.withColumn("removed", F.lit(False)))


@query(f"WITH {GRAPH} SELECT coalesce(t.file_path, '') || '::' || coalesce(t.symbol, e.target_symbol) AS key, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.symbol = e.target_symbol WHERE edge_type = 'import' AND s.symbol = 'supplier_7' GROUP BY 1")
def structural_keys(spark, d):
    return evaluation.structural(nodes(spark, d), edges(spark, d), "imports", "supplier_7", 1).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(avg(recall_at_5), 4) AS recall_at_5, round(avg(recall_at_10), 4) AS recall_at_10, round(avg(ndcg_at_10), 4) AS ndcg_at_10, round(avg(mrr), 4) AS mrr FROM ({SQL['ranking_metrics']})")
def mean_metrics(spark, d):
    out = evaluation.aggregate(ranking_metrics(spark, d))
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query(f"WITH {TRIALS} SELECT task_id, repetition, len(list_distinct(['t' || (repetition % 3), 't' || (steps % 3), 't' || (tokens % 2)]))::INTEGER AS unique_tools FROM trials")
def unique_tools(spark, d):
    name = lambda c, n: F.struct(F.concat(F.lit("t"), (F.col(c) % n).cast("string")).alias("name"))
    t = trials(spark, d).withColumn("tool_calls", F.array(name("repetition", 3), name("steps", 3), name("tokens", 2)))
    return experiments.flat(t).select("task_id", "repetition", "unique_tools")


# the index pipeline and searches over it, end to end

#: Chunks of a tree of plain text files: windows of 50 lines that step by 40.
_WINDOWS = """l AS (SELECT path, string_split(content, chr(10)) AS l FROM {0} WHERE content <> ''), c AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM l),
w AS (SELECT path AS file_path, (s * 40 + 1)::INTEGER AS start_line, least(s * 40 + 50, len(l))::INTEGER AS end_line, sha256(array_to_string(l[s * 40 + 1:s * 40 + 50], chr(10))) AS content_hash
  FROM (SELECT path, l, unnest(range(0, greatest((len(l) - 10 + 39) // 40, 1))) AS s FROM c) WHERE trim(array_to_string(l[s * 40 + 1:s * 40 + 50], '')) <> '')"""
_TREE = "tree AS (SELECT source || '/' || doc_id || '.txt' AS path, text AS content, doc_id FROM documents)"
_LATER = "later AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN content || chr(10) || 'one more line' ELSE content END AS content FROM tree WHERE doc_id % 10 <> 1)"


def tree(spark, d):
    """Documents as plain text files: path, size, mtime, content bytes."""
    text_ = F.col("text").cast("binary")
    return read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length(text_).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), text_.alias("content"), "doc_id")


def new_store(spark) -> indexing.Store:
    return indexing.Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex[:12]}")


@query(f"WITH {_TREE}, {_WINDOWS.format('tree')} SELECT file_path, start_line, end_line, content_hash FROM w")
def index_full(spark, d):
    store = new_store(spark)
    indexing.index(store, tree(spark, d).drop("doc_id"), dims=4, now=1)
    return store.read("chunks").select("file_path", "start_line", "end_line", "content_hash")


@query(f"WITH {_TREE}, {_LATER}, {_WINDOWS.format('later')} SELECT file_path, start_line, end_line, content_hash FROM w")
def index_changes(spark, d):
    """The chunks after an incremental run over changed files and the removal of others."""
    store, files_ = new_store(spark), tree(spark, d)
    indexing.index(store, files_.drop("doc_id"), dims=4, now=1)
    longer = F.concat("content", F.lit("\none more line").cast("binary"))
    changed = files_.filter("doc_id % 10 = 0").select("path", F.octet_length(longer).cast("long").alias("size"), F.lit(2).cast("long").alias("mtime"), longer.alias("content"))
    indexing.index(store, changed, dims=4, now=2, delete_stale=False)
    indexing.remove(store, files_.filter("doc_id % 10 = 1").select("path"))
    return store.read("chunks").select("file_path", "start_line", "end_line", "content_hash")


@query(f"WITH {_TREE} SELECT path, (1 + (doc_id % 10 = 0)::INTEGER)::BIGINT AS mtime, (strlen(content) + CASE WHEN doc_id % 10 = 0 THEN 14 ELSE 0 END)::BIGINT AS size, (1 + (doc_id % 10 = 0)::INTEGER)::BIGINT AS indexed_at FROM tree WHERE doc_id % 10 <> 1")
def index_records(spark, d):
    """File records after full indexing, an incremental run and a run without the removed files."""
    store, files_ = new_store(spark), tree(spark, d)
    indexing.index(store, files_.drop("doc_id"), dims=4, now=1)
    longer = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("\none more line").cast("binary"))).otherwise(F.col("content"))
    later = files_.filter("doc_id % 10 <> 1").select("path", F.octet_length(longer).cast("long").alias("size"), (F.lit(1) + (F.col("doc_id") % 10 == 0).cast("int")).cast("long").alias("mtime"), longer.alias("content"))
    indexing.index(store, later, dims=4, now=2)
    return store.read("files").select("path", "mtime", "size", "indexed_at")


@query(f"WITH {_TREE}, {_WINDOWS.format('tree')}, n AS (SELECT file_path AS path, count(*) AS chunks FROM w GROUP BY 1) SELECT tree.path, coalesce(n.chunks, 0)::BIGINT AS chunks, coalesce(n.chunks, 0)::BIGINT AS new_chunks FROM tree LEFT JOIN n USING (path)")
def index_report(spark, d):
    return indexing.index(new_store(spark), tree(spark, d).drop("doc_id"), dims=4, now=1).per_file


_CHANGED = CHUNKS.replace("FROM documents", "FROM documents WHERE doc_id % 3 <> 0").replace("text AS content", "CASE WHEN doc_id % 3 = 1 THEN text || ' license version' ELSE text END AS content")


@query(_bm25([["license"], ["version"]], _CHANGED) + " SELECT id AS chunk_id, round(bm25 / (1 + bm25), 6) AS score FROM b")
def bm25_refreshed(spark, d):
    """Scores after chunks changed and went: only their postings are made anew."""
    c = chunks(spark, d)
    changed = c.filter("start_line % 3 = 1").withColumn("content", F.concat("content", F.lit(" license version")))
    idx = sparse.refresh(stored_index(spark, d), changed, c.filter("start_line % 3 = 0").select("id"))
    return sparse.score(idx, sparse.phrases(spark, "license version")).select("chunk_id", F.round("score", 6).alias("score"))


_LEGS = _bm25([["license"], ["version"]]) + f""", v AS (SELECT vec_id, embedding FROM embeddings),
dv AS (SELECT 'c' || vec_id AS id, list_inner_product(embedding::DOUBLE[], {[float(i % 5 - 2) for i in range(64)]}::DOUBLE[]) / nullif(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt({sum((i % 5 - 2) ** 2 for i in range(64))}), 0) AS near FROM v ORDER BY near DESC NULLS LAST, id LIMIT 10),
dn AS (SELECT c.id, c.file_path, c.start_line, c.end_line, row_number() OVER (ORDER BY near DESC, file_path, start_line, end_line) AS rank FROM dv JOIN chunks c USING (id)),
sp AS (SELECT c.id, c.file_path, c.start_line, c.end_line, row_number() OVER (ORDER BY bm25 DESC, b.id) AS rank FROM b JOIN chunks c USING (id) QUALIFY rank <= 10),
fu AS (SELECT file_path, start_line, end_line, min(id) AS id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM sp) GROUP BY 1, 2, 3)"""


def workspace(spark, d) -> search.Workspace:
    v = vecs(spark, d).select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "embedding")
    return search.Workspace(chunks(spark, d), v, stored_index(spark, d), nodes(spark, d), edges(spark, d), lambda _: [[i % 5 - 2 for i in range(64)]])


@query(_LEGS + " SELECT id, round(score, 6) AS score FROM fu ORDER BY fu.score DESC, file_path, start_line, end_line LIMIT 10")
def hybrid_search(spark, d):
    """One workspace, both legs, fused."""
    found = search.search({"w": workspace(spark, d)}, "license version", search.Options(mode="hybrid", threshold=-1.0))
    return found.select(F.coalesce("id", "chunk_id").alias("id") if "id" in found.columns else F.col("chunk_id").alias("id"), F.round("score", 6).alias("score"))


@query(_LEGS + """, two AS (SELECT r.repo_name, sp.*, row_number() OVER (ORDER BY sp.rank, r.repo_name) AS place FROM sp, (VALUES ('a'), ('b')) r(repo_name) QUALIFY place <= 10)
SELECT repo_name, id, place::INTEGER AS place FROM two""")
def workspaces_search(spark, d):
    """Two workspaces with the same chunks, lexical search, merged by score."""
    w = workspace(spark, d)
    found = search.search({"a": w, "b": w}, "license version", search.Options(mode="sparse"))
    return fusion.ranked(found, tie=[*sparse.order(), "repo_name"]).select("repo_name", F.col("chunk_id").alias("id"), F.col("rank").alias("place"))


@query("SELECT 'c' || vec_id AS chunk_id, list_resize(list_transform(embedding, lambda x: x::DOUBLE), 70, 0.0) AS embedding FROM embeddings")
def upsert_vectors(spark, d):
    """Vectors replaced by themselves, padded to 70 numbers."""
    v = vecs(spark, d).select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "embedding")
    return dml.upsert_vectors(v.withColumn("embedding", F.slice("embedding", 1, 3)), v, 70).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"WITH {GRAPH} SELECT 'node' AS kind, id AS key, 1::BIGINT AS n FROM nodes UNION ALL SELECT 'edge', source_id, 2 * count(*) FROM edges GROUP BY source_id")
def insert_graph(spark, d):
    """Nodes and edges inserted twice: nodes are upserted, edges are a bag."""
    n, e = nodes(spark, d), edges(spark, d)
    n2, e2 = dml.insert_graph(n, e, n, e)
    return n2.groupBy(F.lit("node").alias("kind"), F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n")).unionByName(e2.groupBy(F.lit("edge").alias("kind"), F.col("source_id").alias("key")).agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM chunks WHERE file_path NOT LIKE 'src1/%') AS chunks, (SELECT count(*) FROM chunks JOIN embeddings ON id = 'c' || vec_id WHERE file_path NOT LIKE 'src1/%') + (SELECT count(*) FROM embeddings WHERE 'c' || vec_id NOT IN (SELECT id FROM chunks)) AS vectors")
def delete_by_file(spark, d):
    c = chunks(spark, d)
    v = vecs(spark, d).select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "embedding")
    paths = c.filter("file_path like 'src1/%'").select(F.col("file_path").alias("path")).distinct()
    left, vectors_, _ = dml.delete_files(c, v, files(spark, d), paths)
    return left.agg(F.count(F.lit(1)).alias("chunks")).join(vectors_.agg(F.count(F.lit(1)).alias("vectors")), how="cross")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval over a batch of queries: vector and lexical ranks fused per query."""
    v = vecs(spark, d)
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    near = dense.knn_batch(v, q, 20)
    # all of a label score alike, so its first 20 are found once and then joined to its queries
    label = v.select("chunk_id", "label")
    first = fusion.ranked(label.withColumn("score", F.lit(1.0)), ["label"], ["chunk_id"]).filter("rank <= 20")
    asked = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    listed = asked.join(first, "label").select("query_id", "chunk_id", "score", "rank")
    return fusion.rrf([near, listed], by=["query_id"], key=["chunk_id"]).withColumn("score", F.round("score", 6))


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20),
same AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM same) GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, chunk_id) <= 10""")
def hybrid_batch(spark, d):
    return flagship(spark, d)
