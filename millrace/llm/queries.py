"""The operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, katz, language, licenses, linedup, neardup, packing, quality, topk, warc
from millrace.llm import pipeline as stages
from millrace.llm.common import held_out, remainder, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit_documents(docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(False))
    scored = katz.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), "text"))
    return scored.withColumn("held_out", held_out(F.col("doc_id"), 7))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    chosen = quality.sample(labels, remainder(F.col("doc_id"), 4) != 2)
    model = quality.fit(docs.join(F.broadcast(chosen), "doc_id"))  # at most quality.SAMPLE rows
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.strip(docs).select("doc_id", "n_lines", F.size("drops").alias("n_dropped"), F.array_join("drops", ",").alias("drops"), "text")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("text_key")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_katz_lm, op4_exact_topk, op5_decontamination, op6_quality, op7_line_dedup, op8_near_duplicates, op9_warc, op10_packing, pipeline)}


#: Whole numbers as HUGEINT, so that no product or sum is rounded; scores beyond a long count as its ends.
TOPK_SQL = """
WITH n AS (SELECT row_number() OVER () AS r, * FROM embeddings),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM n
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: coalesce(x[1] * x[2], 0))) AS x FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
s AS (SELECT r, query_id, vec_id, greatest(least(coalesce(x, 0), 9223372036854775807), -9223372036854775807)::BIGINT AS score FROM p)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


#: Every window of an item's length in every document that has any of its shingles, compared by multisets of shingle texts.
LEAKS_SQL = r"""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
u AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
i AS (SELECT id, least(len(w), 5) AS k, list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda x: array_to_string(w[x:x + least(len(w), 5) - 1], ' ')) AS s FROM u WHERE len(w) > 0),
d AS (SELECT id, k, list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' ')) AS s FROM t, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
p AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.k FROM (SELECT id, k, unnest(s) AS x FROM d) d JOIN (SELECT id, k, unnest(s) AS x FROM i) i ON d.k = i.k AND d.x = i.x),
a AS (SELECT doc_id, item_id, i.s AS b, len(i.s) AS n, d.s AS s, unnest(range(1 - len(i.s), len(d.s))) AS start FROM p JOIN d ON d.id = p.doc_id AND d.k = p.k JOIN i ON i.id = p.item_id),
w AS (SELECT doc_id, item_id, start, b, s[greatest(start, 0) + 1:least(start + n, len(s))] AS a FROM a),
c AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(a), b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS common FROM w WHERE len(list_intersect(a, b)) > 0),
j AS (SELECT doc_id, item_id, common / (len(a) + len(b) - common) AS similarity, start FROM c)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, greatest(arg_max(start, (similarity, -start)), 0)::INTEGER AS first_word FROM j WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

LINES_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, pos, list_filter(string_split(regexp_replace(regexp_replace(l[pos + 1], '[0-9]+', '0', 'g'), '[\\t\\v\\f\\r]', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS pos FROM d)),
g AS (SELECT doc_id, pos, len(t) >= {linedup.LIMITS.long} AS long, [-1, len(t)] AS j, t AS a, []::VARCHAR[] AS b FROM k WHERE len(t) >= {linedup.LIMITS.least}
  UNION ALL SELECT doc_id, pos, len(t) >= {linedup.LIMITS.long}, [j, len(t)], t[1:j * len(t) // {linedup.RUNS}], t[(j + 1) * len(t) // {linedup.RUNS} + 1:] FROM (SELECT *, unnest(range(0, {linedup.RUNS})) AS j FROM k WHERE len(t) >= {linedup.LIMITS.least})),
r AS (SELECT long, j, a, b, min(doc_id) AS first FROM g GROUP BY ALL HAVING count(DISTINCT doc_id) >= CASE WHEN long THEN 2 ELSE {linedup.LIMITS.often} END),
x AS (SELECT doc_id, list_sort(list(DISTINCT pos)) AS drops FROM g JOIN r USING (long, j, a, b) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, len(l)::INTEGER AS n_lines, coalesce(len(drops), 0)::INTEGER AS n_dropped, coalesce(array_to_string(drops, ','), '') AS drops,
  CASE WHEN drops IS NULL THEN text ELSE array_to_string([l[i + 1] for i in range(0, len(l)) if NOT list_contains(drops, i)], chr(10)) END AS text FROM d LEFT JOIN x USING (doc_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM s"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_license_scan": licenses.scan_sql(), "op4_exact_topk": TOPK_SQL, "op5_decontamination": LEAKS_SQL, "op7_line_dedup": LINES_SQL, "op9_warc": WARC_SQL}
    if stages.ORACLE_SQL:
        out["pipeline"] = stages.ORACLE_SQL
    return out
