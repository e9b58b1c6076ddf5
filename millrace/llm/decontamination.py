"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Benchmark items and documents are words and shingles (hashes) of five words; items of one to four words have one
shingle of all their words, looked for among the documents' runs of as many words. A window is as long as an item,
or what of it lies in the text, and can start at any word.

Documents without any shingle of an item drop out in the scan. In the others, windows of an item's length are laid at
every start from which they cover so many places with shingles of that item that the similarity is within reach. No
window that is similar enough is left out, whatever the order of an item's parts. Each window and each item gets a
64-bit SimHash of its shingles, weighted by their counts. Fingerprints are cut into ``RADIUS`` + 1 blocks: two within
the radius agree in a block, so an equi-join on (item, block number, block bits) finds every window within it.
Those are verified by the exact weighted similarity of their shingle multisets, sum of minima over sum of maxima. A
match is reported at the best window of a document and an item, the first of equal ones.

Case is folded for all letters (``common.lowered``). Null and empty texts and items have no shingles and match
nothing. Items and texts are taken whole. Rows with equal doc_id and text share their matches, null ids among them;
repeated items give equal matches. Empty tables give no matches. Other columns are ignored. A document costs its
length, and what its windows hold on top; only one with an item over and over has a window at nearly every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SHINGLE, SIMILARITY, let, materialize, release, words

#: At similarity 0.8 about 9.7 of the 64 bits differ, with a deviation of 2.9: beyond 24 lies a pair in two million.
RADIUS = 24
#: The most benchmark shingles that the document scan takes as a literal set, and that a join broadcasts.
LITERAL, BROADCAST = 20_000, 1_000_000


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of each ``size`` successive words; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprint(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the 64-bit SimHash of an array of hashes: bit b is set where most of them have it set.

    Lane l counts the bits l and l + 32 at once, 32 bits each.
    """
    mask = 0x0000000100000001
    add = lambda s: lambda a, x: a + F.shiftrightunsigned(x, s).bitwiseAND(F.lit(mask))
    lanes = [F.aggregate(column, F.lit(0).cast("long"), add(s)).alias(f"_l{s}") for s in range(32)]
    df = df.select("*", *lanes)
    bits = []
    for b in range(64):
        count = F.shiftrightunsigned(f"_l{b % 32}", b - b % 32).bitwiseAND(F.lit(0xFFFFFFFF))
        bits.append(F.when(count * 2 > F.size(column), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return df.withColumn(name, bits[0]).drop(*(f"_l{s}" for s in range(32)))


def blocks(mark: Column, radius: int = RADIUS) -> Column:
    """(block number, its bits) of a fingerprint, radius + 1 of them."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("v")) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))))


def similarity(a: Column, b: Column, plain: Column) -> Column:
    """Sum of minima over sum of maxima of two multisets given as arrays; ``plain``: b repeats nothing."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.array_intersect(a, b)
    both = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return both / (F.size(a) + F.size(b) - both)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, k, n, plain, shingles, mark) of each item with words; ``item`` is equal for equal words."""
    w = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    made = shingle_hashes(F.col("w"))
    for k in range(1, SHINGLE):
        made = F.when(F.size("w") == k, shingle_hashes(F.col("w"), k)).otherwise(made)
    rows = w.select("item_id", F.md5(F.array_join("w", " ").cast("binary")).alias("item"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), made.alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles")).withColumn("plain", F.size(F.array_distinct("shingles")) == F.col("n"))
    return fingerprint(rows, "shingles", "mark")


def holders(docs: DataFrame, index: DataFrame, k: int, n: int) -> DataFrame:
    """(key, doc_id, k, shingles) of the documents with any of the ``n`` shingles of ``k`` words in ``index``."""
    made = let(words(F.col("text")), lambda w: shingle_hashes(w, k))
    known = index.filter(F.col("k") == k).select("shingle").distinct()
    if n <= LITERAL:
        literals = [r.shingle for r in known.collect()]
        # a generator instead of a filter, which would be moved below and computed twice
        some = F.filter(F.array(made), lambda s: F.exists(s, lambda x: x.isin(literals)))
        return docs.select(row_key().alias("key"), "doc_id", F.lit(k).alias("k"), F.explode(some).alias("shingles"))
    rows = docs.select(row_key().alias("key"), "doc_id", F.lit(k).alias("k"), made.alias("shingles"))
    some = rows.select("key", F.explode("shingles").alias("shingle")).join(F.broadcast(known) if n <= BROADCAST else known, "shingle", "left_semi")
    return rows.join(some.select("key").distinct(), "key", "left_semi")


def starts(at: Column, n: Column, length: Column, least: float) -> Column:
    """Every start of a window of ``n`` shingles that covers enough of the places ``at`` (ascending).

    A whole window needs 2s / (1 + s) of n for similarity s, one that the text's edge cuts at least s of n. Places i
    to i + c - 1 lie in the windows that start from at[i + c - 1] - n + 1 to at[i], so all these runs together are the
    starts with c places or more.
    """

    def covering(share: float, fits) -> Column:
        c = F.ceil(F.lit(share) * n - 1e-6).cast("int")
        first = F.when(F.size(at) >= c, F.sequence(F.lit(0), F.size(at) - c)).otherwise(F.array().cast("array<int>"))
        near = F.filter(first, lambda i: F.get(at, i + c - 1) - F.get(at, i) < n)
        runs = F.transform(near, lambda i: F.sequence(F.get(at, i + c - 1) - n + 1, F.get(at, i)))
        return F.filter(F.array_distinct(F.flatten(runs)), fits)

    whole = covering(2 * least / (1 + least), lambda s: (s >= 0) & (s <= length - n))
    return F.concat(whole, covering(least, lambda s: (s < 0) | (s > length - n)))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, doc_id, item_id, similarity, first_word): the best window of each document and item that match.

    ``key`` identifies a (doc_id, text); ``row_key`` computes it.
    """
    named = materialize(benchmark_items(benchmark), "items")
    items = named.drop("item_id").dropDuplicates(["item"])
    index = items.select("item", "k", "n", F.explode("shingles").alias("shingle")).distinct()
    sizes = {r.k: r.n for r in index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SHINGLE rows
    small = F.broadcast if sum(sizes.values()) <= BROADCAST else lambda df: df
    kinds = [holders(docs, index, k, n) for k, n in sorted(sizes.items())] or [holders(docs.limit(0), index, SHINGLE, 0)]
    held = kinds[0]
    for more in kinds[1:]:
        held = held.unionByName(more)
    held = materialize(held.dropDuplicates(["key", "k"]), "held")

    hits = held.select("key", "k", F.size("shingles").alias("length"), F.posexplode("shingles").alias("at", "shingle")).join(small(index), ["k", "shingle"])
    spots = hits.groupBy("key", "k", "item", "n", "length").agg(F.collect_list("at").alias("at")).filter(F.size("at") >= F.lit(least) * F.col("n") - 1e-6)
    laid = spots.select("key", "k", "item", "n", F.explode(starts(F.array_sort("at"), F.col("n"), F.col("length"), least)).alias("start"))
    edge = F.greatest("start", F.lit(0))
    cut = held.join(laid, ["key", "k"]).select("key", "doc_id", "item", "start", F.slice("shingles", edge + 1, F.least(F.col("start") + F.col("n"), F.size("shingles")) - edge).alias("window"))
    windows = materialize(fingerprint(cut, "window", "near"), "windows")

    left = windows.select("key", "item", "start", "near", F.explode(blocks(F.col("near"), radius)).alias("b"))
    right = items.select("item", "mark", F.explode(blocks(F.col("mark"), radius)).alias("b"))
    near = left.join(small(right), ["item", "b"]).filter(F.bit_count(F.col("near").bitwiseXOR(F.col("mark"))) <= radius).select("key", "item", "start").distinct()
    full = near.join(windows, ["key", "item", "start"]).join(small(items.select("item", "shingles", "plain")), "item")
    found = full.withColumn("similarity", similarity(F.col("window"), F.col("shingles"), F.col("plain"))).filter(F.col("similarity") >= least)
    best = found.groupBy("key", "doc_id", "item").agg(F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("b"))
    out = best.join(small(named.select("item", "item_id").distinct()), "item")
    out = materialize(out.select("key", "doc_id", "item_id", "b.similarity", F.greatest("b.start", F.lit(0)).alias("first_word")), "matches")
    release(named, held, windows)
    return out


def row_key() -> Column:
    """128 bits that identify a (doc_id, text); a null id differs from all others."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; same columns."""
    bad = matches(docs, benchmark).select(F.col("key").alias("_mr_key")).distinct()
    return docs.withColumn("_mr_key", row_key()).join(bad, "_mr_key", "left_anti").drop("_mr_key")
