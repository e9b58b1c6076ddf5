"""Line dedup with a log-template tree, in DataFrame functions only.

A line is its tokens (white space apart); a run of digits is a variable field. The tree has fixed depth: number of
tokens, then the first ``LEAD`` tokens, then a leaf. A line belongs to its exact template (all tokens, variable
fields left open) and to ``RUNS`` wider ones, in each of which one run of an eighth of its tokens (for short lines
one token) is left open too; where the open run holds a leading token, the tree has one branch for all its values.
Lines that differ in one run share that template. Two such lines agree in the first or the second half of their runs,
so the wider templates are made only for lines that share a half with enough others; the rest cannot have a partner.

A template recurs if enough documents have it: two for lines of ``LONG`` tokens or more, ``OFTEN`` for shorter
ones; lines under ``LEAST`` tokens are never dropped. The first document that has it (smallest doc_id, null
ids last, then smallest text hash) keeps its lines, all other documents lose them.

Templates and documents are told apart by 128-bit hashes. Null text counts as empty. Rows with equal doc_id and text
are one document: they keep or lose the same lines. Texts are taken whole; lines end at \\n, and what is kept is
joined by \\n. Empty tables give no rows; columns with clashing names do no harm. Joins are merge joins at every size,
as on tables that are too large to broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release

RUNS = 8


class Limits(NamedTuple):
    """Tokens of the shortest line that can go, of a long line, and documents that make a shorter one recur."""

    least: int = 5
    long: int = 20
    often: int = 8


LIMITS = Limits()


def hash128(name: str, *columns) -> list[Column]:
    """Two columns, name_a and name_b, that tell values apart."""
    return [F.xxhash64(*columns).alias(f"{name}_a"), F.xxhash64(F.lit(1), *columns).alias(f"{name}_b")]


def pair(name: str) -> list[str]:
    return [f"{name}_a", f"{name}_b"]


def row_key() -> Column:
    """(id, hash of the text) of a document, in the order that decides who keeps a line."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def tokens(line: Column) -> Column:
    """Tokens of a line with runs of digits made alike."""
    even = F.regexp_replace(line, r"[0-9]+", "0")
    even = F.when(line.rlike(r"[\t\x0b\f\r]"), F.regexp_replace(even, r"[\t\x0b\f\r]", " ")).otherwise(even)
    return F.array_remove(F.split(even, " "), "")


def templates(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc, at, long, n, runs, exact_a, exact_b) of each line; ``doc`` orders documents. Lines too short for any limit may lack."""
    rows = docs.select(row_key().alias("doc"), F.posexplode(lines(F.col("text"))).alias("at", "line"))
    rows = rows.filter(F.length("line") >= 2 * limits.least - 1)  # ``least`` tokens and what parts them
    rows = rows.select("doc", "at", tokens(F.col("line")).alias("t"))
    n = F.size("t")
    edge = lambda j: F.floor(F.lit(j) * n / RUNS).cast("int")
    runs = F.array(*(F.xxhash64(F.slice("t", edge(j) + 1, edge(j + 1) - edge(j))) for j in range(RUNS)))
    rows = rows.select("doc", "at", (n >= limits.long).alias("long"), n.alias("n"), runs.alias("runs"))
    return rows.select("*", *hash128("exact", "n", "runs"))


def wider(made: DataFrame, firsts: DataFrame, limits: Limits) -> DataFrame:
    """(exact, first) of lines that share a recurring wider template; firsts has (exact, first, last) of long lines."""
    half, exact, template = RUNS // 2, pair("exact"), pair("template")
    sides = [F.array(F.slice("runs", 1, half), F.array(F.lit(0).cast("long"))), F.array(F.slice("runs", half + 1, RUNS - half), F.array(F.lit(1).cast("long")))]
    each = made.select(*exact, "long", "n", F.explode(F.array(*sides)).alias("side")).select(*exact, "long", *hash128("half", "n", "side"))
    enough = (F.col("a") != F.col("b")) & (F.col("long") | (F.col("lines") >= limits.often))
    shared = each.groupBy(*pair("half"), "long").agg(F.min("exact_a").alias("a"), F.max("exact_a").alias("b"), F.count(F.lit(1)).alias("lines")).filter(enough).select(*pair("half"))
    near = materialize(each.join(shared.hint("merge"), pair("half")).select(*exact).distinct(), "partners")
    partners = materialize(made.join(near.hint("merge"), exact), "partner-lines")
    rows = partners.dropDuplicates(exact).select(*exact, "long", "n", "runs", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("j"))
    opened = F.array(*(F.when(F.col("j") == i, F.lit(0).cast("long")).otherwise(F.get("runs", i)) for i in range(RUNS)))
    wide = materialize(rows.select(*exact, "long", *hash128("template", "n", "j", opened)), "wider")
    of_long = wide.filter("long").join(firsts.hint("merge"), exact).groupBy(*template).agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first <> last").select(*template, "first")
    holders = partners.filter("not long").select(*exact, "doc").distinct()
    of_short = wide.filter("not long").join(holders.hint("merge"), exact).select(*template, "doc").distinct()
    of_short = of_short.groupBy(*template).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limits.often).select(*template, "first")
    groups = of_long.unionByName(of_short)
    out = materialize(wide.select(*exact, *template).join(groups.hint("merge"), template).groupBy(*exact).agg(F.min("first").alias("first")), "wide")
    release(near, partners, wide)
    return out


def dropped(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc, drops): the numbers of the lines that each document loses."""
    exact = pair("exact")
    stored = materialize(templates(docs, limits), "lines")
    made = stored.filter(F.col("n") >= limits.least)
    first, last = F.min("doc").alias("first"), F.max("doc").alias("last")
    firsts = materialize(made.filter("long").groupBy(*exact).agg(first, last), "firsts")
    long = firsts.filter("first <> last").select(*exact, "first").unionByName(wider(made, firsts, limits))
    short = made.filter("not long").select(*exact, "doc").distinct().groupBy(*exact).agg(first, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limits.often).select(*exact, "first")
    recurring = materialize(long.unionByName(short).groupBy(*exact).agg(F.min("first").alias("first")), "templates")
    lost = made.select(*exact, "doc", "at").join(recurring.hint("merge"), exact).filter(F.col("doc") != F.col("first")).select("doc", "at")
    out = materialize(lost.groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("drops")), "drops")
    release(stored, firsts, recurring)
    return out


def strip(docs: DataFrame, added: tuple[str, str] = ("n_lines", "drops"), limits: Limits = LIMITS) -> DataFrame:
    """docs with the recurring lines gone from text, and two columns ``added``: lines there were, numbers of those lost."""
    lost = dropped(docs, limits).withColumnsRenamed({"doc": "_mr_key", "drops": "_mr_drops"})
    keep = [c for c in docs.columns if c not in ("text", *added)]
    joined = docs.withColumn("_mr_key", row_key()).join(lost.hint("merge"), "_mr_key", "left")
    parts, drops = lines(F.col("text")), F.col("_mr_drops")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(drops, i)), "\n")
    return joined.select(*(f"`{c}`" for c in keep), F.when(drops.isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(parts).alias(added[0]), F.coalesce(drops, F.array().cast("array<int>")).alias(added[1]))
