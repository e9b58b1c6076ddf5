"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Templates and texts are words (A-Z lower-cased). Per template of m words, a text's blocks are 2m successive
words, starting at every multiple of m, so that any m successive words lie inside one block. A block meets a
template if it holds at least the share ``CONTAINED`` of the template's distinct words, all phrases that the
template must have (such as the license's name with its version) and none that speaks against it, not even in the 2m
words before or after. Template words
are put in order of their frequency in all documents, rarest first: a block that meets the template must hold one
of its first |T| - need + 1 words (prefix filter), which also leaves enough words after it (positional filter), and
have at least ``need`` distinct words (length filter). Blocks that pass are verified exactly. A label is reported at
its best block, the first of equal ones.

Templates are a table: an index from prefix words to templates and the templates themselves are two constants of the
plan, which has the same size however many there are. Documents are neither shuffled nor joined.

Null and empty texts have no words and no labels; texts are taken whole; every row is scanned on its own, so
null, tied and repeated ids do not matter. Without documents all frequencies are 0. Other columns pass.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import words
from millrace.llm.license_texts import PHRASES, TEMPLATES, Template

CONTAINED = 0.8
_TEMPLATE = "array<struct<label:string,m:int,need:int,bag:array<string>,must:array<string>,unless:array<string>>>"


def split(text: str) -> list[str]:
    """The word rule on the driver, for templates (ASCII)."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def needed(bag: set[str], contained: float) -> int:
    return math.ceil(contained * len(bag) - 1e-9)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in all documents; no more rows than the vocabulary has."""
    found = docs.select(F.explode(F.filter(words(F.col("text")), lambda w: w.isin(vocabulary))).alias("w"))
    return {r.w: r.n for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _constant(value, kind: str) -> Column:
    """A nested constant, which the optimiser folds into one literal."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def scan(docs: DataFrame, contained: float = CONTAINED, templates: list[Template] = TEMPLATES) -> DataFrame:
    """docs without text (and without columns of the names below) but with n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` lists (label, first word of its best block, containment) per label that met a template.
    """
    bags = [split(t.text) for t in templates]
    often = frequencies(docs, sorted({w for b in bags for w in b}))
    order = lambda bag: sorted(set(bag), key=lambda w: (often.get(w, 0), w))
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    anchors = [min(range(len(p)), key=lambda i, p=p: (often.get(p[i], 0), p[i], i)) for p, _ in phrases]
    table = [{"label": t.label, "m": len(b), "need": needed(set(b), contained), "bag": order(b), "must": list(t.must), "unless": list(t.unless)} for t, b in zip(templates, bags, strict=True)]
    index: dict[str, list[int]] = {}
    for i, t in enumerate(table):
        for w in t["bag"][: len(t["bag"]) - t["need"] + 1]:
            index.setdefault(w, []).append(i)
    rare = sorted({*index, *(p[a] for (p, _), a in zip(phrases, anchors, strict=True))})
    lookup, all_templates = _constant(index, "map<string,array<int>>"), _constant(table, _TEMPLATE)

    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches", "_w", "_hits", "_base", "_met", "_near")]
    kept = [f"`{c}`" for c in keep]
    out = docs.select(*kept, words(F.col("text")).alias("_w"))
    out = out.withColumn("_hits", F.filter(F.transform("_w", lambda w, i: F.when(w.isin(rare), i).otherwise(-1)), lambda i: i >= 0))
    w, hits = F.col("_w"), F.col("_hits")
    at = lambda i: F.get(w, i)

    def places(phrase: list[str], anchor: int) -> Column:
        starts = F.transform(F.filter(hits, lambda i: at(i) == phrase[anchor]), lambda i: i - anchor)
        return F.filter(starts, lambda s: (s >= 0) & (F.slice(w, F.greatest(s, F.lit(0)) + 1, len(phrase)) == _strings(phrase)))

    # (template, block) pairs that a prefix word leads to
    def around(i: Column) -> Column:
        block = lambda t: F.floor(i / F.get(all_templates, t)["m"]).cast("int")
        pair = lambda t, j: F.struct(t.alias("t"), j.alias("j"))
        found = F.coalesce(F.try_element_at(lookup, at(i)), F.array().cast("array<int>"))
        return F.flatten(F.transform(found, lambda t: F.array(pair(t, block(t)), pair(t, block(t) - 1))))

    out = out.select(*kept, "_w", F.array(*(places(p, a) for (p, _), a in zip(phrases, anchors, strict=True))).alias("_base"), F.filter(F.array_distinct(F.flatten(F.transform(hits, around))), lambda c: c["j"] >= 0).alias("_near"))

    def verified(c: Column) -> Column:
        t = F.get(all_templates, c["t"])
        block = F.slice(w, c["j"] * t["m"] + 1, t["m"] * 2)
        near = F.slice(w, F.greatest(c["j"] - 2, F.lit(0)) * t["m"] + 1, (c["j"] + 4 - F.greatest(c["j"] - 2, F.lit(0))) * t["m"])
        line = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
        holds = lambda ws: lambda p: F.contains(line(ws), F.concat(F.lit(" "), p, F.lit(" ")))
        common = F.size(F.array_intersect(F.array_distinct(block), t["bag"]))
        fits = (F.size(block) >= t["need"]) & (common >= t["need"]) & F.forall(t["must"], holds(block)) & ~F.exists(t["unless"], holds(near))
        return F.when(fits, F.struct(t["label"].alias("label"), (c["j"] * t["m"]).alias("at"), (common / F.size(t["bag"])).alias("share")))

    out = out.select(*kept, F.size(w).cast("long").alias("n_words"), "_base", F.array_compact(F.transform("_near", verified)).alias("_met"))
    base, met = F.col("_base"), F.col("_met")
    base_labels = F.array_compact(F.array(*(F.when(F.size(base[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))))
    names = F.array_sort(F.array_distinct(F.transform(met, lambda x: x["label"])))

    def best(label: Column) -> Column:
        top = F.array_max(F.transform(F.filter(met, lambda x: x["label"] == label), lambda x: F.struct(x["share"].alias("share"), (-x["at"]).alias("at"))))
        return F.struct(label.alias("label"), (-top["at"]).alias("first_word"), top["share"].alias("containment"))

    every = F.flatten(base)
    share = F.coalesce(F.array_max(F.transform(met, lambda x: x["share"])), F.lit(0.0))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        *kept,
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        join(base_labels).alias("base_labels"),
        join(F.concat(base_labels, names)).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(share).alias("score"),
        F.transform(names, best).alias("matches"),
    )


def scan_sql(contained: float = CONTAINED, templates: list[Template] = TEMPLATES) -> str:
    """The same result (without ``matches``) as DuckDB SQL that looks at every block for every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    rows = []
    for t in templates:
        bag = split(t.text)
        rows.append(f"('{t.label}', {len(bag)}, {needed(set(bag), contained)}, {quoted(sorted(set(bag)))}, {quoted(t.must)}, {quoted(t.unless)})")
    places = reduce(lambda a, b: f"list_concat({a}, {b})", (f"list_transform(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {quoted(p.split())}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items()))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, len(w) AS n_words, {places} AS p FROM d),
t(label, m, need, bag, must, unless) AS (VALUES {", ".join(rows)}),
k AS (SELECT doc_id, label, need, bag, must, unless, w[j * m + 1 : j * m + 2 * m] AS block, w[greatest(j - 2, 0) * m + 1 : (j + 4) * m] AS near FROM (SELECT d.*, t.*, unnest(range(0, (len(w) + m - 1) // m)) AS j FROM d, t)),
s AS (SELECT *, len(list_intersect(list_distinct(block), bag)) AS common FROM k),
met AS (SELECT doc_id, list(label) AS labels, max(common / len(bag)) AS share FROM s WHERE common >= need
  AND len(list_filter(must, lambda x: NOT contains(' ' || array_to_string(block, ' ') || ' ', ' ' || x || ' '))) = 0 AND len(list_filter(unless, lambda x: contains(' ' || array_to_string(near, ' ') || ' ', ' ' || x || ' '))) = 0 GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min([x.at for x in p])::BIGINT AS first_word, list_max([x.at for x in p])::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct([x.label for x in p])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat([x.label for x in p], coalesce(met.labels, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(met.share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN met USING (doc_id)"""
