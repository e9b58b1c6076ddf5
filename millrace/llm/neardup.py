"""Near duplicates by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles. BagMinHash draws, for each shingle and each dyadic weight
level, a Poisson process whose points fall on the signature's registers; a point counts if its place in the
level is below the shingle's weight. The least point per register gives signatures that agree per register
with probability equal to the weighted Jaccard similarity. Points are drawn in rising order and a shingle
stops once it has passed the largest register, so long texts cost little more than one point per shingle.
Registers are cut into bands; texts that share a band are candidates, and each link is verified by the exact
multiset overlap (sum of minima over sum of maxima).

Equal texts are one text. In a bucket of texts that share a band, every member first meets a member chosen by
hash, ``STARS`` times over. What then still is of different classes within a bucket meets likewise in much finer
buckets (many random subsets of registers, ``FINE``), which find the closest pairs first and leave few classes
apart. The rest gets an exact set-similarity join: shingles are put in order of their frequency, rarest first,
and two texts of different classes can be similar only if they share one of the first n - ceil(0.8 n) + 1. Texts
meet only under a shingle that they share so. For shingles with few texts, pairs whose lengths and places allow the
similarity are verified. Texts with more frequent ones are put in blocks by the most frequent of them, and two blocks
that share such a shingle are compared by one product of incidence matrices. So a class comes from all links, while
no pairs of an unbounded group are listed.

Null text counts as empty. Texts of one to four words have all their words as one shingle; texts without words
are classes with their equal texts only. Texts are taken whole. A class is named by its smallest key; rows
with equal texts share it, and so do repeated rows. Null doc_ids take part: a class of null ids only has a
null name. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import SHINGLE, SIMILARITY, materialize, release, text_key
from millrace.llm.graph import components
from millrace.llm.textvec import counted, fresh, lowered, mix, shingles, slices, span_hashes, text_buffers, trim, word_spans

#: A pair at similarity 0.8 is missed by all bands with probability (1 - 0.8^6)^32, about 6 in 100,000.
BANDS, DEPTH = 32, 6
REGISTERS = BANDS * DEPTH
#: Rounds in which members of a bucket meet one chosen member.
STARS = 2
#: (registers, subsets) of the rounds on what is still apart.
FINE = ((24, 200), (20, 200), (16, 200))
#: Texts of a block, also the most that a rare shingle has; columns of one product; rare entries taken together.
TILE, WIDTH, CELL = 256, 4096, 4096
#: Rows of a batch that goes to Python, which bounds the shingles held at once.
ROWS = 1000
SEED = np.uint64(0x5851F42D4C957F2D)
STEP = np.uint64(0x9E3779B97F4A7C15)


def bag(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs and their multiplicities for a slice of rows."""
    low = lowered(raw)
    starts, ends, rows = word_spans(low, offsets)
    keys, of = shingles(span_hashes(low, starts, ends), rows, len(offsets) - 1, size)
    return counted(keys, of)


def signatures(keys: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """An (n, m) array of register values; rows without elements stay at the largest value."""
    least = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    if not len(keys):
        return least.reshape(n, m)
    # level 0 holds weight [0, 1), level l >= 1 holds [2^(l-1), 2^l)
    seeds, owner, width, inside = [], [], [], []
    level, live = 0, np.arange(len(keys))
    while len(live):
        lo = 0 if level == 0 else 1 << (level - 1)
        span = max(lo, 1)
        seeds.append(mix(keys[live] + np.uint64((int(SEED) * (level + 1)) % (1 << 64))))
        owner.append(rows[live])
        width.append(np.full(len(live), float(span)))
        inside.append(np.minimum(weights[live] - lo, span) / span)
        live = live[weights[live] > lo + span]
        level += 1
    seed, own, rate, share = (np.concatenate(x) for x in (seeds, owner, width, inside))
    own = own.astype(np.int64)
    mass = np.bincount(own, rate, n)
    time = np.zeros(len(seed))
    drawn = np.zeros(len(seed), np.int64)
    active = np.arange(len(seed))
    while len(active):
        # elements of poor rows draw several points at a time
        k = np.clip(m * rate[active] / mass[own[active]], 1, 64).astype(np.int64)
        base = np.cumsum(k) - k
        e = np.repeat(active, k)
        j = np.arange(len(e)) - np.repeat(base, k)
        r = mix(seed[e] + STEP * (drawn[e] + j + 1).astype(np.uint64))
        gap = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[e]
        run = np.cumsum(gap)
        t = time[e] + run - np.repeat(run[base] - gap[base], k)
        r = mix(r + SEED)
        register = (r >> np.uint64(32)) % np.uint64(m)
        place = (r & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24
        hit = place < share[e]
        value = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(r) >> np.uint64(32))
        np.minimum.at(least, own[e[hit]] * m + register[hit].astype(np.int64), value[hit])
        time[active] = t[base + k - 1]
        drawn[active] += k
        top = least.reshape(n, m).max(1)
        bar = np.where(top == np.iinfo(np.uint64).max, np.inf, (top >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64))
        active = active[time[active] <= bar[own[active]]]
    return least.reshape(n, m)


def bands(least: np.ndarray, count: int = BANDS, depth: int = DEPTH) -> np.ndarray:
    """(rows, count) band keys, made from what the registers' least points are."""
    low = least & np.uint64(0xFFFFFFFF)
    out = np.empty((len(low), count), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(count):
            h = np.full(len(low), np.uint64(b + 1) * STEP, np.uint64)
            for c in range(b * depth, (b + 1) * depth):
                h = mix(h + low[:, c])
            out[:, b] = h
    return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(text_key, doc_id, shingles, bands) per row; ``bands`` is empty where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            sizes, keys = [], []
            for i, j in slices(offsets):
                k, r, w = bag(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.bincount(r, w, j - i).astype(np.int64) if len(r) else np.zeros(j - i, np.int64)
                for a in range(0, j - i, 1000):  # bounds the registers held at once
                    z = min(j - i, a + 1000)
                    lo, hi = np.searchsorted(r, [a, z])
                    made = bands(signatures(k[lo:hi], r[lo:hi] - a, w[lo:hi], z - a))
                    keys += [made[x] if size[a + x] else made[x][:0] for x in range(z - a)]
                sizes += size.tolist()
            yield pa.RecordBatch.from_arrays([batch["text_key"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["text_key", "doc_id", "shingles", "bands"])
            trim()

    rows = docs.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "text_key string, doc_id long, shingles long, bands array<long>")


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two counted bags with ascending keys."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The (a, b) pairs whose multisets overlap by ``least`` or more; ``texts`` has one text per key."""
    t = texts.select("node", "text")
    both = pairs.join(t.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(t.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                raw, offsets = text_buffers(batch[name])
                bags = []
                for i, j in slices(offsets):
                    k, r, w = bag(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    at = np.searchsorted(r, np.arange(j - i + 1))
                    bags += [(k[x:y], w[x:y]) for x, y in itertools.pairwise(at)]
                sides.append(bags)
            keep = pa.array([_overlap(x, y) >= least for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(keep)
            trim()

    return both.mapInArrow(run, "a long, b long")


def subset_keys(least: np.ndarray, depth: int, count: int) -> np.ndarray:
    """(rows, count) keys, each of ``depth`` registers drawn at random (the same draw for all rows)."""
    low, rng = least & np.uint64(0xFFFFFFFF), np.random.default_rng(depth)
    out = np.empty((len(low), count), np.uint64)
    for b in range(count):
        h = np.full(len(low), np.uint64((b + 1) * 0x9E3779B9), np.uint64)
        for c in rng.choice(low.shape[1], depth, replace=False):
            h = (h ^ low[:, c]) * STEP
            h ^= h >> np.uint64(32)
        out[:, b] = h
    return out.view(np.int64)


def fine_pairs(rest: DataFrame, texts: DataFrame, depth: int, count: int, least: float = SIMILARITY) -> DataFrame:
    """(node, other) pairs of different components that share a fine bucket; each meets the bucket's chosen member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            sizes, keys = [], []
            for i, j in slices(offsets):
                k, r, w = bag(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys += list(subset_keys(signatures(k, r, w, j - i), depth, count))
                sizes += np.bincount(r, w, j - i).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch["node"], batch["component"], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "component", "shingles", "keys"])
            trim()

    made = materialize(rest.join(texts, "node").select("node", "component", "text").mapInArrow(run, "node long, component long, shingles long, keys array<long>"), "fine", arrow_rows=ROWS)
    rows = made.select("node", "component", "shingles", F.explode("keys").alias("key"))
    return star_pairs(rows, "key", depth, least)


def star_pairs(rows: DataFrame, key: str, turn: int, least: float) -> DataFrame:
    """Each row's node with its bucket's chosen node, where their components differ and their sizes may agree."""
    chosen = F.min_by(F.struct("node", "component", "shingles"), F.xxhash64("node", F.lit(turn))).alias("c")
    apart = rows.groupBy(key).agg(chosen, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(key, "c")
    pairs = rows.join(materialize(apart, "stars"), key).filter("component <> c.component")
    return pairs.filter(F.least("shingles", "c.shingles") >= F.greatest("shingles", "c.shingles") * least).select("node", F.col("c.node").alias("other"))


def block_links(left: tuple, right: tuple, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the similar pairs of different components; sides are (components, token arrays)."""
    (ca, ta), (cb, tb) = left, right
    na, nb = (np.array([len(t) for t in x]) for x in (ta, tb))
    tokens = np.concatenate([*ta, *tb])
    row = np.repeat(np.arange(len(ta) + len(tb)), np.r_[na, nb])
    _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = often[column] > 1  # others are in no overlap
    used, column = np.unique(column[keep], return_inverse=True)
    row = row[keep]
    both = np.zeros((len(ta), len(tb)), np.float32)
    order = np.argsort(column, kind="stable")
    for c in range(0, len(used), WIDTH):
        lo, hi = np.searchsorted(column[order], [c, c + WIDTH])
        part = order[lo:hi]
        cells = np.zeros((len(ta) + len(tb), min(WIDTH, len(used) - c)), np.float32)
        cells[row[part], column[part] - c] = 1
        both += cells[: len(ta)] @ cells[len(ta) :].T
    hit = (both >= least * (na[:, None] + nb[None, :] - both) - 1e-6) & (ca[:, None] != cb[None, :])
    if same:
        hit &= np.tri(len(ta), len(tb), -1, dtype=bool).T
    return np.nonzero(hit)


def rest_links(rest: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b) links between different components among (node, component) rows: prefix filter, then blocks.

    A multiset is the set of its shingles numbered by occurrence. Shingles that only one text has come first in
    its order and meet nobody, so they only count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            tokens = []
            for i, j in slices(offsets):
                k, r, w = bag(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                turn = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                numbered = mix(np.repeat(k, w) + turn.astype(np.uint64) * STEP).view(np.int64)
                edges = np.r_[0, np.cumsum(np.bincount(r, w, j - i).astype(np.int64))]
                tokens += [numbered[a:z] for a, z in itertools.pairwise(edges)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["component"], pa.array(tokens, pa.list_(pa.int64()))], ["node", "component", "tokens"])
            trim()

    made = materialize(rest.join(texts, "node").select("node", "component", "text").mapInArrow(run, "node long, component long, tokens array<long>"), "tokens", arrow_rows=ROWS)
    rows = made.select("node", "component", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # a token that no second component has cannot lead to a link, but takes its place in the order
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("often"), (F.min("component") < F.max("component")).alias("apart")).filter("often > 1")
    order = W.partitionBy("node").orderBy("often", "token")
    place = F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node"))
    prefix = rows.join(often, "token").withColumn("place", place).filter(F.col("apart") & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1))
    prefix = materialize(prefix.select("token", "node", "place"), "prefixes")
    sizes = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))
    prefix = materialize(prefix.join(sizes, "token"), "prefixes")
    facts = made.select("node", "component", F.size("tokens").alias("n"))
    few = prefix.filter(F.col("texts") <= TILE)
    cells = max(1, -(-few.count() // CELL))
    rows = few.join(facts, "node").select(F.pmod(F.xxhash64("token"), F.lit(cells)).alias("cell"), "token", "node", "component", "n", "place")
    pairs = materialize(rows.groupBy("cell").applyInPandas(lambda pdf: cell_pairs(pdf, least), "a long, b long").distinct(), "pairs")
    links = verify(pairs, texts, least)

    many = prefix.filter(F.col("texts") > TILE)
    anchors = many.groupBy("node").agg(F.max_by("token", F.struct("texts", "token")).alias("anchor"))
    sizes = anchors.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    shared = max(1, -(-anchors.count() // TILE))
    # an anchor with few texts shares its block with others
    block = F.when(F.col("blocks") > 1, F.struct(F.col("anchor").alias("g"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("s")))
    block = block.otherwise(F.struct(F.pmod(F.xxhash64("anchor"), F.lit(shared)).alias("g"), F.lit(-1).alias("s")))
    blocks = materialize(anchors.join(sizes, "anchor").select("node", block.alias("block")), "blocks")
    spots = materialize(many.join(blocks, "node").select("token", "block").distinct(), "spots")
    tiles = spots.withColumnRenamed("block", "x").join(spots.withColumnRenamed("block", "y"), "token").filter("x <= y").select("x", "y").distinct()
    members = blocks.join(made, "node")
    left = tiles.withColumn("block", F.col("x")).join(members, "block").withColumn("first", F.lit(True))
    right = tiles.filter("x < y").withColumn("block", F.col("y")).join(members, "block").withColumn("first", F.lit(False))
    sides = left.unionByName(right).select(F.col("x.g").alias("xg"), F.col("x.s").alias("xs"), F.col("y.g").alias("yg"), F.col("y.s").alias("ys"), "first", "node", "component", "tokens")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = tuple(key[:2]) == tuple(key[2:])
        parts = [pdf[pdf["first"]], pdf if same else pdf[~pdf["first"]]]
        (ca, ta, a), (cb, tb, b) = ((p["component"].to_numpy(), list(p["tokens"]), p["node"].to_numpy()) for p in parts)
        i, j = block_links((ca, ta), (cb, tb), same, least)
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    links = links.unionByName(sides.groupBy("xg", "xs", "yg", "ys").applyInPandas(compare, "a long, b long"))
    out = materialize(links.distinct(), "links", arrow_rows=ROWS)
    release(made, prefix, pairs, blocks, spots)
    return out


def cell_pairs(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b) of nodes of different components that share a token of the rows and can be similar.

    Two texts whose first common token has places i and j share at most 1 + min(n_a - i, n_b - j) tokens.
    """
    pdf = pdf.sort_values(["token", "node"])
    token, node, component, n, place = (pdf[c].to_numpy() for c in ("token", "node", "component", "n", "place"))
    out = []
    for step in range(1, len(token)):
        i = np.flatnonzero(token[step:] == token[:-step])
        if not len(i):
            break
        j = i + step
        need = np.ceil(least / (1 + least) * (n[i] + n[j]) - 1e-9)
        fits = (component[i] != component[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) + 1 >= need)
        out.append(pd.DataFrame({"a": node[i[fits]], "b": node[j[fits]]}))
    return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": [], "b": []})


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class), text_key, representative.

    ``representative`` marks one row per text of the class's smallest key; repeated rows are all marked.
    """
    rows = materialize(sketch(docs), "sketches", arrow_rows=ROWS)
    copies = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    # a text is known by a 64-bit number made from its key
    nodes = materialize(copies.select(F.xxhash64("text_key").alias("node"), "text_key", "first_id", "shingles", "bands"), "texts")
    members = nodes.select(F.explode("bands").alias("band"), "node", "shingles")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = materialize(members.join(shared, "band"), "buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", "text_key", "first_id"), "node")
    source = docs.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.join(wanted, (source.text_key == wanted.text_key) & source.doc_id.eqNullSafe(wanted.first_id))
    texts = materialize(source.select("node", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["node"]), "candidates")
    links = None
    labels = None
    done = [members, texts, nodes]
    rest = None
    for turn in range(STARS + len(FINE) + 1):
        now = members.withColumn("component", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < STARS:
            pairs = star_pairs(now, "band", turn, least)
        else:
            apart = materialize(now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band"), "apart")
            rest = materialize(now.join(apart, "band").select("node", "component").distinct(), "rest")
            release(apart)
            if rest.isEmpty():
                break
            pairs = fine_pairs(rest, texts, *FINE[turn - STARS], least) if turn - STARS < len(FINE) else None
        if pairs is not None:
            pairs = materialize(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
            found = materialize(verify(pairs, texts, least), "links", arrow_rows=ROWS)
            release(pairs)
        else:
            found = rest_links(rest, texts, least)
        links = found if links is None else links.unionByName(found)
        done.append(found)
        labels, old = components(links), labels
        if old is not None:
            release(old)
    named = nodes.select("node", "text_key", "first_id")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        named = named.withColumn("component", F.col("node"))
    names = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("text_key", F.struct(F.col("first_id").isNull(), "first_id", "text_key")).alias("kept_key"))
    named = materialize(named.join(names, "component").select("text_key", "class_id", "first_id", (F.col("text_key") == F.col("kept_key")).alias("kept")), "classes")
    release(*done, *([labels] if labels is not None else []))
    out = rows.select("text_key", "doc_id").join(named, "text_key")
    return out.select("doc_id", "class_id", "text_key", (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("representative"))
