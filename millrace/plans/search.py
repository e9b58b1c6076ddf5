"""Search as a plan: options, strategies, routing, several workspaces, rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import enrich_query, preview
from millrace.operators import dense, fusion, graph, sparse
from millrace.operators.lookups import workspaces

MODES = ("dense", "sparse", "hybrid", "hybrid-rerank", "graph")
ROUTES = ("auto", "graph", "hybrid", "none")
MOST = 100


@dataclass(frozen=True)
class Options:
    limit: int = 10
    threshold: float = 0.0
    language: str | None = None
    path: str | None = None
    mode: str = "hybrid"
    rrf_k: int = fusion.RRF_K
    rerank_top_k: int = fusion.RERANK

    def check(self) -> Options:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; modes are {', '.join(MODES)}")
        if self.limit < 1 or not -1 <= self.threshold <= 1:
            raise ValueError("limit must be at least 1 and threshold between -1 and 1")
        return self


@dataclass(frozen=True)
class Workspace:
    """One index: its relations, lexical index and the function that embeds a list of texts."""

    chunks: DataFrame
    vectors: DataFrame
    lexical: sparse.Index
    nodes: DataFrame
    edges: DataFrame
    embed: object = None


def embed_query(space: Workspace, query: str) -> list[float]:
    text = space.chunks.sparkSession.range(1).select(enrich_query(F.lit(query)).alias("q")).first().q
    return [float(x) for x in space.embed([text])[0]]


def strategy(space: Workspace, options: Options, scorer=fusion.overlap_scorer):
    """A function from a query to ranked chunks, by mode."""
    o = options.check()
    legs = {
        "dense": lambda q: dense.search(space.chunks, space.vectors, embed_query(space, q), o.limit, o.threshold, o.language, o.path),
        "sparse": lambda q: sparse.search(space.chunks, space.lexical, q, o.limit, o.language, o.path),
        "graph": lambda q: graph.search(space.nodes, space.edges, space.chunks, q, o.limit),
    }
    legs["hybrid"] = lambda q: fusion.hybrid(lambda: legs["dense"](q), lambda: legs["sparse"](q), o.rrf_k, o.limit, sparse.order())
    legs["hybrid-rerank"] = lambda q: fusion.rerank(fusion.ranked(legs["hybrid"](q)), q, o.rerank_top_k, scorer)
    return legs[o.mode]


def routed_mode(space: Workspace, query: str, routing: str, mode: str) -> str:
    """The mode that a routing parameter leads to: 'auto' asks the router, 'none' keeps the mode."""
    if routing not in ROUTES:
        raise ValueError(f"unknown routing {routing!r}; routings are {', '.join(ROUTES)}")
    if routing == "auto":
        return space.chunks.sparkSession.range(1).select(graph.route(F.lit(query)).route.alias("r")).first().r
    return mode if routing == "none" else routing


def search(spaces: dict[str, Workspace], query: str, options: Options = Options(), routing: str = "none", names: list[str] | None = None) -> DataFrame:
    """Search one or several workspaces. Hybrid over several merges each leg globally before fusing."""
    limit = min(options.limit, MOST)
    chosen = {n: spaces[n] for n in workspaces(sorted(spaces), names)}
    mode = routed_mode(next(iter(chosen.values())), query, routing, options.mode)
    lexical, key = [*sparse.order(), "repo_name"], ["repo_name", *fusion.KEY]
    results = lambda m: {n: strategy(s, Options(**{**options.__dict__, "mode": m, "limit": limit}))(query) for n, s in chosen.items()}
    # a lexical leg without words has no bm25
    leg = lambda m: fusion.merge(r := results(m), limit, lexical if m == "sparse" and all("bm25" in x.columns for x in r.values()) else key)
    if mode in ("hybrid", "hybrid-rerank") and len(chosen) > 1:
        legs = [fusion.ranked(x, tie=lexical if "bm25" in x.columns else key) for x in map(leg, ("dense", "sparse"))]
        shared = [c for c in legs[0].columns if c in legs[1].columns]
        fused = fusion.rrf([x.select(shared) for x in legs], options.rrf_k, limit, key=key)
        return fusion.rerank(fusion.ranked(fused, tie=key), query, options.rerank_top_k) if mode == "hybrid-rerank" else fused
    return leg(mode)


def graph_tool(spaces: dict[str, Workspace], kind: str, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
    """Callers, callees, dependents or imports of a symbol over all workspaces, at most 100."""
    found = [graph.LOOKUPS[kind](s.nodes, s.edges, symbol, file).select(graph.NODE).withColumn("repo_name", F.lit(n)) for n, s in sorted(spaces.items())]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.orderBy("repo_name", "file_path", "id").limit(min(limit, MOST))


def to_json(results: DataFrame) -> list[dict]:
    return [json.loads(x) for x in results.toJSON().collect()]


def to_text(results: DataFrame, lines: int = 5) -> str:
    """Results as text: place, score and the first lines of each."""
    rows = results.select("file_path", "start_line", "end_line", F.coalesce("symbol", F.lit("")).alias("symbol"), "score", preview(F.col("content"), lines).alias("preview")).collect()
    return "\n\n".join(f"{i}. {r.file_path}:{r.start_line}-{r.end_line} {r.symbol} (score {r.score:.4f})\n{r.preview}" for i, r in enumerate(rows, 1)) or "No results."


def banner(stale_rows: DataFrame, now: int) -> str:
    """A notice of results whose files changed since; ages in seconds or minutes."""
    age = lambda s: f"{s}s" if s < 60 else f"{s // 60}m"
    rows = stale_rows.select("file_path", "since").orderBy("file_path").collect()
    return "".join(f"Stale: {r.file_path} changed {age(max(0, now - int(r.since)))} ago\n" for r in rows)
