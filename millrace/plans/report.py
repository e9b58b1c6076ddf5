"""Reports of results: text tables, JSON and Markdown, made on the driver from small aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def table(df: DataFrame, digits: int = 4) -> str:
    """A fixed-width text table of a small result."""
    rows = [[f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x) for x in r] for r in df.collect()]
    widths = [max(len(h), *(len(r[i]) for r in rows)) if rows else len(h) for i, h in enumerate(df.columns)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


def markdown(df: DataFrame, digits: int = 3) -> str:
    rows = [[f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x) for x in r] for r in df.collect()]
    return "\n".join(f"| {' | '.join(r)} |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def to_json(df: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in df.toJSON().collect()], indent=1)


def baseline(corpus: str, embedder: str, metrics: dict[str, float]) -> str:
    """Metrics as a baseline file's text."""
    return json.dumps({"version": "1", "corpus": corpus, "embedder": embedder, "metrics": metrics}, indent=1)


def experiment(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report of several tables."""
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown(df)}" for name, df in sections.items()) + "\n"
