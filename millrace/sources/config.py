"""Configuration: defaults, then a TOML file, then a .env file, then the environment; all values are checked."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from millrace.sources.files import EXCLUDED_DIRS, EXCLUDED_SUFFIXES, MAX_BYTES


@dataclass(frozen=True)
class Config:
    provider: str = "mock"
    model: str = "mock"
    dimensions: int = 384
    batch_size: int = 100
    max_file_size: int = MAX_BYTES
    chunk_overlap: int = 10
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    exclude_suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES
    limit: int = 10
    threshold: float = 0.0
    rrf_k: int = 60
    rerank_top_k: int = 20
    debounce_ms: int = 2000

    def check(self) -> Config:
        for name, low, high in (("dimensions", 1, 65536), ("batch_size", 1, 100_000), ("max_file_size", 1, 1 << 40), ("chunk_overlap", 0, 49), ("limit", 1, 100), ("threshold", -1, 1), ("rrf_k", 1, 10_000), ("rerank_top_k", 1, 1000), ("debounce_ms", 1, 3_600_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        return self


def load(path: str | None = None, env_file: str | None = None, environ: dict[str, str] | None = None, prefix: str = "MILLRACE_") -> Config:
    config, kinds = Config(), {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    cast = lambda k, v: tuple(v.split(",") if isinstance(v, str) else v) if kinds[k] is tuple else kinds[k](v)
    if path and Path(path).exists():
        found = {k: v for section in tomllib.loads(Path(path).read_text()).values() if isinstance(section, dict) for k, v in section.items()}
        config = replace(config, **{k: cast(k, v) for k, v in found.items() if k in kinds})
    pairs = {}
    if env_file and Path(env_file).exists():
        lines = (x.strip() for x in Path(env_file).read_text().splitlines())
        pairs |= dict((p.strip() for p in x.split("=", 1)) for x in lines if "=" in x and not x.startswith("#"))
    pairs |= os.environ if environ is None else environ
    own = {k.removeprefix(prefix).lower(): v.strip("\"'") for k, v in pairs.items() if k.startswith(prefix)}
    return replace(config, **{k: cast(k, v) for k, v in own.items() if k in kinds}).check()
