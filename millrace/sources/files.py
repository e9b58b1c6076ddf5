"""File sources: discovery, decoding, corpora, manifests, line reads, text and name search."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import text_lines

MAX_BYTES = 1_048_576
# Directory names and filename suffixes that indexing skips by default.
EXCLUDED_DIRS = (".millrace", ".git", "node_modules", "target", "__pycache__", "vendor", "dist", "build", ".next", "benchmarks", "fixtures", "tests")
EXCLUDED_SUFFIXES = (".min.js", ".map", ".lock", ".svg", ".png", ".jpg", ".ico", ".woff", ".woff2", ".ttf", ".json", ".txt", ".md", ".toml", ".yaml", ".yml", ".sh")
# File extensions and their languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}
READ_LINES, READ_BYTES = 500, 2 << 20


def language(path: Column) -> Column:
    """Language of a path by its extension, whatever the case; 'unknown' otherwise."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def supported(path: Column) -> Column:
    return language(path) != "unknown"


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file under ``root``: path (relative), length, mtime (Unix seconds), content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = os.path.realpath(root).rstrip("/") + "/" if os.path.exists(root) else root.rstrip("/") + "/"
    inside = F.substring_index(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), base, -1)
    return reader.load(root).select(inside.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")


def ignore_rule(pattern: str) -> str | None:
    """A gitignore line as a Java regular expression over relative paths; None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    line, folder = line.lstrip("!"), line.endswith("/")
    line, anchored = line.strip("/"), "/" in line.strip("/") or line.startswith("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = line[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$")


def not_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last gitignore line that matches (if any) is a negation."""
    verdict = F.lit(True)
    for p in patterns:
        rule = ignore_rule(p)
        if rule:
            verdict = F.when(path.rlike(rule), F.lit(p.strip().startswith("!"))).otherwise(verdict)
    return verdict


def discover(files: DataFrame, max_bytes: int = MAX_BYTES, dirs=EXCLUDED_DIRS, suffixes=EXCLUDED_SUFFIXES, gitignore: list[str] = ()) -> DataFrame:
    """The files that indexing takes: known language, size, no excluded directory name or suffix, not ignored."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    keep = (F.col("size") <= max_bytes) & supported(F.col("path")) & ~F.arrays_overlap(folders, F.array(*map(F.lit, dirs)))
    keep &= reduce(lambda a, s: a & ~F.col("path").endswith(s), suffixes, F.lit(True))
    return files.filter(keep & not_ignored(F.col("path"), list(gitignore)))


def guard_links(root: str, paths: list[str]) -> list[str]:
    """The paths whose real place is under the real root; links that lead out are left out."""
    base = os.path.realpath(root)
    real = lambda p: os.path.realpath(os.path.join(root, p))
    return [p for p in paths if os.path.exists(real(p)) and os.path.commonpath([base, real(p)]) == base]


def resolve(workspaces: dict[str, str], path: str) -> tuple[str, str] | None:
    """(workspace, absolute path) of the alphabetically first workspace that holds the path; None outside all.

    Missing files are judged by their normalised path.
    """
    for name in sorted(workspaces):
        base = os.path.realpath(workspaces[name])
        full = os.path.join(base, path)
        real = os.path.realpath(full) if os.path.exists(full) else os.path.normpath(full)
        if os.path.commonpath([base, real]) == base:
            return name, real
    return None


def decode(files: DataFrame) -> DataFrame:
    """content as text; files that aren't UTF-8 drop out silently."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("content", text).filter(F.col("content").isNotNull())


def local_corpus(spark: SparkSession, root: str, extensions: list[str] = ()) -> DataFrame:
    """All files under ``root``; ``extensions`` (with dots) keeps only those, none keeps all."""
    files = scan(spark, root)
    return files.filter(reduce(lambda a, e: a | F.col("path").endswith(e), extensions, F.lit(False))) if extensions else files


def multi_corpus(corpora: list[DataFrame]) -> DataFrame:
    """UNION ALL of corpora; paths get the prefix corpus_<i>/."""
    marked = [c.withColumn("path", F.concat(F.lit(f"corpus_{i}/"), "path")) for i, c in enumerate(corpora)]
    return reduce(DataFrame.unionByName, marked)


def corpus(spark: SparkSession, config: dict) -> DataFrame:
    """A corpus by its configuration: one of kind 'local' (or a staged 'git' checkout), or a list of those."""
    if "corpora" in config:
        return multi_corpus([corpus(spark, c) for c in config["corpora"]])
    if config.get("type", "local") not in ("local", "git"):
        raise ValueError(f"unknown corpus type: {config['type']}")
    return local_corpus(spark, config["path"], config.get("extensions", []))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of every file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved files that are now missing or modified: (path, problem)."""
    joined = saved.alias("s").join(current.alias("c"), "path", "left")
    problem = F.when(F.col("c.sha256").isNull(), "missing").when(F.col("c.sha256") != F.col("s.sha256"), "modified")
    return joined.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def read_lines(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(line, text) of lines start..end, from 1 and inclusive, of one file of (path, content text).

    Reads at most 500 lines of a file of at most 2 MiB; the end is cut at the last line. A start beyond the
    file, below 1 or after the end is an error.
    """
    if start < 1 or end < start:
        raise ValueError("start must be at least 1 and not after end")
    if end - start + 1 > READ_LINES:
        raise ValueError(f"at most {READ_LINES} lines can be read at once")
    one = files.filter(F.col("path") == path).select(text_lines(F.col("content")).alias("lines"), F.octet_length("content").alias("bytes"))
    found = one.select(F.size("lines").alias("n"), "bytes").first()
    if not found:
        raise FileNotFoundError(path)
    if found.bytes > READ_BYTES:
        raise ValueError(f"{path} is larger than 2 MiB")
    if start > found.n:
        raise ValueError(f"start line {start} exceeds the {found.n} lines of {path}")
    return one.select(F.posexplode(F.slice("lines", start, end - start + 1)).alias("i", "text")).select((F.col("i") + start).alias("line"), "text")


def grep(files: DataFrame, pattern: str, limit: int = 50) -> tuple[DataFrame, int]:
    """Sorted "path:line:text" hits of a regular expression, the first ``limit``, and how many there are."""
    rows = files.select("path", F.posexplode(text_lines(F.col("content"))).alias("i", "text")).filter(F.col("text").rlike(pattern))
    hits = rows.select(F.concat_ws(":", "path", (F.col("i") + 1).cast("string"), "text").alias("hit"))
    return hits.orderBy("hit").limit(limit), hits.count()


def find_names(files: DataFrame, part: str, limit: int = 50) -> tuple[DataFrame, int]:
    """Sorted paths that contain ``part`` whatever the case; * and ? are wildcards."""
    rule = "(?i)" + "".join({"*": ".*", "?": "."}.get(c, "\\Q" + c + "\\E") for c in part)
    hits = files.select("path").filter(F.col("path").rlike(rule))
    return hits.orderBy("path").limit(limit), hits.count()


def list_dir(files: DataFrame, folder: str = "") -> DataFrame:
    """(name, type, size) of what lies directly in a folder."""
    base = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("path", len(base) + 1, 1 << 30)
    inside = files.filter(F.col("path").startswith(base)).select(F.split(rest, "/", 2).alias("p"), "size")
    return inside.groupBy(F.get("p", F.lit(0)).alias("name")).agg(F.when(F.max(F.size("p")) > 1, "dir").otherwise("file").alias("type"), F.sum("size").alias("size")).orderBy("name")


def corpus_summary(files: DataFrame) -> DataFrame:
    """One row: file_count, bytes and the sorted distinct languages."""
    known = F.when(supported(F.col("path")), language(F.col("path")))
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set(known)).alias("languages"))
