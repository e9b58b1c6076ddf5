"""Syntax chunks, symbol graph and outlines.

Python sources go through the ``ast`` module. Brace languages are read by a scanner that masks strings and
comments and matches declarations and braces; Ruby by indentation of ``end``. The scanner sees top-level
declarations and one level inside them; it is no full parser, and a file in which it finds nothing falls
back to line windows. Everything runs per file in Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.chunking import OVERLAP, WINDOW, as_chunks, line_windows

SMALLEST, LARGEST = 100, 2000
_ID = r"[A-Za-z_$][\w$]*"
# Declarations of each language family, as (kind, pattern); the group is the name.
_JS = [("function_declaration", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("class_declaration", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"), ("arrow_function", rf"(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>")]
_TS = [*_JS, ("interface_declaration", rf"(?:export\s+)?(?:default\s+)?interface\s+({_ID})"), ("enum_declaration", rf"(?:export\s+)?(?:const\s+)?enum\s+({_ID})"), ("type_alias_declaration", rf"(?:export\s+)?type\s+({_ID})\s*(?:<[^=]*>)?\s*=")]
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|open|data|inline|suspend|fileprivate|mutating)\s+)*"
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS, "jsx": _JS, "typescript": _TS, "tsx": _TS,
    "rust": [("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)"), ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("impl_item", r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("mod_item", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)")],
    "go": [("function_declaration", r"func\s+(\w+)"), ("method_declaration", r"func\s+\([^)]*\)\s*(\w+)"), ("type_declaration", r"type\s+(\w+)")],
    "java": [("class_declaration", rf"{_MODS}(?:class|record)\s+(\w+)"), ("interface_declaration", rf"{_MODS}interface\s+(\w+)"), ("enum_declaration", rf"{_MODS}enum\s+(\w+)"), ("method_declaration", rf"{_MODS}[\w<>\[\], ]+\s+(\w+)\s*\([^;{{]*\)\s*(?:throws [\w, ]+)?\s*(?={{)")],
    "csharp": [("namespace_declaration", r"namespace\s+([\w.]+)"), ("class_declaration", rf"{_MODS}(?:class|record|struct)\s+(\w+)"), ("interface_declaration", rf"{_MODS}interface\s+(\w+)"), ("enum_declaration", rf"{_MODS}enum\s+(\w+)"), ("method_declaration", rf"{_MODS}[\w<>\[\],? ]+\s+(\w+)\s*\([^;{{]*\)\s*(?={{)")],
    "c": [("struct_specifier", r"(?:typedef\s+)?struct\s+(\w+)\s*(?={)"), ("function_definition", r"[\w*\s]+?\b(\w+)\s*\([^;{]*\)\s*(?={)")],
    "cpp": [("namespace_definition", r"namespace\s+(\w+)"), ("class_specifier", r"class\s+(\w+)[^;{]*(?={)"), ("struct_specifier", r"struct\s+(\w+)[^;{]*(?={)"), ("function_definition", r"[\w:*&<>,~\s]+?\b(~?\w+)\s*\([^;{]*\)\s*(?:const\s*)?(?={)")],
    "swift": [("function_declaration", rf"{_MODS}func\s+(\w+)"), ("class_declaration", rf"{_MODS}(?:class|struct|extension)\s+(\w+)"), ("protocol_declaration", rf"{_MODS}protocol\s+(\w+)"), ("enum_declaration", rf"{_MODS}enum\s+(\w+)")],
    "kotlin": [("function_declaration", rf"{_MODS}fun\s+(?:<[^>]*>\s+)?(?:\w+\.)?(\w+)"), ("class_declaration", rf"{_MODS}(?:class|interface|enum class)\s+(\w+)"), ("object_declaration", rf"{_MODS}object\s+(\w+)")],
    "ruby": [("class", r"class\s+([\w:]+)"), ("module", r"module\s+([\w:]+)"), ("singleton_method", r"def\s+self\.([\w?!=]+)"), ("method", r"def\s+([\w?!=]+)")],
}
CONTAINERS = {"class_definition", "class_declaration", "impl_item", "class", "class_specifier", "trait_item", "module", "mod_item", "namespace_declaration", "namespace_definition", "interface_declaration", "struct_specifier", "protocol_declaration", "object_declaration"}
# Words before a parenthesis that are no calls.
_NO_CALL = {"if", "for", "while", "switch", "match", "return", "catch", "fn", "function", "def", "class", "super", "sizeof", "await", "typeof", "new", "in", "and", "or", "not", "func", "fun", "elif", "when", "do", "else", "with", "lambda", "assert", "print"} - {"print"}
_IMPORTS = {"rust": r"^\s*(?:pub\s+)?use\s+([^;]+);", "javascript": r"^\s*import\s+(?:([^'\"]+?)\s+from\s+)?['\"]([^'\"]+)['\"]"}


@dataclass
class Node:
    kind: str
    name: str | None
    start: int  # character offsets; end is exclusive
    end: int
    children: list[Node] = field(default_factory=list)


def mask(text: str, language: str) -> str:
    """The text with the inside of comments and strings blanked, offsets kept."""
    hash_comment = language in ("python", "ruby")
    rule = r"#[^\n]*" if hash_comment else r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    quotes = r"\"(?:\\.|[^\"\\\n])*\"" + ("" if language == "rust" else r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
    blank = lambda m: "".join("\n" if c == "\n" else " " for c in m[0])
    return re.sub(f"{rule}|{quotes}", blank, text, flags=re.S)


def _close(text: str, start: int, stop: int) -> int:
    """End of the declaration that starts at ``start``: after its braces, else after ; or the line."""
    brace, semi, line = (text.find(c, start, stop) for c in "{;\n")
    if brace < 0 or 0 <= semi < brace:
        return semi + 1 if semi >= 0 else (line if line >= 0 else stop)
    depth = 0
    for i in range(brace, stop):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return i + 1
    return stop


def _ruby_close(text: str, start: int, stop: int) -> int:
    line = text.rfind("\n", 0, start) + 1
    indent = text[line:start]
    m = re.compile(rf"^{re.escape(indent)}end\b", re.M).search(text, start, stop)
    return m.end() if m else stop


def scan(text: str, language: str, start: int = 0, stop: int | None = None, depth: int = 0) -> list[Node]:
    """Declarations between two offsets in order, and those one level inside containers."""
    stop = len(text) if stop is None else stop
    rules = [(k, re.compile(p)) for k, p in DECLARATIONS.get(language, [])]
    out, at, level = [], start, 0
    for m in re.finditer(r"[{}]|^[ \t]*(?=\S)", text[start:stop], re.M):
        pos = start + m.end()
        if m[0] == "{" or m[0] == "}":
            if start + m.start() >= at:
                level += 1 if m[0] == "{" else -1
            continue
        if pos < at or level > 0:
            continue
        for kind, rule in rules:
            hit = rule.match(text, pos, stop)
            if hit and hit[1] not in _NO_CALL:
                end = (_ruby_close if language == "ruby" else _close)(text, pos, stop)
                node = Node(kind, hit[1], pos, end)
                if kind in CONTAINERS and depth < 1:
                    body = text.find("\n", pos, end) if language == "ruby" else text.find("{", pos, end)
                    node.children = scan(text, language, body + 1, end - 1, depth + 1) if body >= 0 else []
                out.append(node)
                at = end
                break
    return out


def python_nodes(text: str) -> list[Node]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    offset = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))

    def make(n) -> Node:
        first = min([n, *n.decorator_list], key=lambda x: (x.lineno, x.col_offset))
        kind = "decorated_definition" if n.decorator_list else "class_definition" if isinstance(n, ast.ClassDef) else "function_definition"
        begin = offset(first.lineno, first.col_offset) - (1 if n.decorator_list else 0)
        return Node(kind, n.name, begin, offset(n.end_lineno, n.end_col_offset), [make(c) for c in n.body if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)])

    return [make(n) for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]


def parse(text: str, language: str) -> list[Node]:
    """Top-level declarations of a source text, in order."""
    return python_nodes(text) if language == "python" else scan(mask(text, language), language)


def _windows(text: str, node: Node) -> Iterator[tuple[int, int]]:
    """50-line windows inside a node, 40 apart, none under 100 bytes; a trailing overlap may come out too."""
    edges = [node.start, *(m.end() for m in re.finditer("\n", text[node.start : node.end]))]
    edges = [edges[0], *(node.start + e for e in edges[1:]), node.end]
    n = len(edges) - 1
    for i in range(0, n, WINDOW - OVERLAP):
        a, z = edges[i], edges[min(i + WINDOW, n)]
        if len(text[a:z].encode()) >= SMALLEST:
            yield a, z


def syntax_chunks(text: str, language: str) -> list[tuple[int, int, str | None, str, str | None]]:
    """(start, end, symbol, kind, parent context) of a file: top-level declarations by size in bytes."""
    out = []
    for node in parse(text, language):
        size = len(text[node.start : node.end].encode())
        if size < SMALLEST:
            continue
        if size <= LARGEST:
            out.append((node.start, node.end, node.name, node.kind, None))
        elif node.children:
            out += [(c.start, c.end, c.name, c.kind, node.name if node.kind in CONTAINERS else None) for c in node.children]
        else:
            out += [(a, z, node.name, node.kind, None) for a, z in _windows(text, node)]
    return out


#: Languages whose files can have syntax chunks, and those whose files can have more in the graph than a module.
PARSED = {"python", *DECLARATIONS}
GRAPHED = {"python", "rust", "typescript", "tsx", "javascript", "jsx"}


def chunk_files(files: DataFrame, languages: set[str] = PARSED) -> DataFrame:
    """The chunk relation of (path, content, language, mtime) files; files without syntax chunks get line windows.

    Only files of languages that can be parsed go through Python; with ``languages``, those that occur, none at all
    if no such language does.
    """
    schema = "path string, language string, mtime long, start_line int, end_line int, byte_start int, byte_end int, symbol string, kind string, content string, parent_context string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f in pdf.itertuples():
                for a, z, symbol, kind, parent in syntax_chunks(f.content, f.language):
                    first = f.content.count("\n", 0, a) + 1
                    lead, body = len(f.content[:a].encode()), f.content[a:z]
                    rows.append((f.path, f.language, f.mtime, first, first + body.rstrip("\n").count("\n"), lead, lead + len(body.encode()), symbol, kind, body, parent))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    every = files.select("path", "content", "language", F.col("mtime").cast("long").alias("mtime"))
    known = F.coalesce(F.col("language").isin(*sorted(PARSED)), F.lit(False))
    if not PARSED & languages:
        return line_windows(every)
    source = every.filter(known)
    parsed = as_chunks(source.mapInPandas(run, schema))
    rest = source.join(parsed.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    return parsed.unionByName(line_windows(rest)).unionByName(line_windows(every.filter(~known)))


def file_graph(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """(id, symbol, kind, file) nodes and (source_id, target, type) edges of one file.

    A module node stands for the file. Calls belong to the innermost declaration around them; imports to the module.
    """
    module = sha256(path.encode()).hexdigest()
    name = lambda n: sha256(f"{path}|{n}".encode()).hexdigest()
    nodes, edges, spans = [(module, path, "module", path)], [], []

    def walk(items: list[Node]) -> None:
        for n in items:
            if n.name and n.kind != "impl_item":
                nodes.append((name(n.name), n.name, n.kind, path))
                spans.append((n.start, n.end, name(n.name)))
            walk(n.children)

    if language not in GRAPHED:
        return nodes, edges
    walk(parse(text, language))
    plain = mask(text, language)
    declared = {m.end() for n in ("def", "fn", "function", "class") for m in re.finditer(rf"\b{n}\s+(?=\w)", plain)}
    for m in re.finditer(r"(?<![\w$])([A-Za-z_$][\w$]*)!?\s*\(", plain):
        if m[1] not in _NO_CALL and m.start(1) not in declared:
            inner = [(e - s, k) for s, e, k in spans if s <= m.start() < e]
            edges.append((min(inner)[1] if inner else module, m[1], "call"))
    if language == "python":
        for m in re.finditer(r"^\s*(?:from\s+[\w.]+\s+)?import\s+\(?([^)#\n]+)", text, re.M):
            edges += [(module, x.split(" as ")[0].strip(), "import") for x in m[1].split(",") if x.strip() and x.strip() != "*"]
    elif language == "rust":
        for m in re.finditer(_IMPORTS["rust"], text, re.M):
            head, _, inner = m[1].partition("{")
            names = inner.rstrip("}").split(",") if inner else [head.split("::")[-1]]
            edges += [(module, x.split(" as ")[0].strip().split("::")[-1], "import") for x in names if x.strip()]
    else:
        for m in re.finditer(_IMPORTS["javascript"], text, re.M):
            names = re.findall(_ID, re.sub(r"\b(?:as\s+\w+|type)\b", "", m[1] or "")) or [m[2]]
            edges += [(module, x, "import") for x in names]
    return nodes, edges


def extract_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and edge relations of (path, content, language) files."""
    schema = "nodes array<struct<id:string,symbol:string,kind:string,file_path:string>>, edges array<struct<source_id:string,target_symbol:string,edge_type:string>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            both = [file_graph(f.path, f.content, f.language) for f in pdf.itertuples()]
            keys = (("id", "symbol", "kind", "file_path"), ("source_id", "target_symbol", "edge_type"))
            yield pd.DataFrame({c: [[dict(zip(k, r, strict=True)) for r in b[i]] for b in both] for i, (c, k) in enumerate(zip(("nodes", "edges"), keys, strict=True))})

    made = files.select("path", "content", "language").mapInPandas(run, schema)
    return made.select(F.inline("nodes")).dropDuplicates(["id"]), made.select(F.inline("edges"))


def modules(files: DataFrame) -> DataFrame:
    """The node relation of (path) files that have only their module nodes."""
    return files.select(F.sha2("path", 256).alias("id"), F.col("path").alias("symbol"), F.lit("module").alias("kind"), F.col("path").alias("file_path")).dropDuplicates(["id"])


def outline_file(text: str, language: str) -> list[tuple[str, str, str, int, str | None]]:
    """(kind, name, signature up to the body, start line, visibility) of top-level items and methods."""
    out = []

    def add(nodes: list[Node]) -> None:
        for n in nodes:
            body = text[n.start : n.end]
            if language == "python":
                lines = body.split("\n")
                first = next((i for i, x in enumerate(lines) if not x.lstrip().startswith("@")), 0)
                cut = re.match(r".*?:\s*(?:#.*)?$", "\n".join(lines[first:]), re.S | re.M)
                signature = (cut[0] if cut else lines[first]).rstrip().rstrip(":")
                visibility = None
            else:
                signature = re.split(r"[{;]", body, maxsplit=1)[0].strip()
                seen = re.match(r"(pub(?:\([^)]*\))?|export|public|private|protected)\b", signature)
                visibility = seen[1] if seen else None
            out.append((n.kind, n.name, " ".join(signature.split()), text.count("\n", 0, n.start) + 1, visibility))
            add(n.children)

    if language in ("python", "rust", "typescript", "tsx", "javascript", "jsx"):
        add(parse(text, language))
    return out


def outline(files: DataFrame) -> DataFrame:
    """(path, kind, name, signature, start_line, visibility) of (path, content, language) files."""
    schema = "path string, kind string, name string, signature string, start_line int, visibility string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(f.path, *x) for f in pdf.itertuples() for x in outline_file(f.content, f.language)], columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content", "language").mapInPandas(run, schema)
