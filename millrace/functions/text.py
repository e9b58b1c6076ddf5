"""Text expressions: query cleaning, enrichment, tokens and pattern filters. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a search query loses.
DELETED = '*^"():;-+'
# Precomposed letters and the plain letters that they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    """Lower case without diacritics: combining marks go, precomposed letters become plain ones."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order. ASCII texts take a shorter way to the same."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    parts = F.when(ascii_only, F.split(F.lower(text), r"[^a-z0-9]+")).otherwise(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"))
    return F.array_remove(parts, "")


def sanitize(query: Column) -> Column:
    """The quoted words of a query: operator characters are deleted, then it splits at white space."""
    words = F.filter(F.split(F.translate(F.coalesce(query, F.lit("")), DELETED, ""), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def sanitize_text(query: str) -> list[str]:
    """The words that ``sanitize`` quotes, for a query known on the driver."""
    return query.translate(str.maketrans("", "", DELETED)).split()


def enrich_query(query: Column) -> Column:
    """Queries of fewer than three words get the prefix "code that "."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) < 3, F.concat(F.lit("code that "), query)).otherwise(query)


def enrich_chunk(language: Column, path: Column, context: Column, symbol: Column, content: Column) -> Column:
    """What is embedded for a chunk: a header line of its place, then the content."""
    empty = F.lit("")
    return F.concat(language, F.lit(" | "), path, F.lit(" | "), F.coalesce(context, empty), F.lit(" | "), F.coalesce(symbol, empty), F.lit("\n"), content)


def path_prefix(path: Column, prefix: str, case_sensitive: bool = False) -> Column:
    """Starts-with on literal text (no wildcards). The default ignores ASCII case; the other form reaches Parquet."""
    if case_sensitive:
        return path.startswith(prefix)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(path, upper, lower).startswith(prefix.translate(str.maketrans(upper, lower)))


def escape_like(text: str) -> str:
    """A LIKE pattern that matches texts beginning with ``text``, its own wildcards taken literally."""
    return "".join("\\" + c if c in "\\%_" else c for c in text) + "%"


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final empty line does not count and a carriage return before the end goes."""
    parts = F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"\r$", ""))
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def preview(text: Column, lines: int = 5) -> Column:
    return F.array_join(F.slice(text_lines(text), 1, lines), "\n")
