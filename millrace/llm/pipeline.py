"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever others there are and
however they are named. A stage's result is written as Parquet in the shared folder and read again as the next one's
input. In every stage a null text counts as empty, texts are taken whole however long, and an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language, linedup, neardup, packing
from millrace.llm.common import materialize, release, table, text_key

#: Languages to keep; None keeps all that the classifier knows.
LANGUAGES: tuple[str, ...] | None = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose predicted language is wanted (``LANGUAGES``) and plain.

    Null, empty and letterless texts have no language and go; so do texts whose nearest codeword is no nearer than the
    next (mostly a word or two), as their language can't be told. Rows are judged singly: repeated rows, null and tied
    ids fare alike. If no row has a label, nothing can be learned and only texts with letters are kept.
    """
    model = language.fit_documents(docs)
    found = language.identify(docs, model, added=("_mr_lang", "_mr_score", "_mr_near"))
    if not model.languages:
        return docs.filter(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    wanted = (F.col("_mr_lang") != "und") & ~F.col("_mr_near")
    if LANGUAGES is not None:
        wanted &= F.col("_mr_lang").isin(*LANGUAGES)
    return found.filter(wanted).select(*_named(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of all documents but the first; a document of which no word is left goes.

    n_chars follows the text. Null and empty texts lose nothing and stay. Rows with equal doc_id and text lose the
    same lines; null ids come last in deciding who is first, ties go to the smaller text hash.
    """
    out = linedup.strip(docs, ("_mr_lines", "_mr_drops"))
    lost = F.size("_mr_drops") > 0
    out = out.filter(~(lost & ~F.col("text").rlike(r"\S")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*_named(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates: of the smallest doc_id, then the smallest text key.

    Empty and null texts are one class, as are texts without words that are equal; rows that repeat an id and a text
    count as copies. A class of null ids keeps one of its rows.
    """
    kept = neardup.classes(docs).filter("representative").select("doc_id", "text_key").distinct()
    # a class keeps one text of its smallest id, which several rows can have
    kept = materialize(kept, "kept").withColumnsRenamed({"doc_id": "_mr_id", "text_key": "_mr_text"})
    keyed = docs.withColumn("_mr_key", text_key(F.col("text")))
    out = keyed.join(kept, (F.col("_mr_key") == F.col("_mr_text")) & F.col("doc_id").eqNullSafe(F.col("_mr_id")), "left_semi")
    return out.dropDuplicates(["_mr_key", "doc_id"]).select(*_named(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, repeated rows and null ids fare alike."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*_named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences; an empty text is an end token, repeated rows count singly."""
    return packing.pack_documents(docs, packing.default_tokenizer())


def _named(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("near_duplicates", drop_copies), ("decontamination", drop_benchmark), ("packing", pack)]
#: Trained models, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; a stage's table goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = made
    return docs
