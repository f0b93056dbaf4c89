"""A corpus pipeline over documents: language ID, line dedup, near-duplicate join, decontamination, packing.

Every stage but the last returns the columns of documents. Each is written as Parquet and read again before the next,
so a stage's docs are a plain scan. Null texts and texts without a letter have no language and leave in the first stage;
repeated rows count as copies of each other; columns besides those of documents are carried along by every stage but
the last; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from millrace.llm._shared import scan_ids, short_batches, table, written

#: A document is rejected if its language is unknown or less probable than this.
LEAST_PROBABILITY = 0.5


def _beside(docs: DataFrame, names: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs alone; those called as one of names, which an operator uses itself, step aside meanwhile."""
    short_batches(docs.sparkSession)
    aside = {c: f"{c}__kept" for c in docs.columns if c in names}
    out = work(docs.withColumnsRenamed(aside)).drop(*names)
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows, and gives them the language it predicts. Null texts and texts without a letter go."""
    short_batches(spark)
    model = language_id.train(docs.filter(F.col("doc_id").isNotNull() & ~language_id.held_out()))

    def known(rows: DataFrame) -> DataFrame:
        found = language_id.identify(rows, model).filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_PROBABILITY))
        return found.withColumn("lang", F.col("lang_pred"))

    return _beside(docs, ["lang_pred", "score", "__text"], known)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat an earlier one, and documents of which nothing but blank lines is left; n_chars is counted anew."""

    def deduplicated(rows: DataFrame) -> DataFrame:
        found = line_dedup.dedup_lines(scan_ids(rows, "_row"), row_id="_row").filter(F.col("text").rlike(r"\S"))
        return found.withColumn("n_chars", F.length("text").cast("long"))

    return _beside(docs, ["n_lines", "n_dropped", "_rid", "_text", "_dropped", "_row", "_file", "_number"], deduplicated)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of the least doc_id; texts without words are no duplicates."""
    return _beside(docs, ["_row", "_rid", "_file", "_number"], lambda rows: ngram_join.keep_first(scan_ids(rows, "_row"), row_id="_row"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold most words of a benchmark item; null and empty texts hold none."""
    items = table(spark, sf_dir, "benchmark")
    return _beside(docs, ["_row", "_rid", "_file", "_number"], lambda rows: decontaminate.clean(scan_ids(rows, "_row"), items, row_id="_row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens."""
    short_batches(spark)
    packed = packing.pack(docs, packing.default_tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: SQL can express none of the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
