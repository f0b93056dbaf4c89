"""Helpers that several operators of this package use: tables, row ids, and what the library has for stored tables and their sizes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import BROADCAST_BYTES, ROWS_A_BATCH, measured_bytes, renamed, scratch, short_batches, sized_broadcast, written

__all__ = ["BROADCAST_BYTES", "ROWS_A_BATCH", "measured_bytes", "renamed", "row_ids", "scan_ids", "scratch", "short_batches", "sized_broadcast", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_ids(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with a long that tells repeated rows apart. The rows are written with it once, so every later job reads the same."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def scan_ids(docs: DataFrame, name: str = "rid") -> DataFrame:
    """As row_ids(), but without writing the rows. docs must be a plain scan of Parquet files: filters and selections at most.

    The id is the number of the row's file and its place in that file, which no split of the files changes. The list of
    files goes to every task while it is small; beyond that, and where rows come from no file, the rows are written.
    """
    file = F.col("_metadata.file_path")
    try:
        found = docs.select(file.alias("_file")).distinct()
    except AnalysisException:  # no file source
        return row_ids(docs, name)
    files = written(found.repartition(1).sortWithinPartitions("_file").withColumn("_number", F.monotonically_increasing_id()), "files")
    if measured_bytes(files) > BROADCAST_BYTES:
        return row_ids(docs, name)
    numbered = docs.withColumns({"_file": file, name: F.col("_metadata.row_index")}).join(F.broadcast(files), "_file")
    return numbered.withColumn(name, F.shiftleft("_number", 40) + F.col(name)).drop("_file", "_number")
