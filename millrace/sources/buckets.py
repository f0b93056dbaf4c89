"""Tables bucketed on the key that they are merged by, so that a merge shuffles the new rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.storage import scratch


def write_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Replaces a table of the catalogue by rows in so many buckets of keys, sorted in each.

    The new table is whole, in a folder of its own, before the name goes over to it, so rows may come from the old table
    itself. Take a number of buckets that fits the table in years to come: it is the number of tasks of each merge.
    """
    spark, fresh = rows.sparkSession, f"{table}__next"
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    writer = rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch(spark, table)).saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table, which Spark knows to be parted by its keys: joins, anti joins and aggregations on them do not shuffle it."""
    return spark.table(table)
