"""Sinks: tables replaced by partition, so that a job may run again without leaving doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of `key` that df has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_ranked_lists(lists: DataFrame, path: str) -> None:
    replace_partitions(lists, path, "list_key")


def write_daily(rollup: DataFrame, path: str) -> None:
    replace_partitions(rollup, path, "day")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_daily(), with day as the string that was written."""
    rows = spark.read.parquet(path)
    return rows.withColumn("day", F.col("day").cast("string"))


def sitemap_entries(articles: DataFrame, sources: DataFrame, live_picks: DataFrame, static: DataFrame) -> DataFrame:
    """(loc, lastmod): stories of enabled sources that are eligible or live picks, and the static pages."""
    rows = articles.join(sources.filter("enabled").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    picked = live_picks.select(F.col("article_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    rows = rows.join(picked, "id", "left").filter("reason is null or _p")
    return rows.select(F.concat(F.lit("/story/"), F.col("id").cast("string")).alias("loc"), F.coalesce("last_processed", "published_at").alias("lastmod")).unionByName(static.select("loc", "lastmod"))


def live_picks(picks: DataFrame, now_ms: int, labels: list[str] = ("Editor's pick",)) -> DataFrame:
    """Picks that are active and not expired; an unknown label becomes the first, a blank note null."""
    live = picks.filter(F.col("active") & (F.coalesce("expires_at", F.lit(0)).isin(0) | (F.col("expires_at") > now_ms)))
    return live.withColumns({"label": F.when(F.col("label").isin(*labels), F.col("label")).otherwise(labels[0]), "note": F.nullif(F.trim("note"), F.lit(""))})


def homepage_picks(picks: DataFrame, n: int = 3) -> DataFrame:
    return picks.orderBy("sort_order", F.desc("featured"), F.desc("selected_at"), "article_id").limit(n)
