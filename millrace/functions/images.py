"""Choice of pictures: which to show, and which candidate is the primary one after probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .urls import is_usable_image

#: Fixed value: probes after which, once there is a primary picture, the others may wait.
LEAST_PROBES = 3


def display_images(primary: Column, stored: Column, sources: Column) -> Column:
    """Usable pictures without repeats, in order: the article's own, the stored primary one, then sources (url, status) that were not skipped."""
    others = F.transform(F.filter(F.coalesce(sources, F.expr("cast(array() as array<struct<url:string,status:string>>)")), lambda s: F.coalesce(s["status"], F.lit("")) != "skipped"), lambda s: s["url"])
    return F.array_distinct(F.filter(F.concat(F.array(primary, stored), others), lambda u: u.isNotNull() & is_usable_image(u)))


def probe_states(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """(article_id, url, rank, state, is_primary) for candidates (article_id, url, rank) and probes (url, ok).

    Candidates are tried by rank. The first good one is the primary; with one, those after the third try are pending.
    A candidate without a probe counts as failed.
    """
    rows = candidates.join(probes.groupBy("url").agg(F.max("ok").alias("ok")), "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    order = Window.partitionBy("article_id").orderBy("rank", "url")
    rows = rows.withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_first", F.min(F.when(F.col("ok"), F.col("_n"))).over(Window.partitionBy("article_id")))
    tried = F.col("_first").isNull() | (F.col("_n") <= F.greatest(F.col("_first"), F.lit(LEAST_PROBES)))
    state = F.when(~tried, "pending").when(F.col("ok"), "ok").otherwise("failed")
    return rows.select("article_id", "url", "rank", state.alias("state"), F.coalesce(F.col("_n") == F.col("_first"), F.lit(False)).alias("is_primary"))


def image_status(articles: DataFrame, states: DataFrame) -> DataFrame:
    """(article_id, primary_url, image_status): ok, failed if no candidate was good, missing without any."""
    found = states.groupBy("article_id").agg(F.max(F.when(F.col("is_primary"), F.col("url"))).alias("primary_url"))
    rows = articles.select(F.col("id").alias("article_id")).join(found.withColumn("_any", F.lit(True)), "article_id", "left")
    return rows.select("article_id", "primary_url", F.when(F.col("_any").isNull(), "missing").when(F.col("primary_url").isNull(), "failed").otherwise("ok").alias("image_status"))


def is_video(method: Column, url: Column) -> Column:
    return F.coalesce(F.lower(method) == "youtube", F.lit(False)) | F.coalesce(F.lower(url).contains("watch"), F.lit(False))


def source_relevance(source_type: Column, relevance: Column) -> Column:
    """A video source counts as Excellent unless it says so already."""
    said = F.lower(F.coalesce(relevance, F.lit(""))).startswith("excellent")
    return F.when((F.lower(source_type) == "video") & ~said, "Excellent").otherwise(relevance)
