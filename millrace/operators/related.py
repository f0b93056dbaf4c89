"""Related articles: pairs that share a vehicle or a place, the best few for each article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 5


def relation_keys(entities: DataFrame, geography: DataFrame) -> DataFrame:
    """Distinct (article_id, key, reason, score) of vehicles that an article is about, and of its events and circuits."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    generation = F.col("kind") == "generation"
    vehicles = entities.filter(F.col("kind").isin("model", "generation") & F.col("relevance").isin("about", "relevant")).select(
        "article_id", F.concat_ws("::", low("make"), F.lower(F.coalesce("model", "name")), F.when(generation, F.lower("name")).otherwise("")).alias("key"),
        F.when(generation, "same-generation").otherwise("same-vehicle").alias("reason"), F.when(generation, 90).otherwise(80).alias("score"),
    )
    places = geography.filter(F.col("kind").isin("event", "circuit")).select("article_id", F.concat_ws("::", "kind", "slug").alias("key"), F.lit("same-event").alias("reason"), F.lit(70).alias("score"))
    return vehicles.unionByName(places).distinct()


def related_articles(keys: DataFrame, articles: DataFrame, most: int = MOST) -> DataFrame:
    """(article_id, related_article_id, reason, score, position): score descending, then the smaller id; at most `most`.

    As the order within one key is by id alone, only the most + 1 smallest ids of a key can be anyone's best (one more
    for the article itself). So each article meets that many others per key, however many share it.
    """
    known = keys.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    # the smallest few of a key, by partial sorts in salted parts: no task needs all rows of a hot key
    least = lambda rows, *keys: rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("article_id"))).filter(F.col("_n") <= most + 1).select(*keys, "article_id").distinct()
    salted = least(known.select("key", "article_id", F.pmod(F.xxhash64("article_id"), F.lit(64)).alias("salt")), "key", "salt")
    few = least(salted.select("key", "article_id"), "key").groupBy("key").agg(F.collect_list("article_id").alias("few"))
    pairs = known.join(few, "key").select("article_id", F.explode("few").alias("related_article_id"), "reason", "score").filter("article_id != related_article_id")
    best = pairs.groupBy("article_id", "related_article_id").agg(F.max("score").alias("score"), F.max_by("reason", "score").alias("reason"))
    order = Window.partitionBy("article_id").orderBy(F.desc("score"), "related_article_id")
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def with_titles(related: DataFrame, articles: DataFrame) -> DataFrame:
    """Per article the list of its related ones that still exist: (id, title, reason, score), best first."""
    named = related.join(articles.select(F.col("id").alias("related_article_id"), "title"), "related_article_id")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "related_article_id", "title", "reason")))
    return named.groupBy("article_id").agg(listed.alias("related"))
