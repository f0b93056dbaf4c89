"""Article features from child rows, and reports on them: arrays in order, coverage, terms, rewritten interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrays made of entities, by kind.
ENTITY_ARRAYS = {"makes": "make", "models": "model", "generations": "generation", "variants": "variant"}


def _in_order(rule: Column, value: Column) -> Column:
    """Values of the rows that fit, in the order of pos; repeats stay."""
    return F.transform(F.sort_array(F.collect_list(F.when(rule & value.isNotNull(), F.struct("pos", value.alias("v"))))), lambda x: x["v"])


def article_features(articles: DataFrame, entities: DataFrame, tags: DataFrame) -> DataFrame:
    """articles with arrays of their child rows, each in insertion order (pos) and with repeats; none is an empty array.

    entities: article_id, pos, kind, name, make, model, relevance. tags: article_id, kind, pos, value; each kind of tag
    (such as interests, categories, scenes) becomes a column of that name. One shuffle for each of the two tables.
    """
    kinds = sorted(r.kind for r in tags.select("kind").distinct().collect())  # names of columns, a fixed few
    hit = F.struct("pos", F.struct("kind", "name", "make", "model", "relevance").alias("v"))
    e = entities.groupBy("article_id").agg(*[_in_order(F.col("kind") == kind, F.col("name")).alias(column) for column, kind in ENTITY_ARRAYS.items()], F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["v"]).alias("entity_hits"))
    t = tags.groupBy("article_id").agg(F.count("*").alias("_n"), *[_in_order(F.col("kind") == kind, F.col("value")).alias(kind) for kind in kinds]).drop("_n")
    rows = articles.join(e.withColumnRenamed("article_id", "id"), "id", "left").join(t.withColumnRenamed("article_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, none) for c in (*ENTITY_ARRAYS, *kinds)})


def attribute_map(attributes: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, attributes map) of rows (key, id, attribute, value); of one attribute's rows the last by id counts, of equal ids the greater value."""
    latest = attributes.groupBy(key, "attribute").agg(F.max_by("value", F.struct("id", "value")).alias("value"))
    return latest.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))


def entity_coverage(articles: DataFrame, entities: DataFrame, make: str) -> DataFrame:
    """One row: articles, those with a make, with a model, with the given make, and with that make and a model of it."""
    mine = F.lower("make") == make.lower()
    has = lambda rule: F.max(F.coalesce(rule, F.lit(False)))
    per = entities.groupBy("article_id").agg(has(F.col("kind") == "make").alias("a"), has(F.col("kind") == "model").alias("b"), has(mine).alias("c"), has(mine & (F.col("kind") == "model")).alias("d"))
    rows = articles.select(F.col("id").alias("article_id")).join(per, "article_id", "left")
    return rows.agg(F.count("*").alias("articles"), *[F.count(F.when(F.col(c), 1)).alias(name) for c, name in zip("abcd", ("with_make", "with_model", "with_given_make", "with_given_model"), strict=True)])


def top_terms(articles: DataFrame, kinds: list[str] = ("categories", "interests", "makes"), themes: int = 5) -> DataFrame:
    """(kind, term, n, position, is_theme) over the arrays of articles: most frequent first, ties by name; the first few are themes."""
    def named(kind: str) -> Column:
        return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))

    entries = F.flatten(F.array(*map(named, kinds)))
    counted = articles.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "term")  # distinct terms only
    return counted.withColumn("position", F.row_number().over(order)).withColumn("is_theme", F.col("position") <= themes)


def rewrite_interests(interests: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rewritten, changed): interests (article_id, interest) by their known names, unknown ones dropped, none twice; and articles whose set differs.

    names: lower-case alias or name -> name.
    """
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = interests.withColumn("new", F.try_element_at(table, F.lower(F.trim("interest"))))
    rewritten = rows.filter("new is not null").select("article_id", F.col("new").alias("interest")).dropDuplicates()
    sets = rows.groupBy("article_id").agg(F.sort_array(F.collect_list("interest")).alias("before"), F.sort_array(F.collect_set("new")).alias("after"))
    return rewritten, sets.filter(F.col("before") != F.col("after"))


def without_rows(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents (id) that have no child: live sources without products, articles without a section."""
    return parents.join(children.select(F.col(key).alias("id")), "id", "left_anti")


def union_facets(live: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(make, model) of both; names in any case are one, and the live spelling counts."""
    rows = live.select("make", "model", F.lit(0).alias("o")).unionByName(gazetteer.select("make", "model", F.lit(1).alias("o")))
    keys = [F.lower("make").alias("a"), F.lower(F.coalesce("model", F.lit(""))).alias("b")]
    return rows.groupBy(*keys).agg(F.min(F.struct("o", "make", "model")).alias("x")).select("x.make", "x.model")


def latest(rows: DataFrame, first: str, second: str, n: int) -> DataFrame:
    """The newest n rows by two time stamps; a partial sort in each task."""
    return rows.orderBy(F.desc_nulls_last(first), F.desc_nulls_last(second)).limit(n)
