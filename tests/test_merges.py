"""Merges into bucketed tables: the stored side is not shuffled, and the rows are those of plain tables. Jobs with hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import classify as cl
from millrace.operators import ingest as ing
from millrace.operators import ranking as rk
from millrace.sources import buckets


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def stored(spark, rows, name, keys):
    buckets.write_bucketed(rows, name, keys, 4)
    return buckets.read_bucketed(spark, name)


def shuffles_of(df, table):
    """Exchanges of the plan that stand above a scan of the table, before it is joined."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if table in line)
    depth = lambda line: len(re.match(r"[\s:+|*()\d-]*", line)[0])
    found, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            now = depth(line)
            if "Join" in line:
                break
            found += ["Exchange"] if "Exchange" in line else []
    return found


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_merges_do_not_shuffle_the_stored_side(no_broadcast):
    spark, rng = no_broadcast, random.Random(1)
    url = lambda n: f"https://x.example.com/{n}"
    old = spark.createDataFrame([(url(n), f"t{n}", url(n), rng.choice([None, "https://x/a.jpg"]), 1, 2) for n in range(200)], "canonical_url string, title string, url string, image_url string, first_seen long, last_seen long")
    new = spark.createDataFrame([(url(n), f"n{n}", url(n), "https://x/b.jpg") for n in range(150, 260)] * 2, "canonical_url string, title string, url string, image_url string")
    table = stored(spark, old, "merge_articles_table", ["canonical_url"])
    merged = ing.merge_articles(table, new, 9)
    assert rows_of(merged) == rows_of(ing.merge_articles(old, new, 9)) and merged.count() == 260
    assert shuffles_of(merged, "merge_articles_table") == [] and shuffles_of(ing.merge_articles(old.repartition(3), new, 9), "Scan ExistingRDD[canonical_url") != []
    buckets.write_bucketed(merged, "merge_articles_table", ["canonical_url"], 4)  # from the table itself
    assert spark.table("merge_articles_table").count() == 260 and spark.table("merge_articles_table").filter("last_seen = 9").count() == 110

    products = spark.createDataFrame([(f"s{n % 20}", n) for n in range(200)], "source_id string, product_id long")
    fresh = spark.createDataFrame([("s3", 999), ("s77", 1)], "source_id string, product_id long")
    table = stored(spark, products, "replace_table", ["source_id"])
    replaced = ing.replace_by_source(table, fresh)
    assert rows_of(replaced) == rows_of(ing.replace_by_source(products, fresh)) and shuffles_of(replaced, "replace_table") == []

    tags = spark.createDataFrame([(n % 50, f"t{n}") for n in range(200)], "article_id long, tag string")
    table = stored(spark, tags, "cascade_table", ["article_id"])
    gone = spark.createDataFrame([(3,), (7,), (1000,)], "article_id long")
    left = ing.cascade_delete({"tags": (table, ["article_id"])}, gone)["tags"]
    assert rows_of(left) == rows_of(ing.cascade_delete({"tags": (tags, ["article_id"])}, gone)["tags"]) and left.count() == 192 and shuffles_of(left, "cascade_table") == []

    primary = spark.createDataFrame([(n, "cars", 50, rng.choice(["rule", "manual", "ai"])) for n in range(100)], "article_id long, primary_slug string, confidence int, source string")
    update = spark.createDataFrame([(n, "events", 80, "rule") for n in range(50, 130)], primary.schema)
    table = stored(spark, primary, "primary_table", ["article_id"])
    merged = cl.merge_primary(table, update)
    by_id = {r.article_id: (r.primary_slug, r.source) for r in merged.collect()}
    assert len(by_id) == 130 and shuffles_of(merged, "primary_table") == []
    assert all(by_id[r.article_id] == (("cars", r.source) if r.article_id < 50 or r.source != "rule" else ("events", "rule")) for r in primary.collect())


def test_hot_sources_and_titles(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(rng.choice(["hot", "hot", "hot", "a", None]), i) for i in range(300)], "source_id string, feed_pos int")
    limits = spark.createDataFrame([("hot", 3), ("a", 20)], "source_id string, max_articles int")
    kept = ing.cap_per_source(items, limits, 8)
    assert sorted((r.source_id or "", r.n) for r in kept.groupBy("source_id").agg(F.count("*").alias("n")).collect()) == [("", 8), ("a", 20), ("hot", 3)]
    assert [r.feed_pos for r in kept.filter("source_id = 'hot'").orderBy("feed_pos").collect()] == [r.feed_pos for r in items.filter("source_id = 'hot'").orderBy("feed_pos").limit(3).collect()]
    census = ing.image_census(items.select(F.col("source_id").alias("publication"), F.col("feed_pos").alias("id"), F.when(F.col("feed_pos") % 2 == 0, "https://x/a.jpg").alias("image_url")))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString() and "WindowGroupLimit" in census._jdf.queryExecution().executedPlan().toString()
    all_rows = items.collect()
    for r in census.collect():
        mine = sorted(x.feed_pos for x in all_rows if x.source_id == r.publication)
        assert (r.total, r.missing, r.samples) == (len(mine), sum(x % 2 for x in mine), [x for x in mine if x % 2][:3])
    titles = [(i, rng.choice(["Hot News!", "hot news", "Other", "", None]), rng.choice([None, None, "", f"g{i}"])) for i in range(200)]
    grouped = ing.duplicate_groups(spark.createDataFrame(titles, "id long, title string, duplicate_group_id string"))
    known = {}
    for i, t, g in titles:
        k = {"Hot News!": "hot news", "hot news": "hot news", "Other": "other"}.get(t)
        if k and g:
            known.setdefault(k, g)
    want = {i: known.get(k, k) if (k := {"Hot News!": "hot news", "hot news": "hot news", "Other": "other"}.get(t)) else None for i, t, _ in titles}
    assert {r.id: r.duplicate_group_id for r in grouped.collect()} == want and "Window" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_diversify_against_a_list_at_a_time(spark):
    rng = random.Random(3)
    rows = [(f"l{k}", i + 1, k * 100 + i, rng.choice(["a", "a", "a", "b", "", None]) if k % 2 else ("a" if i < 5 + k else rng.choice(["a", "b", "", None]))) for k in range(12) for i in range(rng.choice([3, 5, 6, 20]))]
    found = rk.diversify(spark.createDataFrame(rows, "list_key string, position int, id long, make string"), ["list_key"], "make")
    for k in {r[0] for r in rows}:
        listed = sorted((p, i, m or "") for key, p, i, m in rows if key == k)
        ids, makes = [i for _, i, _ in listed], [m for _, _, m in listed]
        if len(ids) > 5 and makes[0] and len(set(makes[:5])) == 1:
            other = next((j for j in range(5, len(ids)) if makes[j] and makes[j] != makes[0]), None)
            if other is not None:
                ids.insert(4, ids.pop(other))
        assert [r.id for r in found.filter(F.col("list_key") == k).orderBy("position").collect()] == ids


def test_merged_articles_leave_no_tie_open(spark):
    kinds = "canonical_url string, title string, url string, image_url string, id long"
    new = [("u1", "t", "u1", f"https://x/{n}.jpg", 100 - n) for n in range(50)] + [("u2", None, "u2", "a", 1), ("u2", "z", "u2", "b", 2), (None, "n", None, "c", 3)]
    old = spark.createDataFrame([("u2", None, None, None, None, 5)], "canonical_url string, title string, url string, image_url string, first_seen long, last_seen long")
    for parts in (1, 7):
        rows = {r.canonical_url: r for r in ing.merge_articles(old, spark.createDataFrame(new, kinds).repartition(parts, "id"), 9, ["id"]).collect()}
        assert rows["u1"].image_url == "https://x/49.jpg" and (rows["u2"].title, rows["u2"].image_url, rows["u2"].first_seen, rows["u2"].last_seen) == ("z", "b", None, 9)
        assert (rows[None].title, rows[None].last_seen) == ("n", 9) and len(rows) == 3
