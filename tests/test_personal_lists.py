"""Personal lists by shared tokens against the scores of every article with every profile."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking as rk
from millrace.plans import derived, ranking_queries
from millrace.storage import sized_broadcast, written

NOW = 1_700_000_000_000
ARTICLE = "id long, makes array<string>, models array<string>, generations array<string>, variants array<string>, interests array<string>, categories array<string>, scenes array<string>, locations array<string>, geography array<string>, content_types array<string>, primary_category string, source_relevance string, desk_pick boolean, excerpt string, published_at long, image_url string, duplicate_group_id string, entity_hits array<struct<kind:string,name:string,make:string,model:string,relevance:string>>"
PROFILE = "list_key string, vehicles array<struct<make:string,model:string,generation:string,variant:string>>, user_interests array<string>, user_location string"
CULTURE = {"Lotus": ["Rally", "Tuning"]}


def tables(spark, rng, n_articles, n_profiles, popular):
    some = lambda xs, k=2: rng.sample(xs, rng.randint(0, min(k, len(xs))))
    makes, topics = ["Lotus", "Ford", "BMW", "Fiat"], ["Rally", "Tuning", "Design", "Events", "Road Trips"]
    rows = []
    for i in range(n_articles):
        own = ["Lotus"] if rng.random() < popular else some(makes, 1)
        hits = [("make", m, m, None, rng.choice(["about", "relevant", "mentioned", None])) for m in own]
        rows.append((i, own, some(["M1", "M2"]), some(["G1", "G2"], 1), some(["GT"], 1), some(topics), some(topics, 1), some(topics, 1), some(["London", "Rome"], 1), [], some(["Event", "News", "Video"], 1), rng.choice(["cars", "events", "news", "", None]), rng.choice(["Excellent", "Good", "x", None]), rng.random() < 0.05, "x" * rng.choice([10, 200]), rng.choice([None, NOW - rng.randint(0, 30) * 86_400_000]), rng.choice([None, "", "https://x/a.jpg"]), rng.choice([None, "", "hot", *(f"g{k}" for k in range(12))]), hits))
    profiles = [(f"p{k}", [(rng.choice([*makes, None]), rng.choice(["M1", "M9", None]), rng.choice(["G1", None]), rng.choice(["gt", None])) for _ in range(rng.randint(0, 2))], some(topics), rng.choice(["London", "", None])) for k in range(n_profiles)] + [("nobody", [], [], None), ("none", None, None, None)]
    return spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(profiles, PROFILE)


def of_all_pairs(articles, profiles, limit):
    """Every pair scored, the whole list sorted, deduplicated, shaped."""
    pairs = rk._scored(rk.article_side(articles, NOW).join(rk.profile_side(profiles, CULTURE)), rk.WEIGHTS)
    rows = rk.with_band(rk.with_relevance(pairs)).filter("quality_band != 'excluded'").cache()
    shaped = rk.prefer_images(rk.diversify(rk.ranked(rk.best_of_groups(rows, ["list_key"]), ["list_key"]), ["list_key"], "primary_category"), ["list_key"])
    return pairs, rk.top_lists(shaped, limit)


@pytest.mark.parametrize(("n", "limit", "popular", "seed"), [(150, 6, 0.3, 1), (150, 6, 0.95, 2), (60, 80, 0.1, 3)])
def test_lists_equal_those_of_all_pairs(spark, n, limit, popular, seed):
    articles, profiles = tables(spark, random.Random(seed), n, 6, popular)
    articles, profiles = articles.repartition(3).cache(), profiles.cache()
    pairs, want = of_all_pairs(articles, profiles, limit)
    assert sorted(map(str, rk.personal_lists(articles, profiles, NOW, limit, CULTURE).collect())) == sorted(map(str, want.collect()))
    # pairs that share nothing have the score without a profile
    cells = ["id", "score", "vehicle_tier", *rk.BUCKETS]
    met, alone = rk.score_personal(articles, profiles, NOW, CULTURE).select("list_key", *cells), rk.score_unmatched(articles, NOW).select(*cells)
    rest = profiles.select("list_key").join(alone).join(met.select("list_key", "id"), ["list_key", "id"], "left_anti")
    assert sorted(map(str, met.unionByName(rest).collect())) == sorted(map(str, pairs.select("list_key", *cells).collect()))
    assert 0 < met.count() < n * 8


def test_no_nested_loop_and_no_articles(spark):
    articles, profiles = tables(spark, random.Random(4), 20, 3, 0.5)
    assert "NestedLoop" not in rk.score_personal(articles, profiles, NOW)._jdf.queryExecution().toString()
    assert rk.personal_lists(articles.filter("false"), profiles, NOW).count() == 0 == rk.personal_lists(articles, profiles.filter("false"), NOW).count()


def test_scores_of_every_article_for_every_profile(spark):
    sf = "/root/testdata/sf0.001"
    found = ranking_queries.personal_scores(spark, sf).select("list_key", "id").distinct()
    n = derived.articles(spark, sf).select("id").distinct().count()
    assert {r[0]: r[1] for r in found.groupBy("list_key").count().collect()} == {k: n for k in ["", *(f"p{i}" for i in range(25))]}


def test_a_large_side_is_not_broadcast_for_its_small_files(spark):
    rows = written(spark.range(50_000), "same")
    plan = rows.join(sized_broadcast(rows.withColumnRenamed("id", "other"), 1000), F.col("id") == F.col("other"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
