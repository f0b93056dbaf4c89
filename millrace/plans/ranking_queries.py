"""Registered queries: scores, bands, lists and their shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ranking as rk
from millrace.operators import shaping as sh

from .derived import articles, read, with_sql

NOW = 1_704_067_200_000 + 40 * 86_400_000
MAKES = ["Alfa", "Benz", "Ford", "Lotus", "Mazda"]
TOPICS = ["Rally", "Design", "Tuning", "Classics"]


def _nth(names: list[str], c, k: int):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(c / k) % len(names) + 1).cast("int"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    none = F.array().cast("array<string>")
    a = articles(spark, sf_dir)
    make, model = _nth(MAKES, i, 1), F.concat(F.lit("M"), (i % 7).cast("string"))
    has = i % 3 != 0
    return a.withColumns({
        "makes": F.when(has, F.array(make)).otherwise(none), "models": F.when(i % 4 == 0, F.array(model)).otherwise(none), "generations": F.when(i % 8 == 0, F.array(F.lit("G1"))).otherwise(none),
        "variants": F.when(i % 16 == 0, F.array(F.lit("GT-3"))).otherwise(none), "interests": F.when(i % 2 == 0, F.array(_nth(TOPICS, i, 2))).otherwise(none), "categories": F.array(_nth(["Events", "News", "Design"], i, 3)),
        "scenes": F.when(i % 5 == 0, F.array(F.lit("Rally"))).otherwise(none), "locations": F.when(i % 6 == 0, F.array(F.lit("London"))).otherwise(none), "geography": none, "content_types": F.when(i % 10 == 0, F.array(F.lit("Event"))).otherwise(none),
        "primary_category": _nth(["cars", "culture", "driving", "motorsport", "events", "news"], i, 1), "source_relevance": _nth(["Excellent x", "Good", "Medium"], i, 1), "desk_pick": i % 40 == 0,
        "entity_hits": F.array(F.struct(F.lit("make").alias("kind"), make.alias("name"), make.alias("make"), F.lit(None).cast("string").alias("model"), F.when(i % 7 == 1, "mentioned").when(i % 7 == 2, "relevant").otherwise("about").alias("relevance"))),
        "image_url": F.when(i % 4 != 1, "https://i.example.com/a.jpg"), "is_video": i % 3 == 1, "duplicate_group_id": F.when(i % 9 != 0, F.concat(F.lit("g"), (i % 300).cast("string"))),
    })


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per nation."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    vehicle = lambda j: F.struct(_nth(MAKES, k + j, 1).alias("make"), F.concat(F.lit("M"), ((k + j) % 7).cast("string")).alias("model"), F.when(k % 2 == 0, "G1").alias("generation"), F.when(k % 3 == 0, "gt3").alias("variant"))
    return n.select(F.concat(F.lit("p"), k.cast("string")).alias("list_key"), F.array(vehicle(0), vehicle(2)).alias("vehicles"), F.array(_nth(TOPICS, k, 1)).alias("user_interests"), F.when(k % 2 == 1, "london").alias("user_location"))


def default_scores(spark, sf_dir):
    a = features(spark, sf_dir)
    return a.select("id", rk.default_score(F.col("source_relevance"), F.col("published_at"), F.col("excerpt"), F.col("desk_pick"), NOW).cast("long").alias("score"))


CULTURE = {"Lotus": ["Tuning", "Rally"]}


def personal_scores(spark, sf_dir):
    """Every article's score for every profile, and for one that shares nothing with any (list_key '')."""
    f, p = features(spark, sf_dir), profiles(spark, sf_dir)
    p = p.unionByName(spark.createDataFrame([("", [], [], None)], p.schema))
    columns = ["list_key", "id", "score", "vehicle_tier", "platform_relevance", "user_relevance", "quality_band", "rank_score"]
    judged = lambda rows, *more: rk.with_band(rk.with_relevance(rows)).select(*more, *columns[1:])
    rest = rk.for_others(judged(rk.score_unmatched(f, NOW, tokens=True), "tokens"), p, CULTURE)
    return judged(rk.score_personal(f, p, NOW, CULTURE), "list_key").unionByName(rest)


def ranked_lists(spark, sf_dir):
    return rk.personal_lists(features(spark, sf_dir), profiles(spark, sf_dir), NOW, 80, CULTURE)


def snapshot(spark, sf_dir):
    """Every stored list: for-you, the sections, and each profile's own."""
    return rk.snapshot_lists(features(spark, sf_dir), profiles(spark, sf_dir), NOW, 80, CULTURE)


def filtered_feed(spark, sf_dir):
    """The stories of one make and section that mention a word, as they are shown."""
    return rk.ranked_feed(features(spark, sf_dir), NOW, section="culture", make="Benz", q="th", limit=40)


def _default_rows(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("rank_score", rk.default_score(F.col("source_relevance"), F.col("published_at"), F.col("excerpt"), F.col("desk_pick"), NOW).cast("long"))
    return rows.withColumns({"quality_band": F.when(F.col("desk_pick"), "featured").otherwise("eligible"), "show_in_primary_feed": F.lit(True), "vehicle_tier": F.lit("none"), "list_key": F.col("lang")})


def _default_list(spark, sf_dir):
    return rk.ranked(_default_rows(spark, sf_dir), ["list_key"])


def default_lists(spark, sf_dir):
    best = rk.best_of_groups(_default_rows(spark, sf_dir), ["list_key"])
    return rk.top_lists(rk.ranked(best, ["list_key"]), 80)


def image_first(spark, sf_dir):
    rows = _default_rows(spark, sf_dir).select("list_key", "id", "image_url", "quality_band", "rank_score", "published_at")
    order = [F.col("image_url").isNull() | (F.col("image_url") == ""), *rk.list_order()]
    return rk.numbered(rows, ["list_key"], order).select("list_key", "id", "position")


def diversified(spark, sf_dir):
    rows = _default_rows(spark, sf_dir).select("list_key", "id", "quality_band", "rank_score", "published_at")
    rows = rk.numbered(rows, ["list_key"], rk.list_order())
    rows = rows.withColumn("make", F.when(F.col("position") <= 7, F.lit("Alfa")).otherwise(_nth(MAKES, F.col("position"), 1)))
    return rk.diversify(rows, ["list_key"], "make").select("list_key", "id", "position")


def media_mix(spark, sf_dir):
    rows = _default_rows(spark, sf_dir).select("list_key", "id", "is_video", "quality_band", "rank_score", "published_at")
    return sh.spread_media(rk.numbered(rows, ["list_key"], rk.list_order()).select("list_key", "id", "position", "is_video"), ["list_key"], 40)


def section_rails(spark, sf_dir):
    rows = rk.renumbered(_default_rows(spark, sf_dir), ["primary_category"], rk.list_order())
    featured = rows.filter("id % 4 = 0").select("id")
    return rk.section_rails(rows.filter("position <= 12"), featured).select("primary_category", "id", "position")


def reader_overlay(spark, sf_dir):
    """The articles that each visitor came across, ordered anew by the visitor's own marks."""
    k = F.get_json_object("props", "$.k").cast("long")
    seen = read(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_key"), "event_type", k.alias("id"))
    ids = lambda t: F.array_sort(F.collect_set(F.when(F.col("event_type") == t, F.col("id")))).alias(t)
    signals = seen.groupBy("visitor_key").agg(ids("purchase"), ids("error"), ids("click"), ids("signup")).toDF("visitor_key", "interested_ids", "less_ids", "saved_ids", "recent_ids")
    pool = _default_rows(spark, sf_dir).select("id", "makes", "interests", "rank_score")
    rows = seen.select("visitor_key", "id").distinct().join(pool, "id")
    rows = rk.renumbered(rows, ["visitor_key"], [F.desc("rank_score"), F.asc("id")])
    return rk.reader_overlay(rows, signals).select("visitor_key", "id", "delta", "rank_score", "position")


def home_lanes(spark, sf_dir):
    rows = rk.personal_rows(features(spark, sf_dir), profiles(spark, sf_dir), NOW, 80, CULTURE, carry=["makes", "interest_match"])
    makes = profiles(spark, sf_dir).select("list_key", F.col("vehicles")[0]["make"].alias("profile_make"))
    rows = rows.join(makes, "list_key")
    rows = rows.withColumns({"subject": F.coalesce("duplicate_group_id", F.lit("")), "make": F.coalesce(F.try_element_at("makes", F.lit(1)), F.lit(""))})
    return sh.home_lanes(rows.select("list_key", "position", "id", "subject", "make", "vehicle_tier", "interest_match", "show_in_primary_feed", "profile_make"), "list_key")


def opening_picks(spark, sf_dir):
    rows = _default_list(spark, sf_dir).withColumns({"this_week": F.col("published_at") >= NOW - 7 * 86_400_000, "last_week": F.col("id") % 5 == 0})
    return sh.opening_picks(rows.select("list_key", "position", "id", "publication", "this_week", "last_week", "desk_pick"), "list_key", 8)


def keep_exploring(spark, sf_dir):
    rows = _default_rows(spark, sf_dir)
    return sh.keep_exploring(rows, rk.top_pool(rows), ["Rally"])


QUERIES = {
    "rank_default_scores": default_scores, "rank_personal_scores": personal_scores, "rank_personal_lists": ranked_lists, "rank_default_lists": default_lists, "rank_image_first": image_first,
    "rank_diversified": diversified, "rank_media_mix": media_mix, "rank_section_rails": section_rails, "rank_reader_overlay": reader_overlay, "rank_home_lanes": home_lanes,
    "rank_snapshot": snapshot, "rank_filtered_feed": filtered_feed, "rank_opening_picks": opening_picks, "rank_keep_exploring": keep_exploring,
}

_F = f"""f AS (SELECT *, CASE id % 3 WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 8 END + CAST(floor(10 * pow(0.5, greatest(0.0, ({NOW} - published_at) / 86400000.0) / 12) + 0.5) AS BIGINT)
    + CASE WHEN length(coalesce(excerpt, '')) >= 180 THEN 15 ELSE 0 END + CASE WHEN id % 40 = 0 THEN 8 ELSE 0 END AS score, CASE WHEN id % 9 <> 0 THEN 'g' || (id % 300) END AS grp,
    (['cars', 'culture', 'driving', 'motorsport', 'events', 'news'])[CAST(id % 6 + 1 AS INTEGER)] AS section, id % 4 <> 1 AS has_image FROM articles)"""
_ORDER = "CASE WHEN id % 40 = 0 THEN 1 ELSE 0 END DESC, score DESC, published_at DESC, id"
_L = f"{_F}, l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS pos FROM f)"
_MAKES = ", ".join(f"'{m}'" for m in MAKES)
_TOPICS = ", ".join(f"'{m}'" for m in TOPICS)
#: Scores of every article for every profile, restated from the ids that features and profiles are made of.
_PERSONAL = f"""a0 AS (SELECT id, published_at, length(coalesce(excerpt, '')) >= 180 AS long, id % 3 <> 0 AS has, (id // 2) % 4 AS topic, (id // 3) % 3 AS cat, id % 40 = 0 AS pick, CASE WHEN id % 9 <> 0 THEN 'g' || (id % 300) END AS grp,
        (['cars', 'culture', 'driving', 'motorsport', 'events', 'news'])[CAST(id % 6 + 1 AS INTEGER)] AS section, CAST(floor(10 * pow(0.5, greatest(0.0, ({NOW} - published_at) / 86400000.0) / 12) + 0.5) AS BIGINT) AS fresh FROM articles),
    v0 AS (SELECT a0.*, n_nationkey AS k, j, has AND id % 5 = (n_nationkey + j) % 5 AS hm, id % 4 = 0 AND id % 7 = (n_nationkey + j) % 7 AS ho, n_nationkey % 2 = 0 AND id % 8 = 0 AS hg, n_nationkey % 3 = 0 AND id % 16 = 0 AS hv,
        (n_nationkey + j) % 5 = 3 AND (n_nationkey % 4 <> 0 AND (id % 2 = 0 AND topic = 0 OR id % 5 = 0) OR n_nationkey % 4 <> 2 AND id % 2 = 0 AND topic = 2) AS bridge FROM a0, (SELECT n_nationkey FROM nation UNION ALL SELECT NULL), (VALUES (0), (2)) AS t(j)),
    v1 AS (SELECT *, CASE WHEN hm AND ho AND hv THEN 6 WHEN hm AND ho AND hg THEN 5 WHEN hm AND ho THEN 4 WHEN hg AND (hm OR ho) THEN 3 WHEN hm THEN 2 WHEN bridge THEN 1 ELSE 0 END AS r FROM v0),
    v2 AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY r DESC, j) = 1),
    v3 AS (SELECT *, coalesce(id % 2 = 0 AND topic = k % 4, false) AS hit, CAST(floor(([0, 16, 48, 72, 95, 110, 130])[r + 1] * CASE WHEN r IN (2, 4) AND id % 7 = 1 THEN 0.32 WHEN r IN (2, 4) AND id % 7 = 2 THEN 0.72 ELSE 1.0 END + 0.5) AS BIGINT) AS vehicle FROM v2),
    v4 AS (SELECT *, CASE WHEN hit THEN 20 WHEN k % 4 = 1 AND cat = 2 THEN 9 ELSE 0 END AS interest, CASE WHEN id % 5 = 0 AND k % 4 = 0 THEN 8 ELSE 0 END AS culture, CASE WHEN id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN long THEN 8 ELSE 0 END AS editorial,
        CASE WHEN k % 2 = 1 AND id % 6 = 0 AND (id % 10 = 0 OR cat = 0) THEN 11 ELSE 0 END AS place, CASE WHEN fresh > 0 THEN CASE WHEN r <= 1 THEN CAST(floor(fresh * 0.35 + 0.5) AS BIGINT) ELSE fresh END ELSE 0 END AS new,
        CASE WHEN pick THEN 8 + CASE WHEN r >= 2 THEN 10 ELSE 0 END ELSE 0 END AS desk, CASE WHEN r = 0 AND NOT hit THEN 3 ELSE 0 END AS generic,
        CASE WHEN has OR id % 4 = 0 THEN 12 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN section = 'news' THEN 0 ELSE 8 END + CASE WHEN id % 7 IN (1, 2) THEN 0 ELSE 3 END AS auto FROM v3),
    v5 AS (SELECT *, auto + CASE id % 3 WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 8 END AS own, vehicle + interest + culture + place AS usr, vehicle + interest + culture + place + editorial + new + desk + generic AS sc FROM v4),
    v6 AS (SELECT *, own + editorial + desk + CASE WHEN own < 40 THEN generic ELSE 0 END AS platform FROM v5),
    v7 AS (SELECT *, CASE WHEN pick THEN 'featured' WHEN (section = 'news' OR generic > 0) AND NOT has AND id % 4 <> 0 AND vehicle = 0 AND interest = 0 AND platform < 40 AND usr < 40 THEN 'excluded' WHEN platform < 28 AND usr < 40 THEN 'excluded'
        WHEN platform >= 56 AND auto >= 12 AND editorial >= 8 THEN 'featured' WHEN platform >= 40 OR usr >= 40 THEN 'eligible' ELSE 'deprioritised' END AS quality_band FROM v6),
    b3 AS (SELECT coalesce('p' || k, '') AS list_key, id, published_at, grp, section, CAST(sc AS BIGINT) AS score, ([{", ".join(f"'{t}'" for t in rk.TIERS)}])[r + 1] AS vehicle_tier, CAST(platform AS BIGINT) AS platform_relevance, CAST(usr AS BIGINT) AS user_relevance, quality_band,
        CAST(greatest(0, sc - CASE WHEN quality_band = 'deprioritised' THEN 18 ELSE 0 END) AS BIGINT) AS rank_score FROM v7)"""
ORACLE_SQL = {
    "rank_default_scores": with_sql(["articles"], f"WITH {_F} SELECT id, CAST(score AS BIGINT) AS score FROM f"),
    "rank_default_lists": with_sql(["articles"], f"WITH {_L}, d AS (SELECT * FROM l QUALIFY grp IS NULL OR row_number() OVER (PARTITION BY lang, grp ORDER BY pos) = 1), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY pos) AS INTEGER) AS p FROM d) SELECT lang AS list_key, p - 1 AS position, id AS article_id, CAST(score AS BIGINT) AS score, CASE WHEN id % 40 = 0 THEN 'featured' ELSE 'eligible' END AS quality_band, true AS show_in_primary_feed, 'none' AS vehicle_tier FROM n WHERE p <= 80"),
    "rank_image_first": with_sql(["articles"], f"WITH {_L} SELECT lang AS list_key, id, CAST(row_number() OVER (PARTITION BY lang ORDER BY NOT has_image, pos) AS INTEGER) AS position FROM l"),
    "rank_diversified": with_sql(["articles"], f"WITH {_L}, m AS (SELECT lang, id, pos, CASE WHEN pos <= 7 THEN 'Alfa' ELSE ([{_MAKES}])[CAST(pos % 5 + 1 AS INTEGER)] END AS make FROM l), w AS (SELECT *, min(CASE WHEN pos > 5 AND make <> 'Alfa' THEN pos END) OVER (PARTITION BY lang) AS sw FROM m) SELECT lang AS list_key, id, CAST(CASE WHEN sw IS NULL THEN pos WHEN pos = sw THEN 5 WHEN pos >= 5 AND pos < sw THEN pos + 1 ELSE pos END AS INTEGER) AS position FROM w"),
    "rank_section_rails": with_sql(["articles"], f"WITH {_F}, l AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {_ORDER}) AS pos FROM f), p AS (SELECT section, id, CAST(row_number() OVER (PARTITION BY section ORDER BY pos <> 1, id % 4 = 0, pos) AS INTEGER) AS position FROM l WHERE pos <= 12) SELECT section AS primary_category, id, position FROM p WHERE position <= 5"),
    "rank_reader_overlay": with_sql(["articles"], f"""WITH {_F}, e AS (SELECT 'v' || user_id AS visitor_key, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events), m AS (SELECT visitor_key, id, bool_or(event_type = 'purchase') AS mi, bool_or(event_type = 'error') AS ml, bool_or(event_type = 'click') AS ms, bool_or(event_type = 'signup') AS mr FROM e GROUP BY 1, 2),
        act AS (SELECT visitor_key, bool_or(event_type IN ('purchase', 'error', 'click', 'signup')) AS act FROM e GROUP BY 1),
        a AS (SELECT id, score, [x FOR x IN [CASE WHEN id % 3 <> 0 THEN ([{_MAKES}])[CAST(id % 5 + 1 AS INTEGER)] END, CASE WHEN id % 2 = 0 THEN ([{_TOPICS}])[CAST((id // 2) % 4 + 1 AS INTEGER)] END] IF x IS NOT NULL] AS t FROM f),
        j AS (SELECT m.*, score, t, act FROM m JOIN a USING (id) JOIN act USING (visitor_key)),
        p AS (SELECT visitor_key, coalesce(flatten(list(t) FILTER (mi)), []) AS pi, coalesce(flatten(list(t) FILTER (ml)), []) AS pl, coalesce(flatten(list(t) FILTER (ms)), []) AS ps FROM j GROUP BY 1),
        d AS (SELECT j.*, CASE WHEN NOT act THEN 0 ELSE CASE WHEN mi THEN 48 WHEN ml THEN -56 ELSE CASE WHEN list_has_any(t, pi) THEN 14 ELSE 0 END + CASE WHEN list_has_any(t, pl) THEN -20 ELSE 0 END END + CASE WHEN ms THEN 18 WHEN NOT mi AND NOT ml AND list_has_any(t, ps) THEN 8 ELSE 0 END + CASE WHEN mr AND NOT mi AND NOT ml THEN 6 ELSE 0 END END AS delta FROM j JOIN p USING (visitor_key))
        SELECT visitor_key, id, delta, CAST(score + delta AS BIGINT) AS rank_score, CAST(row_number() OVER (PARTITION BY visitor_key ORDER BY CASE WHEN act THEN 0 END, score + delta DESC, id) AS INTEGER) AS position FROM d"""),
    "rank_personal_scores": with_sql(["articles"], f"WITH {_PERSONAL} SELECT list_key, id, score, vehicle_tier, platform_relevance, user_relevance, quality_band, rank_score FROM b3"),
    "rank_personal_lists": with_sql(["articles"], f"""WITH {_PERSONAL}, l1 AS (SELECT *, row_number() OVER (PARTITION BY list_key ORDER BY CASE quality_band WHEN 'featured' THEN 3 WHEN 'eligible' THEN 2 ELSE 1 END DESC, rank_score DESC, published_at DESC, id) AS o FROM b3 WHERE quality_band <> 'excluded' AND list_key <> ''),
        l2 AS (SELECT * FROM l1 QUALIFY grp IS NULL OR row_number() OVER (PARTITION BY list_key, grp ORDER BY o) = 1), l3 AS (SELECT *, row_number() OVER (PARTITION BY list_key ORDER BY o) AS p FROM l2),
        l4 AS (SELECT *, count(*) OVER w AS n, max(CASE WHEN p = 1 THEN section END) OVER w AS s1, bool_and(p > 5 OR section = (SELECT x.section FROM l3 x WHERE x.list_key = l3.list_key AND x.p = 1)) OVER w AS same FROM l3 WINDOW w AS (PARTITION BY list_key)),
        l5 AS (SELECT *, min(CASE WHEN p > 5 AND section <> s1 THEN p END) OVER (PARTITION BY list_key) AS sw FROM l4),
        l6 AS (SELECT *, CASE WHEN n <= 5 OR NOT same OR sw IS NULL THEN p WHEN p = sw THEN 5 WHEN p >= 5 AND p < sw THEN p + 1 ELSE p END AS q FROM l5),
        l7 AS (SELECT *, CAST(row_number() OVER (PARTITION BY list_key ORDER BY id % 4 = 1, q) AS INTEGER) AS position FROM l6)
        SELECT list_key, position - 1 AS position, id AS article_id, rank_score AS score, quality_band, quality_band IN ('featured', 'eligible') AS show_in_primary_feed, vehicle_tier FROM l7 WHERE position <= 80"""),
}
