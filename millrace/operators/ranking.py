"""Scores, relevance, quality bands and ordered lists of articles, by profile.

Articles carry arrays: makes, models, generations, variants, interests, categories, locations, scenes, content_types,
geography, entity_hits (kind, name, make, model, relevance). Profiles carry vehicles (make, model, generation,
variant), interests and location. `now` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import js_round
from millrace.operators.ingest import with_gate
from millrace.storage import shuffled, sized_broadcast, written

#: Points of each signal and thresholds of each band.
WEIGHTS = {
    "variant": 130, "vehicle": 110, "model": 95, "generation": 72, "make": 48, "category": 16, "about": 1.0, "relevant": 0.72, "mentioned": 0.32,
    "interest": 20, "secondary": 9, "culture": 8, "source": 12, "longform": 8, "location": 11, "fresh": 10, "half_life": 12, "generic": 3, "pick": 8, "pick_relevant": 10,
    "min_relevance": 40, "min_automotive": 12, "min_editorial": 8, "eligible": 40, "deprioritised": 28, "featured": 56,
    "meta_vehicle": 12, "meta_interest": 6, "meta_category": 8, "meta_entity": 3, "source_excellent": 40, "source_good": 20, "source_base": 8, "penalty": 18,
}
TIERS = ["none", "category", "make", "generation", "model", "vehicle", "variant"]
BANDS = ["excluded", "deprioritised", "eligible", "featured"]
#: The sections that have lists of their own, and the name of the list of all.
SECTIONS = ["cars", "culture", "driving", "motorsport", "events"]
FOR_YOU = "for-you"
#: What a reader's own marks add to a score.
READER = {"interested": 48, "less": -56, "saved": 18, "recent": 6, "interested_similar": 14, "less_similar": -20, "saved_similar": 8}


def norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def norms(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), norm)


def recency_bonus(published: Column, now_ms: int, w: dict = WEIGHTS) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - published) / F.lit(86_400_000.0))
    return js_round(F.lit(w["fresh"]) * F.pow(F.lit(0.5), age / max(1, w["half_life"])))


def source_score(relevance: Column, w: dict = WEIGHTS) -> Column:
    low = F.lower(F.coalesce(relevance, F.lit("")))
    return F.when(low.startswith("excellent"), w["source_excellent"]).when(low.startswith("good"), w["source_good"]).otherwise(w["source_base"])


def default_score(relevance: Column, published: Column, excerpt: Column, desk_pick: Column, now_ms: int, w: dict = WEIGHTS) -> Column:
    """Without a profile: source, freshness, a long teaser, a live pick."""
    long = F.when(F.length(F.coalesce(excerpt, F.lit(""))) >= 180, 15).otherwise(0)
    return source_score(relevance, w) + recency_bonus(published, now_ms, w) + long + F.when(desk_pick, w["pick"]).otherwise(0)


def variants_match(a: Column, b: Column, aliases: dict[str, str] | None = None) -> Column:
    """Equal by letters and digits, or names of one thing by an alias table (folded name -> common name)."""
    x, y = _folded(a, aliases), _folded(b, aliases)
    return (x != "") & (x == y)


def culture_tags(make: Column, rules: dict[str, list[str]]) -> Column:
    """Tags that a vehicle stands for, by its make."""
    found = F.array().cast("array<string>")
    for name, tags in rules.items():
        found = F.when(norm(make) == name.lower(), F.array(*[F.lit(t.lower()) for t in tags])).otherwise(found)
    return found


def _folded(c: Column, aliases: dict[str, str] | None) -> Column:
    x = F.regexp_replace(norm(c), "[^a-z0-9]+", "")
    if aliases:
        table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
        x = F.coalesce(F.try_element_at(table, x), x)
    return x


def article_side(articles: DataFrame, now_ms: int, variant_aliases: dict[str, str] | None = None, w: dict = WEIGHTS) -> DataFrame:
    """Adds what scoring asks of an article, once for all profiles."""
    c = F.col
    none = F.expr("cast(array() as array<struct<kind:string,name:string,make:string,model:string,relevance:string>>)")
    hit = lambda h: F.struct(h["kind"].alias("kind"), norm(h["name"]).alias("name"), _folded(h["name"], variant_aliases).alias("folded"), F.lower(F.coalesce(h["relevance"], F.lit("about"))).alias("said"))
    tags = norms(F.concat(F.coalesce("categories", F.array()), F.coalesce("interests", F.array())))
    outing = F.arrays_overlap(norms(c("content_types")), F.array(F.lit("event"), F.lit("road trip"))) | (norm(c("primary_category")) == "events") | F.arrays_overlap(tags, F.array(F.lit("events"), F.lit("road trips")))
    return articles.withColumns({
        "_makes": norms(c("makes")), "_models": norms(c("models")), "_generations": norms(c("generations")), "_interests": norms(c("interests")), "_categories": norms(c("categories")), "_scenes": norms(c("scenes")),
        "_variants": F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda x: _folded(x, variant_aliases)),
        "_around": norms(F.concat(F.coalesce("interests", F.array()), F.coalesce("categories", F.array()), F.coalesce("scenes", F.array()))),
        "_places": F.when(F.coalesce(outing, F.lit(False)), norms(F.concat(F.coalesce("locations", F.array()), F.coalesce("geography", F.array())))).otherwise(F.array().cast("array<string>")),
        "_hits": F.transform(F.coalesce(c("entity_hits"), none), hit), "_fresh": F.coalesce(recency_bonus(c("published_at"), now_ms, w), F.lit(0.0)),
        "_long": F.length(F.coalesce(c("excerpt"), F.lit(""))) >= 180,
    })


def profile_side(profiles: DataFrame, culture: dict[str, list[str]] | None = None, variant_aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds what scoring asks of a profile, once for all articles."""
    none = F.expr("cast(array() as array<struct<make:string,model:string,generation:string,variant:string>>)")
    vehicle = lambda v, i: F.struct((-i).alias("first"), norm(v["make"]).alias("make"), norm(v["model"]).alias("model"), norm(v["generation"]).alias("generation"), _folded(v["variant"], variant_aliases).alias("variant"), culture_tags(v["make"], culture or {}).alias("tags"))
    return profiles.withColumns({"_vehicles": F.transform(F.coalesce(F.col("vehicles"), none), vehicle), "_mine": norms(F.col("user_interests")), "_location": norm(F.col("user_location"))})


def article_tokens() -> Column:
    """What a profile can share with an article_side(): a pair without any of these scores as if there were no profile."""
    tagged = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tagged("make:", F.col("_makes")), tagged("generation:", F.col("_generations")), tagged("tag:", F.col("_around")), tagged("place:", F.col("_places"))))


def profile_tokens() -> Column:
    """The same of a profile_side()."""
    part = lambda kind, field: F.transform(F.filter("_vehicles", lambda v: v[field] != ""), lambda v: F.concat(F.lit(kind), v[field]))
    tags = F.transform(F.concat("_mine", F.flatten(F.transform("_vehicles", lambda v: v["tags"]))), lambda x: F.concat(F.lit("tag:"), x))
    place = F.when(F.col("_location") != "", F.array(F.concat(F.lit("place:"), F.col("_location")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(part("make:", "make"), part("generation:", "generation"), tags, place))


def score_personal(articles: DataFrame, profiles: DataFrame, now_ms: int, culture: dict[str, list[str]] | None = None, variant_aliases: dict[str, str] | None = None, w: dict = WEIGHTS) -> DataFrame:
    """The pairs of articles and profiles (list_key, vehicles, user_interests, user_location) that share a make, generation, tag or place.

    Adds signals (kind, points, detail), points by bucket, score, vehicle_tier. All other pairs have the score of
    score_unmatched(). Both sides are joined by what they share, each pair at the first token it shares; so nothing is
    computed for pairs that the profile does not change. Articles are dealt anew before that, as each becomes many rows. The
    best tier of the vehicles counts, of equals the first vehicle; its points shrink if the article only mentions it.
    """
    tasks = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = article_side(articles, now_ms, variant_aliases, w).withColumn("_tokens", article_tokens()).repartition(tasks, "id").withColumn("_token", F.explode("_tokens"))
    right = profile_side(profiles, culture, variant_aliases).withColumn("_asks", profile_tokens()).withColumn("_token", F.explode("_asks"))
    met = left.join(sized_broadcast(right), "_token").filter(F.element_at(F.array_intersect("_tokens", "_asks"), 1) == F.col("_token"))
    return _scored(met.drop("_token", "_tokens", "_asks"), w)


def score_unmatched(articles: DataFrame, now_ms: int, variant_aliases: dict[str, str] | None = None, w: dict = WEIGHTS, tokens: bool = False) -> DataFrame:
    """As score_personal(), for any profile that shares nothing with the article: a row an article, without list_key. tokens: with article_tokens(), for for_others()."""
    nobody = {"_vehicles": F.expr("cast(array() as array<struct<first:int,make:string,model:string,generation:string,variant:string,tags:array<string>>>)"), "_mine": F.array().cast("array<string>"), "_location": F.lit("")}
    rows = article_side(articles, now_ms, variant_aliases, w).withColumns(nobody)
    return _scored(rows.withColumn("tokens", article_tokens()) if tokens else rows, w)


def for_others(rows: DataFrame, profiles: DataFrame, culture: dict[str, list[str]] | None = None, variant_aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of score_unmatched() with tokens, once for each profile (list_key) that shares none of them: with score_personal(), all pairs.

    What is added to the rows before is worked out once an article. All pairs are quadratic by nature; no task holds more
    than the profiles, if they are few, or else a part of either side.
    """
    asks = profile_side(profiles, culture, variant_aliases).select("list_key", profile_tokens().alias("_asks"))
    return rows.join(sized_broadcast(asks), ~F.arrays_overlap("tokens", "_asks")).drop("tokens", "_asks")


def _scored(rows: DataFrame, w: dict) -> DataFrame:
    """From rows of article_side() and profile_side()."""
    c = F.col

    def tiered(v: Column) -> Column:
        has_make, has_model = (v["make"] != "") & F.array_contains(c("_makes"), v["make"]), (v["model"] != "") & F.array_contains(c("_models"), v["model"])
        has_generation = (v["generation"] != "") & F.array_contains(c("_generations"), v["generation"])
        has_variant = (v["variant"] != "") & F.array_contains(c("_variants"), v["variant"])
        bridge = F.size(F.array_except(F.array_intersect(v["tags"], c("_around")), c("_mine"))) > 0
        rank = (
            F.when(has_make & has_model & has_variant, 6).when(has_make & has_model & has_generation, 5).when(has_make & has_model, 4)
            .when(has_generation & (has_make | has_model), 3).when(has_make, 2).when(bridge, 1).otherwise(0)
        )
        return F.struct(rank.alias("rank"), v["first"].alias("first"), v["make"].alias("make"), v["model"].alias("model"), v["generation"].alias("generation"), v["variant"].alias("variant"))

    rows = rows.withColumn("_v", F.array_max(F.transform("_vehicles", tiered)))
    rows = rows.withColumn("_rank", F.coalesce(c("_v.rank"), F.lit(0)))

    def of_tier(h: Column) -> Column:
        rank = c("_rank")
        return (
            F.when(rank == 6, (h["kind"] == "variant") & (h["folded"] != "") & (h["folded"] == c("_v.variant"))).when(rank.isin(5, 3), (h["kind"] == "generation") & (h["name"] == c("_v.generation")))
            .when(rank == 4, (h["kind"] == "model") & (h["name"] == c("_v.model")) | (h["kind"] == "make") & (h["name"] == c("_v.make"))).when(rank == 2, (h["kind"] == "make") & (h["name"] == c("_v.make"))).otherwise(False)
        )

    rows = rows.withColumn("_said", F.transform(F.filter("_hits", of_tier), lambda h: h["said"]))
    said = c("_said")
    rows = rows.withColumn("_relevance", F.when((F.size(said) == 0) | F.array_contains(said, "about"), "about").when(F.array_contains(said, "relevant"), "relevant").otherwise("mentioned"))
    base = F.element_at(F.array(*[F.lit(0 if t == "none" else w[t]) for t in TIERS]), c("_rank") + 1)
    factor = F.when(c("_relevance") == "mentioned", w["mentioned"]).when(c("_relevance") == "relevant", w["relevant"]).otherwise(w["about"])
    rows = rows.withColumn("_points", js_round(base * factor).cast("long"))
    rank = c("_rank")
    rows = rows.withColumns({"vehicle_tier": F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1), "_matched": F.array_distinct(F.array_intersect("_mine", "_interests"))})
    matched, secondary, scenes = c("_matched"), F.array_intersect("_categories", "_mine"), F.array_intersect("_scenes", "_mine")
    fresh = F.when(rank <= 1, js_round(c("_fresh") * 0.35)).otherwise(c("_fresh"))
    pick = F.coalesce(c("desk_pick"), F.lit(False))
    points = {
        "vehicle_match": c("_points"), "_interest": F.when(F.size(matched) > 0, w["interest"]), "_secondary": F.when((F.size(secondary) > 0) & (F.size(matched) == 0), w["secondary"]),
        "culture_match": F.when(F.size(scenes) > 0, w["culture"]), "_quality": F.when(F.lower(c("source_relevance")).startswith("excellent"), w["source"]), "_longform": F.when(c("_long"), w["longform"]),
        "location_match": F.when((c("_location") != "") & F.array_contains("_places", c("_location")), w["location"]), "freshness": F.when(c("published_at").isNotNull() & (c("_fresh") > 0), fresh),
        "_pick": F.when(pick, w["pick"]), "_pick_relevant": F.when(pick & (rank >= 2), w["pick_relevant"]), "generic": F.when((rank == 0) & (F.size(matched) == 0), w["generic"]),
    }
    rows = rows.withColumns({name: F.coalesce(value.cast("long"), F.lit(0).cast("long")) for name, value in points.items()})
    # only who asks for the signals pays for them: scores and buckets are plain sums
    signal = lambda name, kind, detail: F.when(c(name) > 0, F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), c(name).alias("points"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    signals = F.array(
        signal("vehicle_match", F.concat(F.lit("vehicle."), c("vehicle_tier")), F.concat(c("_relevance"), F.lit(" "), c("vehicle_tier"), F.lit(" match"))), signal("_interest", "interest", F.array_join(matched, " + ")), signal("_secondary", "interest.secondary", F.array_join(secondary, " + ")),
        signal("culture_match", "culture", F.array_join(scenes, " + ")), signal("_quality", "editorial.quality", "excellent source"), signal("_longform", "editorial.longform", "long teaser"), signal("location_match", "location", c("_location")),
        F.when(c("published_at").isNotNull() & (c("_fresh") > 0), F.struct(F.lit("freshness").alias("kind"), c("freshness").alias("points"), F.lit("freshness").alias("detail"))),
        signal("_pick", "desk", "desk pick"), signal("_pick_relevant", "desk.relevant", "desk pick and vehicle"), signal("generic", "generic", "general"),
    )
    rows = rows.withColumns({"signals": F.filter(signals, lambda s: s.isNotNull()), "interest_match": c("_interest") + c("_secondary"), "editorial_quality": c("_quality") + c("_longform"), "desk_boost": c("_pick") + c("_pick_relevant")})
    rows = rows.withColumn("score", sum((c(x) for x in BUCKETS), F.lit(0).cast("long")))
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


BUCKETS = {"vehicle_match": ["vehicle."], "interest_match": ["interest"], "culture_match": ["culture"], "location_match": ["location"], "freshness": ["freshness"], "editorial_quality": ["editorial."], "desk_boost": ["desk"], "generic": ["generic"]}


def bucket_signals(signals: Column) -> dict[str, Column]:
    """The points of signals by what they are about."""
    return {name: F.aggregate(F.filter(signals, _starts(heads[0])), F.lit(0).cast("long"), lambda a, s: a + s["points"]) for name, heads in BUCKETS.items()}


def _starts(head: str):
    return lambda s: s["kind"].startswith(head)


def metadata_score(w: dict = WEIGHTS) -> Column:
    """What an article's own tags tell of its fit, without a profile."""
    c = F.col
    about = F.size(F.filter(c("entity_hits"), lambda h: F.lower(F.coalesce(h["relevance"], F.lit("about"))) == "about"))
    return (
        F.when((F.size("makes") > 0) | (F.size("models") > 0), w["meta_vehicle"]).otherwise(0) + F.when(F.size("interests") > 0, w["meta_interest"]).otherwise(0)
        + F.when(F.coalesce(c("primary_category"), F.lit("")).isin("", "news"), 0).otherwise(w["meta_category"]) + F.least(F.greatest(about, F.lit(0)) * w["meta_entity"], F.lit(15))
    )


def with_relevance(rows: DataFrame, w: dict = WEIGHTS) -> DataFrame:
    """Adds the buckets, unless they are there, automotive_score, platform_relevance, user_relevance and passed_gate."""
    missing = {} if all(b in rows.columns for b in BUCKETS) else bucket_signals(F.col("signals"))
    rows = rows.withColumns(missing | {"automotive_score": metadata_score(w)})
    own = F.col("automotive_score") + source_score(F.col("source_relevance"), w)
    platform = own + F.col("editorial_quality") + F.col("desk_boost") + F.when(own < w["min_relevance"], F.col("generic")).otherwise(0)
    user = F.col("vehicle_match") + F.col("interest_match") + F.col("culture_match") + F.col("location_match")
    rows = rows.withColumns({"platform_relevance": platform, "user_relevance": user})
    return rows.withColumn("passed_gate", F.coalesce("desk_pick", F.lit(False)) | (F.col("platform_relevance") >= w["min_relevance"]) | (F.col("user_relevance") >= w["min_relevance"]))


def with_band(rows: DataFrame, w: dict = WEIGHTS) -> DataFrame:
    """Adds quality_band, show_in_primary_feed and rank_score (the score less a penalty, at least 0)."""
    c = F.col
    types = norms(c("content_types"))
    newsy = (c("primary_category") == "news") | F.array_contains(types, "news") | (c("generic") > 0)
    thin = F.coalesce(newsy, F.lit(False)) & ~F.array_contains(types, "video") & (F.size("makes") == 0) & (F.size("models") == 0) & (c("vehicle_match") == 0) & (c("interest_match") == 0)
    strong = c("user_relevance") >= w["min_relevance"]
    band = (
        F.when(F.coalesce("desk_pick", F.lit(False)), "featured").when(thin & (c("platform_relevance") < w["eligible"]) & ~strong, "excluded").when((c("platform_relevance") < w["deprioritised"]) & ~strong, "excluded")
        .when((c("platform_relevance") >= w["featured"]) & (c("automotive_score") >= w["min_automotive"]) & (c("editorial_quality") >= w["min_editorial"]), "featured")
        .when((c("platform_relevance") >= w["eligible"]) | strong, "eligible").otherwise("deprioritised")
    )
    rows = rows.withColumn("quality_band", band)
    penalty = F.when(c("quality_band") == "deprioritised", w["penalty"]).otherwise(0)
    return rows.withColumns({"show_in_primary_feed": c("quality_band").isin("featured", "eligible"), "rank_score": F.greatest(F.lit(0), c("score") - penalty)})


def matches_profile(makes: list[str], interests: list[str], models: list[str] = (), generations: list[str] = ()) -> Column:
    """A hard filter: every dimension that is set must match, by any of its values. Nothing set: true."""
    rule = F.lit(True)
    for column, wanted in (("makes", makes), ("models", models), ("generations", generations), ("interests", interests)):
        if wanted:
            rule &= F.arrays_overlap(norms(F.col(column)), F.array(*[F.lit(x.lower().strip()) for x in wanted]))
    return rule


def filter_articles(rows: DataFrame, source: str = "", q: str = "", make: str = "", category: str = "", interest: str = "", section: str = "") -> DataFrame:
    """The filters of a listing, in any case; an unset one passes all, and an article without a section passes that one."""
    c = F.col
    rule = F.lit(True)
    if source:
        rule &= norm(c("publication")) == source.lower()
    if q:
        rule &= F.lower(F.concat_ws(" ", "title", "excerpt", "publication")).contains(q.lower())
    for column, wanted in (("makes", make), ("categories", category), ("interests", interest)):
        if wanted:
            rule &= F.array_contains(norms(c(column)), wanted.lower())
    if section:
        rule &= c("primary_category").isNull() | (norm(c("primary_category")) == section.lower())
    return rows.filter(rule)


# -- lists ------------------------------------------------------------------------------------------------------------
def list_order() -> list[Column]:
    band = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(BANDS) for x in (b, i)]), F.col("quality_band"))
    return [F.desc(band), F.desc("rank_score"), F.desc("published_at"), F.asc("id")]


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds position (from 1) within each list: band, score, newest, id. No sort over all lists together."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*list_order())))


def best_of_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each duplicate group of a list the best by list_order(); rows without a group all. Only groups are sorted, no list is."""
    group = F.coalesce("duplicate_group_id", F.lit(""))
    best = Window.partitionBy(*keys, "duplicate_group_id").orderBy(*list_order())
    grouped = rows.filter(group != "").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return grouped.unionByName(rows.filter(group == ""))


def cut_for_shaping(rows: DataFrame, keys: list[str], key: str, limit: int) -> DataFrame:
    """The rows of each list that diversify() and prefer_images() may bring among its first `limit`, so that only these are numbered.

    The first limit + 1 with an image, as many without one, and the best of each value of key: the row that
    diversify() moves forward is one of those.
    """
    no_image = F.coalesce(F.col("image_url") == "", F.lit(True))
    by_image = rows.withColumn("_no_image", no_image).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_no_image").orderBy(*list_order()))).filter(F.col("_n") <= limit + 1).drop("_n", "_no_image")
    by_key = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, key).orderBy(*list_order()))).filter("_n = 1").drop("_n")
    return by_image.unionByName(by_key).dropDuplicates([*keys, "id"])


LISTED = ["id", "published_at", "image_url", "duplicate_group_id", "rank_score", "quality_band", "show_in_primary_feed", "vehicle_tier"]


def personal_rows(articles: DataFrame, profiles: DataFrame, now_ms: int, limit: int = 80, culture: dict[str, list[str]] | None = None, variant_aliases: dict[str, str] | None = None, key: str = "primary_category", carry: list[str] = (), w: dict = WEIGHTS) -> DataFrame:
    """The rows of each profile's list in order (position): eligible articles are scored, banded, deduplicated, shaped; exact up to `limit`.

    Articles with a reason of the eligibility gate (column `reason`, if there is one) and those of the band excluded
    stay out. Every article is scored once without a profile, and each pair that shares something once more. What a list
    takes of the other articles follows from their common order: see unmatched_rows(). Both scores are written with the
    columns that lists need: filters on them would otherwise be pushed through the whole chain of scores and multiply it.
    """
    articles = articles.filter("reason is null").drop("reason") if "reason" in articles.columns else articles
    columns = list(dict.fromkeys([*LISTED, key, *carry]))
    judged = lambda rows: with_band(with_relevance(rows, w), w)
    pairs = written(judged(score_personal(articles, profiles, now_ms, culture, variant_aliases, w)).select("list_key", *columns), "pairs")
    base = written(judged(score_unmatched(articles, now_ms, variant_aliases, w)).select(*columns), "base")
    rest = unmatched_rows(base.filter("quality_band != 'excluded'"), pairs, profiles.select("list_key").distinct(), key, limit)
    rows = written(pairs.filter("quality_band != 'excluded'").unionByName(rest), "candidates")
    best = cut_for_shaping(best_of_groups(rows, ["list_key"]), ["list_key"], key, limit)
    return prefer_images(diversify(ranked(best, ["list_key"]), ["list_key"], key), ["list_key"])


def personal_lists(articles: DataFrame, profiles: DataFrame, now_ms: int, limit: int = 80, culture: dict[str, list[str]] | None = None, variant_aliases: dict[str, str] | None = None, key: str = "primary_category", w: dict = WEIGHTS) -> DataFrame:
    """Snapshot rows of personal_rows(): the first `limit` of each profile's list."""
    return top_lists(personal_rows(articles, profiles, now_ms, limit, culture, variant_aliases, key, (), w), limit)


def default_rows(articles: DataFrame, now_ms: int, w: dict = WEIGHTS) -> DataFrame:
    """Articles with the scores, band and tier of lists without a profile: the default score, and of signals the desk's alone."""
    none = {name: F.lit(0).cast("long") for name in BUCKETS}
    pick = F.coalesce("desk_pick", F.lit(False))
    score = default_score(F.col("source_relevance"), F.col("published_at"), F.col("excerpt"), pick, now_ms, w).cast("long")
    rows = articles.withColumns(none | {"desk_boost": F.when(pick, w["pick"]).otherwise(0).cast("long"), "score": score, "vehicle_tier": F.lit("none")})
    return with_band(with_relevance(rows, w), w)


def section_lists(articles: DataFrame, now_ms: int, limit: int = 80, sections: list[str] = SECTIONS, name: str = FOR_YOU, w: dict = WEIGHTS) -> DataFrame:
    """Snapshot rows of the lists that everyone sees: name:limit of all articles, and section:limit of each section.

    Eligible articles (no `reason`, if there is such a column) are scored without a profile, deduplicated in each list,
    ordered and mixed by media (is_video). An article is in two lists at most. Of each list only the first `limit`
    videos and others reach one task, by partial sorts: the mix of the first `limit` depends on no more.
    """
    from millrace.operators.shaping import spread_media

    rows = articles.filter("reason is null").drop("reason") if "reason" in articles.columns else articles
    rows = default_rows(rows, now_ms, w).select(*dict.fromkeys([*LISTED, "primary_category", "is_video"]))
    own = F.when(F.col("primary_category").isin(*sections), F.concat("primary_category", F.lit(f":{limit}")))
    rows = written(rows.withColumn("list_key", F.explode(F.array_compact(F.array(F.lit(f"{name}:{limit}"), own)))), "sections")
    best = best_of_groups(rows, ["list_key"]).withColumn("is_video", F.coalesce("is_video", F.lit(False)))
    first = best.withColumn("_n", F.row_number().over(Window.partitionBy("list_key", "is_video").orderBy(*list_order()))).filter(F.col("_n") <= limit).drop("_n")
    return top_lists(spread_media(ranked(first, ["list_key"]), ["list_key"], limit), limit)


def snapshot_lists(articles: DataFrame, profiles: DataFrame, now_ms: int, limit: int = 80, culture: dict[str, list[str]] | None = None, key: str = "primary_category", w: dict = WEIGHTS) -> DataFrame:
    """All stored lists: those of section_lists(), and for-you:limit:profile of each profile (list_key)."""
    own = personal_lists(articles, profiles, now_ms, limit, culture, key=key, w=w)
    return section_lists(articles, now_ms, limit, w=w).unionByName(own.withColumn("list_key", F.concat(F.lit(f"{FOR_YOU}:{limit}:"), "list_key")))


def ranked_feed(articles: DataFrame, now_ms: int, profiles: DataFrame | None = None, section: str = "", limit: int = 40, strict: Column | None = None, culture: dict[str, list[str]] | None = None, **filters: str) -> DataFrame:
    """One feed as it is shown: the filters of filter_articles() (and strict, a matches_profile()) first, then a profile's list or the common one."""
    rows = filter_articles(articles, section=section if section != FOR_YOU else "", **filters)
    rows = rows if strict is None else rows.filter(strict)
    if profiles is not None:
        return personal_lists(rows, profiles, now_ms, limit, culture)
    return section_lists(rows, now_ms, limit, [], section or FOR_YOU)


#: Places of the common order that a profile takes together.
STEP = 64


def unmatched_rows(base: DataFrame, pairs: DataFrame, profiles: DataFrame, key: str, limit: int) -> DataFrame:
    """Of the articles that a profile shares nothing with, all that cut_for_shaping() of its deduplicated list may take.

    base: a row an article, in an order that all profiles have in common. Heads are the first of their groups (or
    without group). Within each class (with image, without, each value of key) heads are numbered. A head counts for a profile
    if no article of its group is matched: then it stands in the profile's list before all that follow it. If i
    heads up to the n-th are touched, n - i stand; so the place up to which `quota` heads stand is quota plus the number of
    touched ones before it, which the touched heads' own numbers tell. Up to there all heads are taken, and of each touched
    group with m matched articles the first m + 1, one of which is not matched.
    """
    image = F.when(F.coalesce(F.col("image_url") == "", F.lit(True)), "image:no").otherwise("image:yes")
    own = F.coalesce(F.col("duplicate_group_id"), F.lit(""))
    base = base.withColumn("_group", F.when(own != "", F.concat(F.lit("g"), own)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    grouped = numbered(base.filter(own != ""), ["_group"], list_order()).withColumnRenamed("position", "_in_group")
    whole = grouped.unionByName(base.filter(own == "").withColumn("_in_group", F.lit(1)))
    heads = whole.filter("_in_group = 1").withColumn("_class", F.explode(F.array(image, F.concat(F.lit("key:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))))
    heads = written(numbered(heads, ["_class"], list_order()).withColumnRenamed("position", "_place"), "heads")
    classes = heads.select("_class").distinct().withColumn("_quota", F.when(F.col("_class").startswith("image:"), limit + 1).otherwise(1))

    matched_group = F.coalesce(F.col("duplicate_group_id"), F.lit(""))
    touched = pairs.withColumn("_group", F.when(matched_group != "", F.concat(F.lit("g"), matched_group)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))).groupBy("list_key", "_group").agg(F.count("*").alias("_matched"))
    touched = written(touched, "touched")
    bad = touched.join(shuffled(heads.select("_group", "_class", "_place")), "_group").withColumn("_i", F.row_number().over(Window.partitionBy("list_key", "_class").orderBy("_place")))
    bad = bad.join(sized_broadcast(classes), "_class").filter(F.col("_place") - F.col("_i") < F.col("_quota")).groupBy("list_key", "_class").agg(F.count("*").alias("_skipped"))
    wanted = profiles.join(sized_broadcast(classes)).join(shuffled(bad), ["list_key", "_class"], "left").withColumn("_last", F.col("_quota") + F.coalesce("_skipped", F.lit(0)))
    steps = wanted.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / STEP)))).select("list_key", "_class", "_last", "_step")
    near = heads.withColumn("_step", F.floor(F.col("_place") / STEP)).join(shuffled(steps), ["_class", "_step"]).filter(F.col("_place") <= F.col("_last"))
    others = touched.join(shuffled(whole), "_group").filter(F.col("_in_group") <= F.col("_matched") + 1)
    columns = ["list_key", *[c for c in base.columns if not c.startswith("_")]]
    found = near.select(*columns).unionByName(others.select(*columns)).dropDuplicates(["list_key", "id"])
    return found.join(shuffled(pairs.select("list_key", "id")), ["list_key", "id"], "left_anti")


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As renumbered(), for lists of any length: ranges of a list are numbered in their own tasks, and begin where those before end."""
    cut = [*(F.asc(k) for k in keys), *order]
    dealt = written(rows.repartitionByRange(*cut).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = dealt.withColumn("position", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    joined = within.join(sized_broadcast(starts), [*keys, "_part"])
    return joined.withColumn("position", (F.col("position") + F.col("_start")).cast("int")).select(*[c for c in rows.columns if c != "position"], "position")


def renumbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def prefer_images(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All with an image first, then those without, each in their order."""
    return renumbered(rows, keys, [F.col("image_url").isNull() | (F.col("image_url") == ""), F.asc("position")])


def diversify(rows: DataFrame, keys: list[str], key: str, window: int = 5) -> DataFrame:
    """If the first `window` share one key that is not empty, the first later row with another one moves to their last place.

    What decides is one row a list, from aggregates; no list is held or sorted.
    """
    value = F.coalesce(key, F.lit(""))
    position = F.col("position")
    head = rows.filter(position <= window).groupBy(*keys).agg(F.min_by(value, "position").alias("_first"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    alike = written(head.filter("_first != '' AND _low = _high").drop("_low", "_high"), "alike")
    later = rows.filter((position > window) & (value != "")).join(sized_broadcast(alike), keys).filter(value != F.col("_first"))
    swaps = written(later.groupBy(*keys).agg(F.min("position").alias("_swap")), "swaps")
    joined = rows.join(sized_broadcast(swaps), keys, "left")
    new = F.when(F.col("_swap").isNull(), position).when(position == F.col("_swap"), window).when((position >= window) & (position < F.col("_swap")), position + 1).otherwise(position)
    return joined.withColumn("position", new.cast("int")).select(*rows.columns)


def top_lists(rows: DataFrame, limit: int = 80) -> DataFrame:
    """Snapshot rows (list_key, position from 0, article_id, score, ...) of the first `limit` of each list."""
    kept = renumbered(rows, ["list_key"], [F.asc("position")]).filter(F.col("position") <= limit)
    return kept.select("list_key", (F.col("position") - 1).alias("position"), F.col("id").alias("article_id"), js_round(F.col("rank_score")).cast("long").alias("score"), "quality_band", "show_in_primary_feed", "vehicle_tier")


def prepend(rows: DataFrame, first: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows named in first (id, slot) in that order, then the others; `limit` of each list."""
    joined = rows.join(first, "id", "left")
    return renumbered(joined, keys, [F.asc_nulls_last("slot"), F.asc("position")]).filter(F.col("position") <= limit).drop("slot")


def section_rails(rows: DataFrame, featured: DataFrame, pool: int = 12, n: int = 5) -> DataFrame:
    """Per section its best few: not featured elsewhere first. The best of a section always opens it."""
    best = renumbered(rows, ["primary_category"], [F.asc("position")]).filter(F.col("position") <= pool)
    marked = best.join(featured.select("id").withColumn("_f", F.lit(True)), "id", "left")
    return renumbered(marked, ["primary_category"], [F.col("position") != 1, F.coalesce("_f", F.lit(False)), F.asc("position")]).filter(F.col("position") <= n).drop("_f")


def reader_overlay(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds delta and the new rank_score and position of each visitor's list (visitor_key, id, makes, interests, rank_score).

    signals: visitor_key, interested_ids, less_ids, saved_ids, recent_ids. A mark on the article itself counts, or else
    what it shares with marked ones. Without any signal a list stays as it is.
    """
    s = {k: f"{k}_ids" for k in ("interested", "less", "saved", "recent")}
    joined = rows.join(signals, "visitor_key", "left")
    tokens = F.filter(F.array_union(norms(F.col("makes")), norms(F.col("interests"))), lambda x: x != "")
    marked = {k: F.coalesce(F.array_contains(c, F.col("id")), F.lit(False)) for k, c in s.items()}
    joined = joined.withColumns({"_tokens": tokens} | {f"_{k}": v for k, v in marked.items()})
    pools = joined.groupBy("visitor_key").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(F.col(f"_{k}"), F.col("_tokens"))))).alias(f"_pool_{k}") for k in ("interested", "less", "saved")])
    joined = joined.join(pools, "visitor_key")
    shares = {k: F.arrays_overlap("_tokens", f"_pool_{k}") for k in ("interested", "less", "saved")}
    c, own = F.col, F.col("_interested") | F.col("_less")
    add = lambda rule, what: F.when(rule, READER[what]).otherwise(0)
    delta = (
        F.when(c("_interested"), READER["interested"]).when(c("_less"), READER["less"]).otherwise(add(shares["interested"], "interested_similar") + add(shares["less"], "less_similar"))
        + F.when(c("_saved"), READER["saved"]).otherwise(add(~own & shares["saved"], "saved_similar")) + add(c("_recent") & ~own, "recent")
    )
    active = F.coalesce(sum((F.size(c(x)) for x in s.values()), F.lit(0)) > 0, F.lit(False))
    joined = joined.withColumns({"delta": F.when(active, delta).otherwise(0), "_active": active})
    joined = joined.withColumn("rank_score", F.col("rank_score") + F.col("delta"))
    order = [F.when(F.col("_active"), 0).otherwise(F.col("position")), F.desc("rank_score"), F.asc("id")]
    out = renumbered(joined, ["visitor_key"], order)
    return out.select(*rows.columns, "delta")


def top_pool(rows: DataFrame, size: int = 80) -> DataFrame:
    """The best rows over all lists, numbered: partial sorts in all tasks, then one of `size` rows."""
    return rows.orderBy(*list_order()).limit(size).withColumn("position", F.row_number().over(Window.orderBy(*list_order())))


def rank_titles(profiles: DataFrame, titles: DataFrame, most: int = 4) -> DataFrame:
    """Per profile the print titles that fit: +40 for a shared make, +12 a shared interest; curated order first; score above 0.

    titles is a small catalogue, one row a title, and goes to every task.
    """
    p = profiles.select("profile_id", norms(F.col("makes")).alias("_pm"), norms(F.col("interests")).alias("_pi"))
    score = F.when(F.arrays_overlap("_pm", norms(F.col("makes"))), 40).otherwise(0) + 12 * F.size(F.array_intersect("_pi", norms(F.col("interests")))) + F.coalesce("boost", F.lit(0))
    rows = p.join(sized_broadcast(titles), F.lit(True)).withColumn("score", score).filter("score > 0")
    order = Window.partitionBy("profile_id").orderBy(F.asc_nulls_last("curated_rank"), F.desc("score"), "slot")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("profile_id", "title_id", "score", "position")


def hydrate(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Stored list entries with their articles; entries of articles that are gone or no longer eligible drop out.

    articles: with the gate's reason, or with what the gate asks of an article, which then is run again.
    """
    judged = articles if "reason" in articles.columns else with_gate(articles)
    live = judged.filter("reason is null").drop("reason")
    return entries.join(live.withColumnRenamed("id", "article_id"), "article_id").withColumn("position", F.row_number().over(Window.partitionBy("list_key").orderBy("position")) - 1)
