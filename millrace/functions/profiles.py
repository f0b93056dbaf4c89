"""Expressions on profiles, interests, query strings and small labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event names of clients and those that are stored.
STORED_NAMES = {"story_share": "share", "story_save": "save", "story_unsave": "unsave", "outbound_original_click": "outbound", "story_interested": "interested", "story_less_like_this": "less_like_this", "story_open": "story_open", "experience_feedback": "experience_feedback"}
DAY_MS = 86_400_000


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def stored_event_name(c: Column) -> Column:
    return F.try_element_at(_map(STORED_NAMES), c)


def canonical_interest(c: Column, labels: list[str], aliases: dict[str, str]) -> Column:
    """An exact label, else by alias in any case, else the squeezed text itself."""
    plain = squeeze(c)
    known = {label.lower(): label for label in labels} | {a.lower(): label for a, label in aliases.items()}
    return F.when(plain.isin(*labels), plain).otherwise(F.coalesce(F.try_element_at(_map(known), F.lower(plain)), plain))


def normalize_interests(c: Column, labels: list[str], aliases: dict[str, str]) -> Column:
    """Canonical, known and distinct, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: canonical_interest(x, labels, aliases)), lambda x: x.isin(*labels)))


def card_tag(categories: Column, section: Column) -> Column:
    """The first category other than news, else the section."""
    return F.coalesce(F.try_element_at(F.filter(categories, lambda x: F.lower(x) != "news"), F.lit(1)), section)


def _values(query: Column, name: str) -> Column:
    """All values of a parameter, repeated or separated by commas, decoded and clean."""
    pairs = F.filter(F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    texts = F.flatten(F.transform(pairs, lambda p: F.split(F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")), ",")))
    clean = F.transform(texts, squeeze)
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & (F.length(x) <= 80) & ~x.rlike(r"[<>\p{Cntrl}]")))


def parse_profile(query: Column, labels: list[str], aliases: dict[str, str], presets: dict[str, dict[str, list[str]]] | None = None) -> Column:
    """makes, models, generations, interests and location of a query string; a preset fills what is not set."""
    none = F.array().cast("array<string>")
    preset = F.try_element_at(_values(query, "preset"), F.lit(1))

    def field(name: str, key: str) -> Column:
        given = _values(query, name)
        default = none
        for pid, fields in (presets or {}).items():
            default = F.when(preset == pid, F.array(*[F.lit(x) for x in fields.get(key, [])]).cast("array<string>")).otherwise(default)
        return F.when(F.size(given) > 0, given).otherwise(default)

    return F.struct(field("make", "makes").alias("makes"), field("model", "models").alias("models"), field("generation", "generations").alias("generations"), normalize_interests(field("interest", "interests"), labels, aliases).alias("interests"), F.try_element_at(field("location", "location"), F.lit(1)).alias("location"))


def profile_key(profile: Column) -> Column:
    """A stable key of a profile: its fields in a fixed order, values sorted."""
    listed = lambda name, short: F.when(F.size(profile[name]) > 0, F.concat(F.lit(f"{short}="), F.array_join(F.array_sort(F.transform(profile[name], F.lower)), ",")))
    return F.concat_ws("&", listed("makes", "make"), listed("models", "model"), listed("generations", "generation"), listed("interests", "interest"), F.when(profile["location"].isNotNull(), F.concat(F.lit("location="), F.lower(profile["location"]))))


def explicit_cohort(profile: Column) -> Column:
    """The first make, else the first interest."""
    return F.coalesce(F.try_element_at(profile["makes"], F.lit(1)), F.try_element_at(profile["interests"], F.lit(1)))


def relevance_confidence(signals: Column, tier: Column, score: Column) -> Column:
    """How sure it is that a story is of interest: by the vehicle's tier, then interests, then what is known of the story."""
    has = lambda kind: F.exists(signals, lambda s: s["kind"] == kind)
    editorial = F.exists(signals, lambda s: s["kind"].startswith("editorial"))
    return F.when(tier.isin("variant", "vehicle"), "high").when(tier.isin("model", "generation") | has("interest"), "medium").when((tier == "make") | has("culture") | (score > 0) & editorial, "low").otherwise("none")


def vehicle_label(vehicle: Column) -> Column:
    """make, model, generation and variant, as far as they are known; null if none is."""
    parts = F.filter(F.array(*[F.trim(vehicle[n]) for n in ("make", "model", "generation", "variant")]), lambda x: x != "")
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def explain_line(signals: Column, tier: Column, lane: Column, vehicles: Column, why: Column | None = None) -> Column:
    """One line for why a story is shown in a lane, or null. Lines that the ranking gave (why) go before new ones.

    signals: (kind, detail) in order; tier: of the vehicle; vehicles: (make, model, generation, variant), the first with
    a name and the first make count. A vehicle's signal decides alone, even where there is no line for it; so do
    interests, in the lanes vehicle, interests and discover. Then come culture (discover), the place, and (discover)
    the story's own quality.
    """
    why = F.array().cast("array<string>") if why is None else why
    said = lambda pattern: F.try_element_at(F.filter(why, lambda w: F.lower(w).rlike(pattern)), F.lit(1))
    first = lambda which: F.try_element_at(F.filter(signals, which), F.lit(1))
    of_kind = lambda kind: first(lambda s: s["kind"] == kind)
    labels = F.filter(F.transform(vehicles, vehicle_label), lambda x: x.isNotNull())
    car = F.try_element_at(labels, F.lit(1))
    make = F.nullif(F.trim(F.try_element_at(vehicles, F.lit(1))["make"]), F.lit(""))
    line = lambda pattern, needed, *parts: F.when(needed.isNotNull(), F.coalesce(said(pattern), F.concat(*parts)))
    vehicle, interest, culture, place = first(lambda s: s["kind"].startswith("vehicle.")), of_kind("interest"), of_kind("culture"), of_kind("location")
    discover, detail = lane == "discover", F.nullif(interest["detail"], F.lit(""))
    mentioned = F.lower(F.substring_index(vehicle["detail"], " ", 1)) == "mentioned"
    about_car = (
        F.when(mentioned, line("mentions your", car, F.lit("Mentions your "), car)).when(tier == "category", line("in the world of your", car, F.lit("In the world of your "), car))
        .when(tier == "make", line("relevant to", make, F.lit("Relevant to "), make, F.lit(" owners"))).otherwise(line("because you drive", car, F.lit("Because you drive a "), car))
    )
    about_interest = F.coalesce(said("because you (follow|like)"), F.concat(F.when(detail.contains(" + "), "Because you like ").otherwise("Because you follow "), detail))
    about_place = F.when((place["detail"] != "") & (place["detail"] != "location"), F.coalesce(said("because it's in"), F.concat(F.lit("Because it's in "), place["detail"]))).otherwise("Near you")
    return (
        F.when(vehicle.isNotNull() & (F.coalesce(tier, F.lit("none")) != "none"), about_car).when(interest.isNotNull() & lane.isin("vehicle", "interests", "discover"), about_interest)
        .when(discover & (culture["detail"] != ""), F.concat(F.lit("From the world of "), culture["detail"])).when(place.isNotNull(), about_place)
        .when(discover & of_kind("editorial.quality").isNotNull(), "Worth a look")
    )


def is_this_week(rows: DataFrame, now_ms: int, days: int = 7, near_ms: int = DAY_MS) -> DataFrame:
    """Adds this_week: published or first seen within days, or within a day of the newest ingest of the pool (one number)."""
    newest = rows.agg(F.max("first_seen").alias("_newest"))
    since = now_ms - days * DAY_MS
    flagged = rows.join(F.broadcast(newest), F.lit(True))
    return flagged.withColumn("this_week", (F.col("published_at") >= since) | (F.col("first_seen") >= since) | (F.col("first_seen") >= F.col("_newest") - near_ms)).drop("_newest")


def select_by_bucket(rows: DataFrame, targets: dict[str, int], most: int) -> DataFrame:
    """The best rows of each bucket up to its target, then the best of all others, `most` together; ties by url."""
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("bucket")), F.lit(0))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "url")))
    rows = rows.withColumn("in_quota", F.col("_n") <= quota).drop("_n")
    return rows.orderBy(F.desc("in_quota"), F.desc("score"), "url").limit(most)
