"""Greedy list shaping, one small list per group. Lists are cut before, exactly, so no group grows with the data."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import written

#: Sections that stand next to each other.
ADJACENT = {"cars": ["culture", "driving"], "culture": ["cars", "events"], "driving": ["cars", "motorsport"], "motorsport": ["driving", "events"], "events": ["culture", "driving"]}

#: Why a story is offered, the best reason first.
REASONS = ["shared-topic", "same-marque", "same-category", "user-interest", "adjacent-category", "editorial"]


def spread_media(rows: DataFrame, keys: list[str], limit: int, max_share: float = 0.25, max_run: int = 1) -> DataFrame:
    """The first `limit` of each list (position, is_video), videos let in only while they hold their share and run.

    The result depends on the first `limit` videos and the first `limit` others only, so just these reach the group.
    """
    order = Window.partitionBy(*keys, "is_video").orderBy("position")
    cut = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")

    def shape(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        waiting: deque[int] = deque()
        picked: list[int] = []
        videos = run = 0

        def fits() -> bool:
            return (videos + 1) / (len(picked) + 1) <= max_share + 1e-9 and run < max_run

        for i, video in enumerate(group.is_video):
            if video:
                if not fits():
                    waiting.append(i)
                    continue
                picked.append(i)
                videos, run = videos + 1, run + 1
                continue
            picked.append(i)
            run = 0
            while waiting and fits():
                picked.append(waiting.popleft())
                videos, run = videos + 1, run + 1
        out = group.iloc[[*picked, *waiting][:limit]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    return cut.groupBy(*keys).applyInPandas(shape, cut.schema)


def take_diverse(pool: list[dict], n: int, used: set, subjects: set, avoid_make: str = "") -> list[dict]:
    """Two greedy passes: first no third story of one make in a row and none of avoid_make, then whatever is left."""
    picked: list[dict] = []
    for strict in (True, False):
        for row in pool:
            if len(picked) >= n:
                return picked
            if row["id"] in used or (row["subject"] and row["subject"] in subjects):
                continue
            make = (row["make"] or "").lower()
            if strict and (make and make == avoid_make.lower() or len(picked) > 1 and make and all((x["make"] or "").lower() == make for x in picked[-2:])):
                continue
            picked.append(row)
            used.add(row["id"])
            if row["subject"]:
                subjects.add(row["subject"])
    return picked


def _lanes(pool: list[dict], make: str | None, reserved: set, cars: int, interests: int, discover: int) -> dict[str, list[dict]]:
    """The three lanes of one profile, whose first vehicle is of a make ('' if it has none; null: no vehicle)."""
    avoid = make or ""
    used, subjects = set(reserved), set()
    available = [r for r in pool if r["id"] not in reserved]
    shown = [r for r in available if r["show_in_primary_feed"]]
    liked = sorted((r for r in shown if r["interest_match"] > 0), key=lambda r: r["interest_rank"])
    mixed: list[dict] = []
    if make is not None:
        near = [r for r in shown if r["vehicle_tier"] in ("variant", "vehicle", "model", "generation")] + [r for r in shown if r["vehicle_tier"] == "make"]
        primary = deque(take_diverse(near, cars, used, subjects))
        filler = deque(take_diverse([r for r in shown if r["vehicle_tier"] == "category"] + liked, 2, used, subjects, avoid))
        while len(mixed) < cars and (primary or filler):
            own = (primary[0]["make"] or "").lower() if primary else ""
            third = own and len(mixed) > 1 and all((x["make"] or "").lower() == own for x in mixed[-2:])
            mixed.append(filler.popleft() if filler and (third or not primary) else primary.popleft())
    other = [r for r in available if make is None or not r["show_in_primary_feed"] or (r["make"] or "").lower() != avoid.lower() or r["vehicle_tier"] == "none"]
    lanes = {"car": mixed, "interests": take_diverse(liked, interests, used, subjects, avoid)}
    return lanes | {"discover": take_diverse(other, discover, used, subjects, avoid)}


def home_lanes(rows: DataFrame, key: str, reserved: DataFrame | None = None, cars: int = 5, interests: int = 4, discover: int = 4, pool: int = 80) -> DataFrame:
    """Per profile three lanes that share no story: car (matches of its vehicle, with two fillers between), interests, discover.

    rows: key, position, id, subject, make, vehicle_tier, interest_match, and where they are known show_in_primary_feed,
    interest_rank (place of the interest in the profile) and profile_make. Only the first `pool` of a list count. reserved
    (key, id): stories that stand on the page already; no lane shows them. Discover may show what the feed leaves out.
    """
    cut = rows.filter(F.col("position") <= pool)
    known = {"show_in_primary_feed": F.lit(True), "interest_rank": F.lit(0), "profile_make": F.lit("")}
    cut = cut.withColumns({name: value for name, value in known.items() if name not in rows.columns})
    kind = dict(rows.dtypes)
    nothing = rows.sparkSession.createDataFrame([], f"_key {kind[key]}, id {kind['id']}")
    taken = nothing if reserved is None else reserved.select(F.col(key).alias("_key"), "id").distinct()

    def shape(of: tuple, group: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        listed = group.sort_values("position").to_dict("records") if len(group) else []  # a side without rows has no columns
        lanes = _lanes(listed, listed[0]["profile_make"], set(kept.id) if len(kept) else set(), cars, interests, discover) if listed else {}
        return pd.DataFrame([(of[0], lane, i + 1, r["id"]) for lane, picks in lanes.items() for i, r in enumerate(picks)], columns=[key, "lane", "slot", "id"])

    return cut.groupBy(key).cogroup(taken.groupBy("_key")).applyInPandas(shape, f"{key} {kind[key]}, lane string, slot int, id {kind['id']}")


#: Rules of the passes over an opening pool, relaxed one by one: of this week, of a new publication, not an opener of last week, no stale pick.
OPENING_PASSES = [(True, True, True, True), (True, True, False, True), (False, True, True, True), (False, True, False, False), (False, False, False, False)]


def _openers(listed: list[dict], n: int, ids: set, publications: set) -> list:
    """n picks of a pool in order; what they use is added to the two sets. A desk pick is stale while there are stories of this week and it is none."""
    week_exists = any(r["this_week"] for r in listed)
    picked: list = []
    for week, unique, fresh, no_stale in OPENING_PASSES:
        for r in listed:
            if len(picked) >= n:
                return picked
            publication = (r["publication"] or "").strip().lower()
            stale = r["desk_pick"] and week_exists and not r["this_week"]
            if r["id"] in ids or week and not r["this_week"] or unique and publication in publications or fresh and r["last_week"] or no_stale and stale:
                continue
            picked.append(r["id"])
            ids.add(r["id"])
            if publication:
                publications.add(publication)
    return picked


def opening_picks(rows: DataFrame, key: str, n: int, pool: int = 80) -> DataFrame:
    """Openers of each page by OPENING_PASSES. rows: key, position, id, publication, this_week, last_week (was an opener), desk_pick."""
    cut = rows.filter(F.col("position") <= pool)

    def shape(group: pd.DataFrame) -> pd.DataFrame:
        picked = _openers(group.sort_values("position").to_dict("records"), n, set(), set())
        return pd.DataFrame([(group[key].iloc[0], i + 1, x) for i, x in enumerate(picked)], columns=[key, "slot", "id"])

    kind = dict(rows.dtypes)
    return cut.groupBy(key).applyInPandas(shape, f"{key} {kind[key]}, slot int, id {kind['id']}")


def keep_exploring(articles: DataFrame, pool: DataFrame, interests: list[str] = (), make: str = "", most: int = 6, least: int = 2, size: int = 80) -> DataFrame:
    """For each article up to six picks from the pool: shared topic, same make, same section, own interest, next section, any.

    The first `size` rows of the pool by position, a bounded list, go to every task. Picks follow from an article's
    interests, makes and section alone, unless it is of the pool itself: so they are found once for each distinct
    combination, and joined back. Of the rest, stories of the reader's own make count only if they are of no tier or not in
    the primary feed (columns of the pool, if it has them).
    """
    known = {"vehicle_tier": F.lit("none"), "show_in_primary_feed": F.lit(True)}
    cut = pool.withColumns({name: value for name, value in known.items() if name not in pool.columns}).filter(F.col("position") <= size)
    low = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    cells = ["id", low(F.col("interests")).alias("interests"), low(F.col("makes")).alias("makes"), "primary_category", "vehicle_tier", "show_in_primary_feed", F.coalesce(F.try_element_at("makes", F.lit(1)), F.lit("")).alias("make"), F.coalesce("duplicate_group_id", F.lit("")).alias("subject")]
    picks = [r.asDict() | {"interests": set(r.interests), "makes": set(r.makes)} for r in cut.orderBy("position").limit(size).select(*cells).collect()]
    wanted, own = {x.lower().strip() for x in interests}, make.lower().strip()

    def chosen(topics: set, makes: set, section: str | None, article: int | None) -> list[tuple[int, str]]:
        others = [p for p in picks if p["id"] != article]
        shared = lambda p: len(topics & p["interests"])
        buckets = [
            sorted((p for p in others if shared(p)), key=lambda p: -shared(p)), [p for p in others if makes & p["makes"]], [p for p in others if section is not None and p["primary_category"] == section and not makes & p["makes"]],
            [p for p in others if wanted & p["interests"]], [p for p in others if p["primary_category"] in ADJACENT.get(section, ())],
            [p for p in others if not own or own not in p["makes"] or p["vehicle_tier"] == "none" or not p["show_in_primary_feed"]],
        ]
        used: set = set()
        subjects: set = set()
        found: list[tuple] = []
        for why, bucket in zip(REASONS, buckets, strict=True):
            found += [(p["id"], why) for p in take_diverse(bucket, most - len(found), used, subjects)]
        return found if len(found) >= least else []

    def judge(frames):
        for frame in frames:
            found = [chosen(set(t), set(m), s, None if pd.isna(a) else a) for t, m, s, a in zip(frame._topics, frame._makes, frame._section, frame._self, strict=True)]
            yield frame.assign(picks=[[{"pick_id": i, "reason": why} for i, why in x] for x in found])

    sig = ["_topics", "_makes", "_section"]
    rows = articles.select("id", low(F.col("interests")).alias("_topics"), low(F.col("makes")).alias("_makes"), F.col("primary_category").alias("_section"))
    rows = rows.withColumn("_self", F.when(F.col("id").isin([p["id"] for p in picks]), F.col("id").cast("long")))
    distinct = rows.select(*sig, "_self").distinct()
    schema = "_topics array<string>, _makes array<string>, _section string, _self long, picks array<struct<pick_id:long,reason:string>>"
    judged = written(distinct.mapInPandas(judge, schema).filter("size(picks) > 0"), "picks").withColumnsRenamed({c: f"{c}_" for c in [*sig, "_self"]})
    same = F.lit(True)
    for c in [*sig, "_self"]:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = rows.join(judged, same).select(F.col("id").alias("article_id"), F.posexplode("picks").alias("n", "p"))
    return found.select("article_id", (F.col("n") + 1).alias("slot"), "p.pick_id", "p.reason")


def home_lead(lanes: DataFrame, key: str, reserved: DataFrame) -> DataFrame:
    """Per profile the hero and the lead card: the first car stories that are not reserved, else the first of interests."""
    rows = lanes.filter(F.col("lane").isin("car", "interests")).join(reserved.select("id"), "id", "left_anti")
    order = Window.partitionBy(key).orderBy(F.when(F.col("lane") == "car", 0).otherwise(1), "slot")
    rows = rows.withColumn("n", F.row_number().over(order)).filter("n <= 2")
    return rows.select(key, F.when(F.col("n") == 1, "hero").otherwise("lead").alias("place"), "id")


def rail_openers(rails: DataFrame, key: str, openers: DataFrame) -> DataFrame:
    """One opener for each rail of a page by OPENING_PASSES, in the order of the rails; none that opens the page or an earlier rail.

    rails: key, rail (its place), position, id, publication, this_week, last_week, desk_pick; each rail cut to a fixed pool
    by the caller. openers: key, id, publication.
    """
    kind = dict(rails.dtypes)

    def shape(page: tuple, listed: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        ids, publications = (set(opened.id), {p.strip().lower() for p in opened.publication.dropna()} - {""}) if len(opened) else (set(), set())
        out = [] if listed.empty else [(page[0], rail, x) for rail, rows in listed.sort_values(["rail", "position"]).groupby("rail", sort=True) for x in _openers(rows.to_dict("records"), 1, ids, publications)]
        return pd.DataFrame(out, columns=[key, "rail", "id"])

    return rails.groupBy(key).cogroup(openers.select(key, "id", "publication").groupBy(key)).applyInPandas(shape, f"{key} {kind[key]}, rail {kind['rail']}, id {kind['id']}")
