"""Lanes, openers and keep-exploring over random lists, against the rules applied one story at a time."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import shaping as sh

TIERS = ["variant", "vehicle", "model", "generation", "make", "category", "none"]


def greedy(pool, n, used, subjects, avoid=""):
    """take_diverse by its rules: strict, then loose."""
    out = []
    for strict in (1, 0):
        for r in pool:
            run = len(out) >= 2 and r["make"] and {x["make"].lower() for x in out[-2:]} == {r["make"].lower()}
            blocked = r["id"] in used or (r["subject"] and r["subject"] in subjects) or strict and (run or avoid and r["make"].lower() == avoid.lower())
            if len(out) < n and not blocked:
                out.append(r)
                used.add(r["id"])
                subjects.add(r["subject"])
    return out


def some_list(rng, n, key):
    return [
        {"list_key": key, "position": i + 1, "id": i * 7 % 1000, "subject": rng.choice(["", "", f"s{rng.randint(0, 9)}"]), "make": rng.choice(["", "Ford", "ford", "BMW"]), "vehicle_tier": rng.choice(TIERS), "interest_match": rng.choice([0, 0, 20]), "show_in_primary_feed": rng.random() < 0.8, "interest_rank": rng.randint(0, 2)}
        for i in range(n)
    ]


def lanes_plainly(rows, make, reserved):
    used, subjects = set(reserved), set()
    rows = [r for r in rows[:80] if r["id"] not in reserved]
    feed = [r for r in rows if r["show_in_primary_feed"]]
    liked = [r for k in range(3) for r in feed if r["interest_match"] and r["interest_rank"] == k]
    car = []
    if make is not None:
        direct = [r for r in feed if r["vehicle_tier"] in TIERS[:4]] + [r for r in feed if r["vehicle_tier"] == "make"]
        first = greedy(direct, 5, used, subjects)
        fill = greedy([r for r in feed if r["vehicle_tier"] == "category"] + liked, 2, used, subjects, make)
        while len(car) < 5 and first + fill:
            third = first and first[0]["make"] and len(car) > 1 and car[-1]["make"].lower() == car[-2]["make"].lower() == first[0]["make"].lower()
            car.append(fill.pop(0) if fill and (third or not first) else first.pop(0))
    interests = greedy(liked, 4, used, subjects, make or "")
    wide = [r for r in rows if make is None or not r["show_in_primary_feed"] or r["make"].lower() != make.lower() or r["vehicle_tier"] == "none"]
    return {"car": car, "interests": interests, "discover": greedy(wide, 4, used, subjects, make or "")}


def test_lanes_against_the_rules(spark):
    rng = random.Random(1)
    lists = {f"p{k}": some_list(rng, rng.choice([0, 3, 12, 120]), f"p{k}") for k in range(30)}
    makes = {k: rng.choice([None, "", "Ford", "bmw"]) for k in lists}
    reserved = {k: {r["id"] for r in rng.sample(rows, min(len(rows), 3))} for k, rows in lists.items()}
    rows = [tuple(r.values()) + (makes[k],) for k, many in lists.items() for r in many]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "list_key string, position int, id long, subject string, make string, vehicle_tier string, interest_match int, show_in_primary_feed boolean, interest_rank int, profile_make string")
    held = spark.createDataFrame([(k, i) for k, ids in reserved.items() for i in ids], "list_key string, id long")
    for taken, ids in ((held, reserved), (None, {k: set() for k in lists})):
        got = {}
        for r in sh.home_lanes(frame, "list_key", taken).orderBy("slot").collect():
            got.setdefault((r.list_key, r.lane), []).append(r.id)
        want = {(k, lane): [r["id"] for r in picks] for k, many in lists.items() for lane, picks in lanes_plainly(many, makes[k], ids[k]).items() if picks}
        assert got == want
        for k in lists:
            shown = [i for lane in ("car", "interests", "discover") for i in got.get((k, lane), [])]
            assert len(shown) == len(set(shown)) and not set(shown) & ids[k]
    # optional columns have defaults; the hero and lead cards respect what is reserved, too
    bare = sh.home_lanes(frame.drop("show_in_primary_feed", "interest_rank", "profile_make"), "list_key")
    assert bare.count() > 0
    assert sh.home_lead(bare, "list_key", spark.createDataFrame([(7,)], "id long")).filter("id = 7").count() == 0


def openers_plainly(rows, n, ids, publications):
    exists = any(r["this_week"] for r in rows)
    out = []
    for week, unique, fresh, stale in [(1, 1, 1, 1), (1, 1, 0, 1), (0, 1, 1, 1), (0, 1, 0, 0), (0, 0, 0, 0)]:
        for r in rows:
            ok = r["id"] not in ids and (not week or r["this_week"]) and (not fresh or not r["last_week"]) and not (stale and r["desk_pick"] and exists and not r["this_week"])
            if len(out) < n and ok and not (unique and r["publication"] and r["publication"].lower() in publications):
                out.append(r["id"])
                ids.add(r["id"])
                publications.add((r["publication"] or "").lower())
                publications.discard("")
    return out


def some_pool(rng, key, n):
    return [{"page": key, "position": i + 1, "id": i, "publication": rng.choice(["A", "a", "B", "C", "", None]), "this_week": rng.random() < 0.3, "last_week": rng.random() < 0.3, "desk_pick": rng.random() < 0.3} for i in range(n)]


def test_openers_against_the_rules(spark):
    rng = random.Random(2)
    pools = {f"p{k}": some_pool(rng, f"p{k}", rng.choice([1, 4, 20, 100])) for k in range(25)}
    schema = "page string, position int, id long, publication string, this_week boolean, last_week boolean, desk_pick boolean"
    frame = spark.createDataFrame([tuple(r.values()) for many in pools.values() for r in many], schema)
    got = {}
    for r in sh.opening_picks(frame, "page", 5).orderBy("slot").collect():
        got.setdefault(r.page, []).append(r.id)
    assert got == {k: openers_plainly(many[:80], 5, set(), set()) for k, many in pools.items()}
    rails = frame.filter("position <= 12").withColumn("rail", F.pmod(F.col("id"), F.lit(3)).cast("int"))
    opened = frame.filter("position <= 2").select("page", "id", "publication")
    want = set()
    for k, many in pools.items():
        ids, publications = {r["id"] for r in many[:2]}, {(r["publication"] or "").lower() for r in many[:2]} - {""}
        for rail in range(3):
            want |= {(k, rail, i) for i in openers_plainly([r for r in many[:12] if r["id"] % 3 == rail], 1, ids, publications)}
    assert {tuple(r) for r in sh.rail_openers(rails, "page", opened).collect()} == want


@pytest.mark.parametrize(("interests", "make"), [((), ""), (("Rally",), "Ford")])
def test_keep_exploring_against_the_rules(spark, interests, make):
    rng = random.Random(3)
    some = lambda xs: rng.sample(xs, rng.randint(0, 2))
    rows = [(i, some(["Rally", "rally ", "Tuning", "Design"]), some(["Ford", "ford", "BMW"]), rng.choice(["cars", "culture", "driving", "news", None]), rng.choice([None, "", "g1", "g2", "g3"]), rng.choice(["none", "make"]), rng.random() < 0.7) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, interests array<string>, makes array<string>, primary_category string, duplicate_group_id string, vehicle_tier string, show_in_primary_feed boolean")
    pool = frame.filter("id % 3 = 0").withColumn("position", (F.col("id") / 3 + 1).cast("int"))
    low = lambda xs: {x.lower().strip() for x in xs}
    picks = [{"id": r[0], "topics": low(r[1]), "makes": low(r[2]), "make": (r[2] or [""])[0], "section": r[3], "subject": r[4] or "", "tier": r[5], "feed": r[6]} for r in rows if r[0] % 3 == 0][:20]
    want = []
    for i, topics, makes, section, _, _, _ in rows:
        mine = [p for p in picks if p["id"] != i]
        used, subjects, found = set(), set(), []
        buckets = [
            [p for n in (2, 1) for p in mine if len(p["topics"] & low(topics)) == n], [p for p in mine if p["makes"] & low(makes)], [p for p in mine if section and p["section"] == section], [p for p in mine if p["topics"] & low(interests)],
            [p for p in mine if p["section"] in sh.ADJACENT.get(section, [])], [p for p in mine if not make or make.lower() not in p["makes"] or p["tier"] == "none" or not p["feed"]],
        ]
        for why, bucket in zip(sh.REASONS, buckets):
            found += [(p["id"], why) for p in greedy(bucket, 6 - len(found), used, subjects)]
        want += [(i, n + 1, pick, why) for n, (pick, why) in enumerate(found)] if len(found) > 1 else []
    got = sh.keep_exploring(frame, pool, list(interests), make, size=20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert sh.keep_exploring(frame, pool.filter("false")).count() == 0
