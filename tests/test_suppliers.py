"""Supplier rules and explanation lines against the same rules applied to one row at a time."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import profiles as pf
from millrace.operators import fitment as fi
from millrace.operators import suppliers as su

RULES = su.Supplier(
    categories=[("kit", "service", None), ("pad|disc", "brakes", "stopping"), ("silencer", "exhaust", None)],
    attributes=[
        [su.Gives({"class": "critical"}, ("brakes",))],
        [su.Gives({"look": "sport", "class": "caution"}, ("brakes", "exhaust"), "race|slotted"), su.Gives({"look": "stock"}, ("brakes",))],
        [su.Gives({"look": "other"})],
    ],
    rejects=[su.Reject("other cars", "saloon"), su.Reject("no marque", lacks="elan")],
    fitment={"make": "Lotus", "model": "Elan", "year_to": 1999}, needs=("elan",), engine=("1[.]6", "1.6", "1[.]8"), size=r"ø\s*(\d+)|(\d{3})\s*mm",
)
WORDS = ["kit", "pad", "disc", "silencer", "race", "Slotted", "saloon", "Elan", "1.6", "1.8", "89-94", "1985 – 1991", "89/1990", "ø 30", "280 mm", "7 mm", "", "x"]


def by_hand(name, text, own, url):
    low = lambda *parts: " ".join(p or "" for p in parts).lower()
    at = low(own, name, url)
    category, below = next(((c, own if s is None else s) for p, c, s in RULES.categories if re.search(p, at)), ("uncategorised", own))
    said, found = low(name, text, own), {}
    for group in RULES.attributes:
        for rule in group:
            if (not rule.categories or category in rule.categories) and re.search(rule.pattern, said):
                found = rule.values | found
                break
    if size := re.search(RULES.size, said):
        found = {"spec": (size[1] or size[2]) + "mm"} | found
    years = re.search(r"(19\d\d|8\d|9\d)\s*[-–/]\s*(19\d\d|8\d|9\d)", said)
    full = lambda y: int(y) + 1900 if int(y) < 100 else int(y)
    fits = ("Lotus", full(years[1]) if years else None, 1999, "1.6" if "1.6" in said and "1.8" not in said else None) if "elan" in said else None
    everything = low(name, text, own, url)
    return category, below, found, fits, "other cars" if "saloon" in everything else "no marque" if "elan" not in everything else None


def test_parts_inferred_by_rules(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))])
    rows = [(i, some(), some(), some(), some(), "clash") for i in range(400)] + [(400, "Pad " * 20_000 + "race", "elan 89-94", None, "", "clash")]
    pages = spark.createDataFrame(rows, "id long, name string, description string, source_category string, url string, category string")
    got = {r.id: r for r in su.infer_parts(pages, RULES).collect()}
    for i, name, text, own, url, _ in rows:
        r = got[i]
        assert (r.category, r.subcategory, r.attributes, r.fitment and (r.fitment.make, r.fitment.year_from, r.fitment.year_to, r.fitment.engine), r.rejected) == by_hand(name, text, own, url), rows[i]
    assert su.infer_parts(pages.filter("false"), RULES).count() == 0


def test_pages_are_chosen_by_quota_then_score(spark):
    rng = random.Random(4)
    rules = su.Selection([("/a", "a"), ("/b", "b")], [("x", 5), ("y", 3)], ("k", "m"), {"a": 3, "b": 2}, 9, allow=("p",), deny=("z",))
    for _ in range(6):
        urls = ["/".join(rng.choices("abxykmpz", k=rng.randint(1, 6))) for _ in range(60)]
        urls = ["/" + u for u in urls] + [None, ""]
        want = []
        for u in {u for u in urls if u and "p" in u and "z" not in u and ("k" in u or "m" in u)}:
            bucket = "a" if "/a" in u else "b" if "/b" in u else "other"
            want.append((-(5 * ("x" in u) + 3 * ("y" in u) + 4 * ("k" in u) + 4 * ("m" in u) + 10 * (bucket != "other")), u, bucket))
        picked, used = [], {}
        for s, u, b in sorted(want):
            if used.get(b, 0) < {"a": 3, "b": 2}.get(b, 1):
                picked, used[b] = [*picked, u], used.get(b, 0) + 1
        picked = (picked + [u for _, u, _ in sorted(want) if u not in picked])[:9]
        got = su.select_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).orderBy("place").collect()
        assert [r.url for r in got] == picked


def line_by_hand(signals, tier, lane, cars, why):
    said = lambda pattern: next((w for w in why if re.search(pattern, w.lower())), None)
    label = next((x for x in (" ".join(p.strip() for p in c if p and p.strip()) for c in cars) if x), None)
    make = (cars[0][0] or "").strip() if cars else ""
    kinds = {}
    for kind, detail in signals:
        kinds.setdefault(kind, detail)
    car = next((d for k, d in signals if k.startswith("vehicle.")), None)
    if car is not None and tier != "none":
        if car.split(" ")[0].lower() == "mentioned":
            return (said("mentions your") or f"Mentions your {label}") if label else None
        if tier == "category":
            return (said("in the world of your") or f"In the world of your {label}") if label else None
        if tier == "make":
            return (said("relevant to") or f"Relevant to {make} owners") if make else None
        return (said("because you drive") or f"Because you drive a {label}") if label else None
    if "interest" in kinds and lane in ("vehicle", "interests", "discover"):
        d = kinds["interest"]
        return said("because you (follow|like)") or (f"Because you {'like' if ' + ' in d else 'follow'} {d}" if d else None)
    if kinds.get("culture") and lane == "discover":
        return f"From the world of {kinds['culture']}"
    if "location" in kinds:
        d = kinds["location"]
        return (said("because it's in") or f"Because it's in {d}") if d and d != "location" else "Near you"
    return "Worth a look" if lane == "discover" and "editorial.quality" in kinds else None


def test_explanation_lines(spark):
    rng = random.Random(5)
    kinds = ["vehicle.make", "vehicle.model", "interest", "culture", "location", "editorial.quality", "freshness"]
    details = {"vehicle.make": ["about make match", "Mentioned make match"], "vehicle.model": ["mentioned x", ""], "interest": ["Rally", "Rally + Tuning", ""], "culture": ["Rally", ""], "location": ["London", "location", ""]}
    lines = ["It mentions your car", "In the world of your make", "Relevant to all", "Because you drive this", "Because you like it", "Because it's in town"]
    names = lambda: tuple(rng.choice([None, "", " Lotus ", "Elan"]) for _ in range(4))
    rows = []
    for i in range(600):
        picked = rng.sample(kinds, rng.randint(0, 4))
        rows.append((i, [(k, rng.choice(details.get(k, ["d"]))) for k in picked], rng.choice(["variant", "vehicle", "model", "generation", "make", "category", "none"]), rng.choice(["vehicle", "interests", "discover", "carousel", "none"]), [names() for _ in range(rng.randint(0, 2))], rng.sample(lines, rng.choice([0, 0, 2])), rng.randint(-1, 1)))
    df = spark.createDataFrame(rows, "i long, signals array<struct<kind:string,detail:string>>, tier string, lane string, cars array<struct<make:string,model:string,generation:string,variant:string>>, why array<string>, score int")
    c = F.col
    got = {r.i: r for r in df.select("i", pf.explain_line(c("signals"), c("tier"), c("lane"), c("cars"), c("why")).alias("line"), pf.relevance_confidence(c("signals"), c("tier"), c("score")).alias("sure")).collect()}
    for i, signals, tier, lane, cars, why, score in rows:
        assert got[i].line == line_by_hand(signals, tier, lane, cars, why), rows[i]
        has = {k for k, _ in signals}
        sure = "high" if tier in ("variant", "vehicle") else "medium" if tier in ("model", "generation") or "interest" in has else "low" if tier == "make" or "culture" in has or score > 0 and any(k.startswith("editorial") for k in has) else "none"
        assert got[i].sure == sure


def test_reasons_of_a_fitment(spark):
    cases = [("exact", "manufacturer", 1990, "Lotus", "Elan", None, "S2"), ("exact", None, None, "Lotus", "Elan", "M100", None), ("generation", "supplier", 1990, "Lotus", "Elan", "M100", None), ("generation", None, None, "Lotus", None, None, None), ("model", None, None, "Lotus", "Elan", None, None), ("unknown", "manufacturer", 1, "a", "b", "c", "d"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, confidence string, source string, year int, make string, model string, generation string, variant string")
    reasons = fi.fitment_reasons(F.col("confidence"), F.col("source"), {n: F.col(n) for n in ("year", "make", "model", "generation", "variant")})
    got = {r.i: ([(x.code, x.label) for x in r.shown], r.n) for r in df.select("i", fi.public_reasons(reasons).alias("shown"), fi.strong_reasons(reasons).alias("n")).collect()}
    maker = ("authoritative_fitment", "Fitment from the manufacturer")
    assert [got[i] for i in range(7)] == [
        ([("fits_vehicle", "Fits your 1990 Lotus Elan S2"), maker], 2), ([("fits_vehicle", "Fits your Lotus Elan")], 1), ([("fits_generation", "Fits the M100 generation")], 1), ([("fits_generation", "Fits the  generation")], 1),
        ([("fitment_model_only", "Listed for Lotus Elan — generation not confirmed")], 0), ([maker], 1), ([], 0),
    ]
    mixed = F.array(fi.reason("spec_match", F.lit("b"), 30), fi.reason(fi.HIDDEN, F.lit("h"), 5), fi.reason("other", F.lit("c"), 30), fi.reason("correct_component", F.lit("a"), 1, F.lit("why")))
    shown, n = spark.range(1).select(fi.public_reasons(mixed), fi.strong_reasons(mixed)).first()
    assert [tuple(x) for x in shown] == [("correct_component", "a", "why"), ("spec_match", "b", None), ("other", "c", None)] and n == 2


def test_profile_catalog(spark):
    schema = "kind string, name string, make string, model string"
    known = spark.createDataFrame([("make", "Lotus", None, None), ("model", "Elan", "Lotus", None), ("variant", "S2", "lotus", "ELAN"), ("generation", "M100", "Lotus", "Elan")], schema)
    rows = [("make", " LOTUS ", None, None), ("model", "elan", "LOTUS", None), ("generation", "m100", "lotus", "elan"), ("generation", "Mk  1", "lotus", "Europa"), ("variant", "x", "Alfa", None), ("model", "<b>", "Alfa", None), ("model", "y" * 81, "Alfa", None), ("make", "", None, None), (None, None, None, None), ("variant", "z", None, "Elan")]
    live = spark.createDataFrame(rows * 2, schema)
    got = {r.make: [(m.model, m.generations, m.variants) for m in r.models] for r in fi.profile_catalog(known, live).collect()}
    assert got == {"Lotus": [("Elan", ["M100"], ["S2"]), ("Europa", ["Mk 1"], [])], "Alfa": []}
    assert fi.profile_catalog(known.filter("false"), live.filter("false")).count() == 0
