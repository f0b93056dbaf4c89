from pyspark.sql import functions as F

from millrace.functions import profiles as pf

LABELS, ALIASES = ["Rally", "Road Trips"], {"rallying": "Rally"}


def test_profile_round_trip(spark):
    p = pf.parse_profile(F.col("q"), LABELS, ALIASES, {"p1": {"makes": ["Lotus"]}})
    rows = spark.createDataFrame([("?make=Alfa&make=Benz,Alfa&interest=rallying&interest=Nope",), ("preset=p1&interest=Road%20Trips",), ("make=%3Cx%3E",), (None,)], "q string")
    got = [tuple(r) for r in rows.select(pf.profile_key(p), pf.explicit_cohort(p)).collect()]
    assert got == [("make=alfa,benz&interest=rally", "Alfa"), ("make=lotus&interest=road trips", "Lotus"), ("", None), ("", None)]


def test_bucketed_selection_and_tags(spark):
    rows = spark.createDataFrame([("a", "u1", 9), ("a", "u2", 8), ("a", "u3", 7), ("b", "u4", 1), ("c", "u5", 5)], "bucket string, url string, score int")
    assert [r.url for r in pf.select_by_bucket(rows, {"a": 1, "b": 1}, 3).collect()] == ["u1", "u4", "u2"]
    assert spark.range(1).select(pf.card_tag(F.array(F.lit("News"), F.lit("Design")), F.lit("cars")), pf.stored_event_name(F.lit("story_save"))).first()[:] == ("Design", "save")
