"""Operators that SQL does not express, on small hand-made rows."""

import random
import tempfile

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls as ur
from millrace.operators import classify as cl
from millrace.operators import engagement as en
from millrace.operators import fitment as fi
from millrace.operators import gazetteer as gz
from millrace.operators import ranking as rk
from millrace.operators import related as rel
from millrace.operators import shaping as sh
from millrace.sources import readers as rd
from millrace.sources import sinks
from millrace.streaming import jobs

EVENT = "id long, event string, article_id long, visitor_key string, cohort string, created_at long, day_utc string, surface string, detail string"
DAY = 86_400_000
T0 = 1_700_000_000_000 // DAY * DAY


def events(spark, rows):
    return spark.createDataFrame([(i, e, a, v, None, T0 + d * DAY + i, None, "home", None) for i, (e, a, v, d) in enumerate(rows)], EVENT)


def test_daily_dedup_and_windows(spark):
    e = events(spark, [("impression", 1, "A", 0), ("impression", 1, "A", 0), ("story_open", 1, "A", 0), ("impression", 1, "A", 1), ("impression", 1, "B", 1), ("save", 1, "B", 1)])
    touches, first = en.daily_touches(e), en.visitor_first(e)
    by_day = {r.day: r for r in en.daily_articles(touches, first).collect()}
    d0, d1 = sorted(by_day)
    assert (by_day[d1].impression_uniques, by_day[d1].save_uniques, by_day[d1].returning_uniques) == (2, 1, 1) and by_day[d0].returning_uniques == 0
    w = en.window_articles(touches, first, d0, d1).first()
    assert (w.impression_uniques, w.open_uniques) == (2, 1)
    assert en.retention_cutoff("2026-10-24") == "2026-07-26"
    assert en.desk_window(99, "2026-10-24") == {"start": "2026-10-18", "end": "2026-10-24", "previous_start": "2026-10-11", "previous_end": "2026-10-17"}


def test_trending_gate(spark):
    now = T0 + 3 * DAY
    assert en.trending(events(spark, [("interested", 1, "A", 2), ("save", 1, "B", 2)]), now).first().mode == "discover"
    busy = events(spark, [("interested", i % 3 + 1, f"v{i}", 2) for i in range(24)])
    assert en.trending(busy, now).first().mode == "trending" and en.trending(events(spark, [("story_open", 1, f"v{i}", 2) for i in range(20)]), now).first().positive_events == 0


def test_text_and_urls(spark):
    rows = [("a &amp;lt; b &#65;&#x42;&nbsp;c", "https://www.Example.com:443/a/?utm_source=x&b=1#f"), ("<p>x</p><script>y</script> z", "not a url"), (None, None)]
    got = spark.createDataFrame(rows, "t string, u string").select(tx.strip_html(F.col("t")), ur.canonicalize_url(F.col("u")), ur.host(F.col("u")), ur.is_unusable_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("a &lt; b AB c", "https://www.example.com/a/?b=1", "example.com", False), ("x z", None, None, True), ("", None, None, True)]
    ids = spark.createDataFrame([("https://youtu.be/abcdefghijk",), ("https://www.youtube.com/watch?x=1&v=abcdefghijk",), ("https://www.youtube.com/shorts/abcdefghijk",), ("https://x.com/v",)], "u string").select(ur.video_id(F.col("u"))).collect()
    assert [r[0] for r in ids] == ["abcdefghijk"] * 3 + [None]
    sure = spark.createDataFrame([("Ein Bericht", "der und die das mit"), ("A story", "of the road"), ("", ""), ("车", "")], "t string, e string").select(tx.is_english(F.col("t"), F.col("e"))).collect()
    assert [r[0] for r in sure] == [False, True, True, False]


def test_entities_and_relevance(spark):
    gazetteer = [{"make": "Porsche", "make_aliases": [], "models": [{"name": "911", "aliases": [], "generations": ["964", "996"], "variants": ["Carrera"], "generation_implies_model": True}]}, {"make": "Lotus", "make_aliases": [], "models": [{"name": "Elise", "aliases": [], "generations": [], "variants": [], "generation_implies_model": False}]}]
    a = spark.createDataFrame([(1, "The 964 returns", "a carrera"), (2, "Back in 1996", "nothing"), (3, "Porsche 911 beats Lotus Elise", "")], "id long, title string, excerpt string")
    found = gz.extract_entities(a, gazetteer)
    names = {(r.article_id, r.kind, r.name, r.confidence) for r in found.collect()}
    assert {(1, "make", "Porsche", 80), (1, "model", "911", 82), (1, "generation", "964", 90), (1, "variant", "Carrera", 80)} <= names and not [n for n in names if n[0] == 2]
    relevance = {(r.article_id, r.name): r.relevance for r in cl.assign_relevance(found, a).collect()}
    assert relevance[3, "911"] == "about" and relevance[3, "Elise"] == "mentioned"
    assert spark.range(1).select(tx.entity_id(F.lit("generation"), F.lit("964"), F.lit("Porsche"), F.lit("911"))).first()[0] == "make:porsche:model:911:gen:964"


def test_related_bound_equals_all_pairs(spark):
    rng = random.Random(4)
    keys = {(rng.randrange(30), f"k{rng.randrange(4)}") for _ in range(80)}
    got = {(r.article_id, r.related_article_id) for r in rel.related_articles(spark.createDataFrame([(a, k, "same", 80) for a, k in keys], "article_id long, key string, reason string, score int"), spark.range(30)).collect()}
    want = set()
    for a in range(30):
        others = sorted({b for x, k in keys if x == a for b, j in keys if j == k and b != a})
        want |= {(a, b) for b in others[:5]}
    assert got == want


def test_media_mix_cut_is_exact(spark):
    rng = random.Random(2)
    rows = [(f"l{k}", i + 1, i, rng.random() < 0.5) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "list_key string, position int, id long, is_video boolean")
    whole = {(r.list_key, r.position): r.id for r in sh.spread_media(df, ["list_key"], 60).collect()}
    assert {(r.list_key, r.position): r.id for r in sh.spread_media(df, ["list_key"], 15).collect()} == {k: v for k, v in whole.items() if k[1] <= 15}


def test_personal_tiers(spark):
    none = "cast(array() as array<string>)"
    base = spark.range(3).selectExpr("id", "array('Porsche') makes", "case when id < 2 then array('911') else cast(array() as array<string>) end models", "case when id = 0 then array('964') else cast(array() as array<string>) end generations", f"{none} variants", f"{none} interests", f"{none} categories", f"{none} scenes", f"{none} locations", f"{none} geography", f"{none} content_types", "'cars' primary_category", "'Good' source_relevance", "false desk_pick", "'x' excerpt", "0L published_at", "cast(null as array<struct<kind:string,name:string,make:string,model:string,relevance:string>>) entity_hits", "array(named_struct('make','Porsche','model','911','generation','964','variant',cast(null as string))) vehicles", f"{none} user_interests", "cast(null as string) user_location")
    mine = ["list_key", "vehicles", "user_interests", "user_location"]
    profile = base.limit(1).select(F.lit("p").alias("list_key"), *mine[1:])
    got = {r.id: (r.vehicle_tier, r.score) for r in rk.score_personal(base.drop(*mine), profile, T0).collect()}
    assert got == {0: ("vehicle", 110), 1: ("model", 95), 2: ("make", 48)}


def test_fitment_caps_and_ranges(spark):
    v = fi.canonical(spark.createDataFrame([(1, "Ferrari", "F 355", "F1", None, 1996, None), (2, "Ferrari", "355", None, None, None, None)], "vehicle_id long, make string, model string, generation string, variant string, year int, engine string"), model_aliases=spark.createDataFrame([("Ferrari", "F 355", "355")], "make string, alias string, model string"))
    f = fi.canonical(spark.createDataFrame([(1, 10, "ferrari", "355", None, None, 1994, 1999, None, "exact"), (2, 11, "Ferrari", None, None, None, 1989, 1990, None, "exact"), (3, 12, "Ferrari", None, None, None, None, None, None, "approximate")], "fitment_id long, product_id long, make string, model string, generation string, variant string, year_from int, year_to int, engine string, confidence string"))
    got = {(r.vehicle_id, r.product_id): r.confidence for r in fi.match_fitment(v, f).collect()}
    assert got == {(1, 10): "exact", (2, 10): "model", (2, 11): "model", (1, 12): "approximate", (2, 12): "approximate"}


def test_readers(spark):
    feed = '<?xml version="1.0"?><rss><channel><item><title>A &amp; B</title><link>https://x.example.com/a?utm_id=1</link><description><![CDATA[<p>Hi <img src="https://x.example.com/i.jpg"></p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title></title><link>https://x.example.com/b</link></item></channel></rss>'
    items, errors = rd.parse_feeds(spark.createDataFrame([("s1", feed), ("s2", "<html></html>")], "source_id string, body string"), 5)
    r = items.first()
    assert items.count() == 1 and (r.title, r.canonical_url, r.excerpt, r.published_at) == ("A & B", "https://x.example.com/a", "Hi", 1_704_103_200_000) and errors.first().source_id == "s2"
    assert rd.parse_sitemaps(spark.createDataFrame([("s", "<urlset><loc> https://a/1 </loc><loc>https://a/1</loc></urlset>")], "source_id string, body string")).collect()[0].url == "https://a/1"
    page = '<html><head><title>T</title><meta property="og:title" content="OG"><meta property="og:image" content="https://x/a.jpg"></head><a href="/p?utm_id=1">x</a><script type="application/ld+json">{"@type":"Product","name":"N","mpn":"M","offers":{"price":"3"}}</script><span itemprop="name">Pad</span><span itemprop="price" content="0">9</span></html>'
    pages = spark.createDataFrame([("https://x.example.com/q", page)], "url string, html string")
    assert rd.page_metadata(pages).first().title == "OG" and rd.page_links(pages).first().link == "https://x.example.com/p"
    assert tuple(rd.parse_jsonld_products(pages).first())[1:] == ("N", "M", 3.0) and rd.parse_itemprop_product(pages).first().price is None
    assert rd.best_image(rd.page_images(pages)).first().image == "https://x/a.jpg"


def test_day_replace_sink(spark):
    out = tempfile.mkdtemp(prefix="spark-")
    sinks.write_daily(spark.createDataFrame([("d1", 1), ("d2", 1)], "day string, n int"), out)
    sinks.write_daily(spark.createDataFrame([("d2", 2)], "day string, n int"), out)
    assert sorted((r.day, r.n) for r in spark.read.parquet(out).collect()) == [("d1", 1), ("d2", 2)]


def test_marks_and_rate_limit(spark):
    t = spark.createDataFrame([("v", 1, "interested", 1, 1), ("v", 1, "less", 2, 2), ("v", 1, "less", 3, 3), ("v", 2, "interested", 4, 4)], "visitor_key string, article_id long, polarity string, at long, id long")
    assert [tuple(r) for r in jobs.toggle_marks(t).collect()] == [("v", "interested", 2, 1)]
    e = spark.createDataFrame([(i, "v", "save" if i % 50 else "impression", T0 + i) for i in range(1, 61)], "id long, visitor_key string, event string, created_at long")
    got = {r.id: r.accepted for r in jobs.rate_limit(e).collect()}
    assert all(got[i] for i in range(1, 41)) and not got[41] and got[50] and not got[60]


def test_stream_equals_batch(spark):
    rows = [("impression", i % 3, f"v{i % 4}", i % 2) for i in range(40)] + [("save", 1, "v1", 0), ("save", 1, "v1", 0)]
    src, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    e = events(spark, rows).withColumn("day_utc", en.utc_day(F.col("created_at")))
    e.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = jobs.dedup_impressions(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/c").option("path", f"{out}/d").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.event, r.article_id, r.visitor_key, r.day_utc) for r in df.collect())
    assert key(spark.read.parquet(f"{out}/d")) == key(jobs.dedup_impressions(e))


def drained(stream, out, mode, **options):
    """Runs a stream over what is there, and gives what it wrote."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/c").trigger(availableNow=True)
    q = writer.foreachBatch(options["batch"]).start() if "batch" in options else writer.format("parquet").option("path", f"{out}/d").start()
    q.awaitTermination(120)


def test_folds_against_brute_force_and_streams(spark):
    rng = random.Random(6)
    toggles = [(f"v{rng.randrange(4)}", rng.randrange(12), rng.choice(["interested", "less"]), k // 3, k) for k in range(300)]
    want = {}
    for v, a, p, _, _ in toggles:
        lists = want.setdefault(v, {"interested": [], "less": []})
        had = a in lists[p]
        for marks in lists.values():
            if a in marks:
                marks.remove(a)
        if not had:
            lists[p] = [a, *lists[p]][:5]
    flat = sorted((v, p, a, i + 1) for v, lists in want.items() for p, marks in lists.items() for i, a in enumerate(marks))
    frame = spark.createDataFrame(toggles, "visitor_key string, article_id long, polarity string, at long, id long")
    assert sorted(map(tuple, jobs.toggle_marks(frame.repartition(3), 5).collect())) == flat
    src, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    frame.coalesce(1).write.mode("overwrite").parquet(src)
    seen = []
    drained(jobs.toggle_marks(spark.readStream.schema(frame.schema).parquet(src), 5), out, "update", batch=lambda df, _: seen.extend(map(tuple, df.collect())))
    assert sorted(seen) == flat

    attempts = [(k, f"v{k % 2}", "impression" if k % 9 == 0 else "save", T0 + k * 5_000) for k in range(400)]
    want = {}
    for v in ("v0", "v1"):
        kept = []
        for k, w, e, at in attempts:
            if w == v:
                kept = [x for x in kept if x >= at - 600_000]
                want[k] = e == "impression" or len(kept) < 40
                kept += [at] if want[k] else []
    frame = spark.createDataFrame(attempts, "id long, visitor_key string, event string, created_at long")
    assert {r.id: r.accepted for r in jobs.rate_limit(frame.repartition(5)).collect()} == want
    src, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    frame.coalesce(1).write.mode("overwrite").parquet(src)
    drained(jobs.rate_limit(spark.readStream.schema(frame.schema).parquet(src)), out, "append")
    assert {r.id: r.accepted for r in spark.read.parquet(f"{out}/d").collect()} == want


def test_rollup_of_a_day_in_two_batches(spark):
    out = tempfile.mkdtemp(prefix="spark-")
    dims = spark.createDataFrame([(1, "interest", "Rally")], "article_id long, dim_kind string, dim_value string")
    one = events(spark, [("impression", 1, "A", 0), ("save", 1, "A", 0)])
    two = events(spark, [("impression", 1, "B", 0), ("impression", 1, "A", 1)])
    run = jobs.rollup_batch(dims, out)
    for _ in range(2):
        run(one, 0)
        run(two, 1)
    read = lambda: {r.day: (r.impression_uniques, r.save_uniques, r.returning_uniques) for r in sinks.read_daily(spark, f"{out}/daily_articles").collect()}
    d0, d1 = sorted(read())
    assert read() == {d0: (2, 1, 0), d1: (1, 0, 1)} and len(d0) == 10
    run(events(spark, [("impression", 1, "B", -1)]), 2)  # late, and earlier than B's first day
    jobs.repair(spark, dims, out, "2000-01-01")
    late = {r.day: r.returning_uniques for r in sinks.read_daily(spark, f"{out}/daily_articles").collect()}
    assert late[d0] == 1 and len(late) == 3
    on_time, closed = jobs.late_rows(one.unionByName(two), d0)
    assert (on_time.count(), closed.count()) == (1, 3)


def test_two_sinks_of_validated_events(spark):
    out = tempfile.mkdtemp(prefix="spark-")
    raw = spark.createDataFrame([('{"event":"save","articleId":"4"}', "a", T0), ('{"event":"pageview"}', "b", T0), ("[]", "c", T0)], "payload string, visitor_key string, created_at long")
    for _ in range(2):
        jobs.quarantine_batch(out)(raw, 7)
    assert [(r.event, r.article_id) for r in spark.read.parquet(f"{out}/events").collect()] == [("save", 4)]
    assert {r.error for r in spark.read.parquet(f"{out}/rejected").collect()} == {"unknown_event", "not_an_object"}


def test_images_of_a_page(spark):
    page = '''<meta property="og:image" content="https://x/og.jpg"><script type="application/ld+json">{"image":["https://x/ld.jpg"]}</script>
    <img src="https://x/a.jpg" srcset="https://x/s.jpg 300w, https://x/l.jpg 1200w"><div style="background-image: url('https://x/bg.jpg')"></div><img src="https://x/og.jpg"><a href="sub/p.html">x</a><a href="mailto:q@x">m</a>'''
    pages = spark.createDataFrame([("https://x.example.com/dir/q.html", page)], "url string, html string")
    got = [(r.image, r.source_type) for r in rd.page_images(pages).orderBy("place").collect()]
    assert got == [("https://x/og.jpg", "og"), ("https://x/ld.jpg", "jsonld"), ("https://x/l.jpg", "article"), ("https://x/a.jpg", "article"), ("https://x/bg.jpg", "article")]
    assert [r.link for r in rd.page_links(pages).collect()] == ["https://x.example.com/dir/sub/p.html"]


def test_metadata_merge_and_rail_openers(spark):
    from millrace.operators import ingest as ing

    got = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}'), ("broken", '{"b":"3"}'), (None, None)], "o string, n string").select(ing.merge_metadata(F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in got] == ['{"a":"1","b":"3"}', '{"b":"3"}', "{}"]
    rails = spark.createDataFrame([("p", 1, 1, 10, "A"), ("p", 1, 2, 11, "B"), ("p", 2, 1, 11, "B"), ("p", 2, 2, 12, "A"), ("p", 3, 1, 10, "A")], "page string, rail int, position int, id long, publication string").withColumns({c: F.lit(False) for c in ("this_week", "last_week", "desk_pick")})
    opened = spark.createDataFrame([("p", 10, "A")], "page string, id long, publication string")
    assert sorted((r.rail, r.id) for r in sh.rail_openers(rails, "page", opened).collect()) == [(1, 11), (2, 12)]

