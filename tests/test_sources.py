"""Stored feeds, sitemaps and lists; character references of any plane."""

import json

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.sources import readers as rd


def test_references_of_any_plane_in_the_order_named_hex_decimal_ampersand(spark):
    cells = ["&#128512; &#x1F600; &#X1f600;", "&#65;&#x42;&#0067;", "&amp;lt; &amp;#65;", "&#x26;#65; &#38;amp;", "&#x110000; &#xD800; &#0;", "no &#; &#x; & &amp", "&NBSP;|&lt;&GT;&quot;&apos;&#39;", "x\u00e9&#233;&#x20AC;", None, ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(tx.decode_entities(F.col("c"))).collect()]
    assert got == ["😀 😀 😀", "ABC", "&lt; &#65;", "A &", "� � �", "no &#; &#x; & &amp", " |<>\"''", "xéé€", None, ""]
    # hexadecimal references come first: one that stands for & makes a decimal one, and a decimal one makes a named ampersand
    points = [n for n in [*range(9, 200), 0x2014, 0xFFFD, 0x10000, 0x1F697, 0x10FFFF] if n != 38]
    every = "".join(f"&#{n};&#x{n:x};" for n in points)
    assert spark.range(1).select(tx.decode_entities(F.lit(every))).first()[0] == "".join(chr(n) * 2 for n in points)


def test_stored_feeds_entry_by_entry(spark, tmp_path):
    item = lambda n: f'<item><title>A &amp;amp; {n}</title><link>https://x.example.com/{n}?utm_id=1</link><description><![CDATA[<p>Hi <img src="https://x.example.com/i.jpg"></p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>'
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><rss><channel><title>Feed</title>' + "".join(item(n) for n in range(3000)) + "<item><title></title><link>https://x.example.com/b</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<html><item><title>No</title><link>https://x.example.com/b</link></item></html>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        items, errors = rd.read_feeds(spark, str(tmp_path), 5)
        rows = items.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert items.rdd.getNumPartitions() > 1 and len(rows) == 3000
    assert {r.canonical_url for r in rows} == {f"https://x.example.com/{n}" for n in range(3000)}
    first = next(r for r in rows if r.canonical_url.endswith("/7"))
    assert (first.title, first.excerpt, first.image_urls, first.published_at) == ("A & 7", "Hi", ["https://x.example.com/i.jpg"], 1_704_103_200_000)
    assert [r.file.rsplit("/", 1)[1] for r in errors.collect()] == ["b.xml"]
    (tmp_path / "atom").mkdir()
    (tmp_path / "atom" / "c.xml").write_text('<feed><entry><title>T</title><link rel="alternate" href="https://y.example.com/1"/><id>u1</id><updated>2024-01-01T10:00:00Z</updated><author><name>N</name></author></entry></feed>')
    entry = rd.read_feeds(spark, str(tmp_path / "atom"), 5, entry="entry")[0].first()
    assert (entry.title, entry.canonical_url, entry.guid, entry.author, entry.published_at) == ("T", "https://y.example.com/1", "u1", "N", 1_704_103_200_000)
    body = (tmp_path / "a.xml").read_text()
    whole, none = rd.parse_feeds(spark.createDataFrame([("a", body), ("b", "<html></html>"), ("c", None)], "source_id string, body string"), 5)
    assert sorted(map(str, whole.drop("source_id").collect())) == sorted(map(str, items.drop("file").collect())) and none.count() == 2


def test_a_feed_entry_is_decoded_once_for_each_field(spark):
    """However often a field is used later, the plan holds its expression once: filters and summaries make no copies."""
    entry = "<title>A &amp;amp; B</title><link>https://x.example.com/1?utm_id=1</link><guid>7</guid><description>" + "word &amp;lt;b&amp;gt; " * 90 + "</description>"
    items = rd.feed_entries(spark.createDataFrame([("s", entry), ("s", "<title></title><link>https://x/1</link>")], "source_id string, block string").repartition(1), 5)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<description") == plan.count("<title") == 1 and plan.count("<link(?:") == 1
    row = items.collect()
    assert [(r.title, r.canonical_url, r.guid, r.published_at) for r in row] == [("A & B", "https://x.example.com/1", "7", 5)]
    assert row[0].excerpt == " ".join(["word"] * 64) + "…"


def test_stored_sitemaps(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset>" + "".join(f"<url><loc>\n https://a/{n % 900}?x=1&amp;y </loc><lastmod>2024</lastmod></url>" for n in range(1000)) + "</urlset>")
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>")
    found = {(r.url, r.is_index) for r in rd.read_sitemaps(spark, str(tmp_path)).collect()}
    assert found == {(f"https://a/{n}?x=1&y", False) for n in range(900)} | {("https://a/s.xml", True)}


def test_stored_lists_equal_parsed_ones(spark, tmp_path):
    posts = [{"id": n, "link": f"https://x.example.com/news/{n}", "title": {"rendered": f"T &#8211; {n}"}, "excerpt": {"rendered": "<p>E</p>"}, "date_gmt": "2024-01-01T10:00:00", "categories": [n % 2] if n % 3 else None} for n in range(6)] + [{"id": 9, "link": "https://other/1"}]
    videos = [{"id": "v1", "live": "none", "title": "V", "thumbnails": {"high": {"url": "h"}, "medium": {"url": "m"}}}, {"id": "", "title": "x"}, {"id": "v2", "live": "upcoming"}]
    for name, rows in (("posts", posts), ("videos", videos)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(rows, indent=1))
    bodies = lambda rows: spark.createDataFrame([("s", json.dumps(rows))], "source_id string, body string")
    read = rd.read_json_posts(spark, str(tmp_path / "posts"), "x.example.com", "/news", 1)
    want = rd.parse_json_posts(bodies(posts), "x.example.com", "/news", 1)
    plain = lambda df: sorted(map(str, df.drop("source_id").collect()))
    assert plain(read) == plain(want) and [r.title for r in want.orderBy("title").collect()] == ["T – 0", "T – 1", "T – 3", "T – 5"]
    assert plain(rd.read_video_items(spark, str(tmp_path / "videos"))) == plain(rd.parse_video_items(bodies(videos))) == [str(rd.parse_video_items(bodies(videos)).drop("source_id").first())]
