"""Readers of publisher and supplier material: CSV catalogues, feeds, sitemaps, JSON lists, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls as ur
from millrace.storage import sized_broadcast, written


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE")
    rows = rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])
    return rows.na.fill("").filter(F.concat_ws("", *[F.col(c) for c in rows.columns]) != "")


def read_sources(spark: SparkSession, path: str, enabled_order: list[str] = ()) -> DataFrame:
    """The source catalogue: yes/true to booleans, an empty rss_url to null; priority by place in enabled_order, else 80."""
    rows = _csv(spark, path)
    yes = lambda c: F.lower(F.trim(c)).isin("yes", "true", "1")
    place = F.array_position(F.array(*[F.lit(x) for x in enabled_order]).cast("array<string>"), F.col("id"))
    return rows.withColumns({"rss_url": F.nullif(F.trim("rss_url"), F.lit("")), "enabled": yes(F.col("enabled")), "allow_excerpt": yes(F.col("allow_excerpt")), "allow_image": yes(F.col("allow_image")), "priority": F.when(place > 0, place).otherwise(80).cast("int")})


AVAILABILITY = ["in_stock", "out_of_stock", "preorder", "unknown"]
CONFIDENCE = ["exact", "generation", "model", "approximate", "unknown"]


def read_products(spark: SparkSession, path: str, categories: dict[str, str]) -> dict[str, DataFrame]:
    """products, attributes, fitments and errors of a supplier's CSV. Rows without a product_name are errors."""
    rows = _csv(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    good, bad = rows.filter(F.trim("product_name") != ""), rows.filter(F.trim("product_name") == "")
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    coerced = lambda c, allowed: F.when(F.lower(F.trim(c)).isin(*allowed), F.lower(F.trim(c))).otherwise("unknown")
    good = good.withColumns({"category": F.coalesce(F.try_element_at(table, F.lower(F.trim("category"))), F.lit("uncategorised")), "availability": coerced("availability", AVAILABILITY), "price": F.col("price").try_cast("double")})
    pairs = F.filter(F.transform(F.split("attributes", ";"), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("attribute"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("value"), p.contains("=").alias("ok"))), lambda p: p["ok"] & (p["attribute"] != ""))
    whole = lambda c: F.nullif(F.trim(c), F.lit(""))
    return {
        "products": good.drop("attributes", "make", "model", "generation", "year_from", "year_to", "fitment_confidence"),
        "attributes": good.select("product_id", F.explode(pairs).alias("p")).select("product_id", "p.attribute", "p.value"),
        "fitments": good.filter(F.trim("make") != "").select("product_id", F.trim("make").alias("make"), whole("model").alias("model"), whole("generation").alias("generation"), F.col("year_from").try_cast("int").alias("year_from"), F.col("year_to").try_cast("int").alias("year_to"), coerced("fitment_confidence", CONFIDENCE).alias("confidence")),
        "errors": bad.select("row_no", F.lit("product_name is missing").alias("error")),
    }


# -- feeds and sitemaps -------------------------------------------------------------------------------------------------
def _field(block: F.Column, *names: str) -> F.Column:
    """The text of the first of these elements that is not empty: without CDATA marks, entities decoded."""
    def one(name: str) -> F.Column:
        inner = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        return tx.once(F.trim(tx.decode_entities(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))), lambda c: F.nullif(c, F.lit("")))

    return F.coalesce(*[one(name) for name in names], F.lit(""))


def _plain(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(tx.decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), r"\s+", " "))


_FEED = r"(?i)<(?:rss|feed|rdf:RDF)[\s>]"
_ENTRY_IMAGES = [r"<media:(?:content|thumbnail)[^>]*?url=[\"']([^\"']+)", r"<enclosure[^>]*?url=[\"']([^\"']+)", r"<itunes:image[^>]*?href=[\"']([^\"']+)", r"<link(?=[^>]*?rel=[\"']enclosure)[^>]*?href=[\"']([^\"']+)"]


def feed_entries(entries: DataFrame, now_ms: int, block: str = "block") -> DataFrame:
    """Items from one RSS or Atom entry a row: title, canonical_url, url, guid, author, excerpt, image_urls, published_at (without a date: now), method.

    Entries without title or canonical URL go; other columns stay.
    """
    b = F.col(block)
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    href = F.nullif(F.regexp_extract(b, r"<link[^>]*?href=[\"']([^\"']+)", 1), F.lit(""))
    images = F.array_distinct(F.concat(*[every(b, p) for p in _ENTRY_IMAGES], every(tx.decode_entities(b), r"<img[^>]*?src=[\"']([^\"']+)")))
    found = ["title", "url", "guid", "author", "excerpt", "image_urls", "method", "canonical_url", "published_at"]
    others = [F.col(f"`{c}`") for c in entries.columns if c not in [*found, block]]
    # what is filtered by is made by generators, over which filters are not pushed with a copy of the expression for each use
    rows = entries.select(*others, b, F.inline(F.array(F.struct(_plain(_field(b, "title")).alias("title"), F.coalesce(F.nullif(_field(b, "link"), F.lit("")), href, F.lit("")).alias("url")))))
    rows = rows.select("*", F.explode(F.array(ur.canonicalize_url(F.col("url")))).alias("canonical_url")).filter("title != '' and canonical_url is not null")
    rows = rows.withColumns({"guid": _field(b, "guid", "id"), "author": _plain(_field(b, "dc:creator", "author", "name")), "image_urls": images, "method": F.lit("rss"), "_published": _field(b, "pubDate", "published", "updated", "dc:date")})
    at = F.coalesce(F.col("_published").try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace("_published", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    rows = rows.withColumns({"excerpt": tx.cap_summary(_plain(_field(b, "description", "summary", "content:encoded", "content"))), "published_at": F.coalesce(F.unix_millis(at), F.lit(now_ms))})
    return rows.select(*others, *found)


def parse_feeds(bodies: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of feed documents (source_id, body) that are small enough for a row each; see read_feeds() for stored ones."""
    good = F.coalesce(F.substring("body", 1, 4000).rlike(_FEED), F.lit(False))
    entries = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = bodies.filter(good).select("source_id", F.explode(entries).alias("block"))
    return feed_entries(rows, now_ms), bodies.filter(~good).select("source_id", F.lit("not a feed").alias("error"))


def _cut(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Stored files in pieces that end with a tag: value, file, and the columns of partition folders. Large files are read in splits, side by side."""
    rows = spark.read.option("lineSep", end).option("recursiveFileLookup", "false").text(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def read_feeds(spark: SparkSession, path: str, now_ms: int, entry: str = "item", key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(items, errors) of stored feeds, entry by entry: no feed is held as a whole. entry: item (RSS) or entry (Atom).

    key names a feed: its file, or the column of a partition folder. Feeds in which no piece names a feed element are errors.
    """
    pieces = _cut(spark, path, f"</{entry}>").withColumn(key, F.col(key).cast("string"))
    bad = pieces.groupBy(key).agg(F.max(F.col("value").rlike(_FEED)).alias("good")).filter("NOT good").select(key, F.lit("not a feed").alias("error"))
    bad = written(bad, "no_feeds")
    block = F.regexp_extract("value", rf"(?is)<{entry}(?:\s[^>]*)?>(.*)$", 1)
    entries = pieces.select(key, F.explode(F.array(block)).alias("block")).filter("block != ''").join(sized_broadcast(bad.select(key)), key, "left_anti")
    return feed_entries(entries, now_ms), bad


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """(source_id, url, is_index) of all distinct <loc> of each document that is small enough for a row; see read_sitemaps()."""
    locs = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), tx.decode_entities))
    return bodies.select("source_id", F.explode(locs).alias("url"), F.col("body").rlike("(?i)<sitemapindex").alias("is_index"))


def read_sitemaps(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """(key, url, is_index) of the distinct <loc> of stored sitemaps, address by address: no sitemap is held as a whole."""
    pieces = _cut(spark, path, "</loc>").withColumn(key, F.col(key).cast("string"))
    index = pieces.filter(F.col("value").rlike("(?i)<sitemapindex")).select(key).distinct().withColumn("is_index", F.lit(True))
    urls = pieces.filter(F.col("value").rlike("(?i)<loc>")).select(key, tx.decode_entities(F.regexp_extract("value", r"(?is)<loc>\s*(.*?)\s*$", 1)).alias("url")).distinct()
    return urls.join(sized_broadcast(index), key, "left").na.fill({"is_index": False})


# -- JSON lists and pages -----------------------------------------------------------------------------------------------
POST = "array<struct<id:long,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,date_gmt:string,categories:array<long>>>"


def parse_json_posts(bodies: DataFrame, host: str, prefix: str = "/", category: int | None = None) -> DataFrame:
    """Posts of JSON lists (source_id, body): of the host, under the prefix and, where they name categories, of the given one."""
    return json_posts(bodies.select("source_id", F.explode(F.from_json("body", POST)).alias("p")), host, prefix, category)


def read_json_posts(spark: SparkSession, path: str, host: str, prefix: str = "/", category: int | None = None) -> DataFrame:
    """The same of stored lists, which are parsed post by post."""
    rows = _elements(spark, path, POST)
    return json_posts(rows.select("source_id", F.struct(*[c for c in rows.columns if c != "source_id"]).alias("p")), host, prefix, category)


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A row for each element of the JSON arrays of files; source_id is the file."""
    schema = kind.removeprefix("array<struct<").removesuffix(">>")
    fields = spark.range(0).select(F.from_json(F.lit("{}"), f"struct<{schema}>").alias("x")).select("x.*").schema
    return spark.read.schema(fields).json(path, multiLine=True).withColumn("source_id", F.col("_metadata.file_path"))


def json_posts(rows: DataFrame, host: str, prefix: str = "/", category: int | None = None) -> DataFrame:
    """From (source_id, p), a post a row."""
    rule = (ur.host(F.col("p.link")) == host) & ur.path(F.col("p.link")).startswith(prefix)
    if category is not None:
        rule &= F.col("p.categories").isNull() | F.array_contains("p.categories", category)
    return rows.filter(rule).select("source_id", tx.strip_html(F.col("p.title.rendered")).alias("title"), ur.canonicalize_url(F.col("p.link")).alias("canonical_url"), tx.cap_summary(F.col("p.excerpt.rendered")).alias("excerpt"), F.unix_millis(F.col("p.date_gmt").try_cast("timestamp")).alias("published_at"))


_THUMB = "struct<url:string>"
VIDEO = f"array<struct<id:string,live:string,title:string,thumbnails:struct<maxres:{_THUMB},standard:{_THUMB},high:{_THUMB},medium:{_THUMB}>>>"


def parse_video_items(bodies: DataFrame) -> DataFrame:
    """Videos of JSON listings (source_id, body), without upcoming ones and ones without id; the largest thumbnail."""
    return video_items(bodies.select("source_id", F.explode(F.from_json("body", VIDEO)).alias("v")))


def read_video_items(spark: SparkSession, path: str) -> DataFrame:
    """The same of stored listings, which are parsed video by video."""
    rows = _elements(spark, path, VIDEO)
    return video_items(rows.select("source_id", F.struct(*[c for c in rows.columns if c != "source_id"]).alias("v")))


def video_items(rows: DataFrame) -> DataFrame:
    """From (source_id, v), a video a row."""
    rows = rows.filter("coalesce(v.id, '') != '' and coalesce(v.live, '') != 'upcoming'")
    return rows.select("source_id", "v.title", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("v.id")).alias("canonical_url"), F.coalesce(*[F.col(f"v.thumbnails.{k}.url") for k in ("maxres", "standard", "high", "medium")]).alias("image_url"))


def parse_jsonld_products(pages: DataFrame) -> DataFrame:
    """(url, name, mpn, price) of each page's JSON-LD products with a name and an mpn, one per mpn."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    p = pages.select("url", F.explode(blocks).alias("b")).select("url", F.from_json("b", "struct<`@type`:string,name:string,mpn:string,offers:struct<price:string>>").alias("p"))
    return p.filter("p.`@type` = 'Product' and coalesce(p.name, '') != '' and coalesce(p.mpn, '') != ''").select("url", "p.name", "p.mpn", F.col("p.offers.price").try_cast("double").alias("price")).dropDuplicates(["url", "mpn"])


def parse_itemprop_product(pages: DataFrame) -> DataFrame:
    """(url, name, sku, price) of microdata: a content attribute before the inner text; a price of 0 or less is null."""
    def prop(name: str) -> F.Column:
        content = F.regexp_extract("html", rf'(?is)<[^>]*itemprop=["\']{name}["\'][^>]*content=["\']([^"\']*)', 1)
        inner = F.regexp_extract("html", rf'(?is)<[^>]*itemprop=["\']{name}["\'][^>]*>([^<]*)<', 1)
        return F.coalesce(F.nullif(content, F.lit("")), F.nullif(tx.strip_html(inner), F.lit("")))

    price = prop("price").try_cast("double")
    return pages.select("url", prop("name").alias("name"), prop("sku").alias("sku"), F.when(price > 0, price).alias("price")).filter("name is not null")


def _meta(name: str) -> F.Column:
    one = rf'(?is)<meta[^>]*(?:property|name)=["\']{name}["\'][^>]*content=["\']([^"\']*)'
    two = rf'(?is)<meta[^>]*content=["\']([^"\']*)["\'][^>]*(?:property|name)=["\']{name}["\']'
    return F.coalesce(F.nullif(F.regexp_extract("html", one, 1), F.lit("")), F.nullif(F.regexp_extract("html", two, 1), F.lit("")))


def page_metadata(pages: DataFrame) -> DataFrame:
    """title, canonical_url and excerpt of pages (url, html): Open Graph first, then the page's own; without a title: no row."""
    title = F.coalesce(_meta("og:title"), F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    link = F.nullif(F.regexp_extract("html", r'(?is)<link[^>]*rel=["\']canonical["\'][^>]*href=["\']([^"\']+)', 1), F.lit(""))
    canonical = ur.canonicalize_url(F.coalesce(_meta("og:url"), link, F.col("url")))
    rows = pages.withColumns({"title": tx.strip_html(title), "canonical_url": canonical, "excerpt": tx.cap_summary(F.coalesce(_meta("og:description"), _meta("description"), title))})
    return rows.drop("html").filter("title != ''")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link): distinct canonical targets of a page's anchors, relative ones by the page's own address."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href=["']([^"'#]+)"""), F.lit(1))
    rows = pages.select("url", F.explode(hrefs).alias("h"))
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.concat(base, F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "[^/]*$", ""), F.lit("")), F.lit("/")))
    h = F.col("h")
    full = F.when(h.rlike("^[a-zA-Z]+://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), "h")).when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).when(h.startswith("/"), F.concat(base, "h")).otherwise(F.concat(folder, F.regexp_replace("h", r"^(?:\./)+", "")))
    return rows.select("url", ur.canonicalize_url(tx.decode_entities(full)).alias("link")).filter("link is not null").distinct()


#: Kinds of image sources, best first.
IMAGE_RANK = ["media", "enclosure", "og", "twitter", "jsonld", "article", "publication"]


def page_images(pages: DataFrame) -> DataFrame:
    """(url, image, source_type, place): candidates of pages by Open Graph, Twitter and JSON-LD, then <img> (the largest of a srcset, else its source) and CSS backgrounds."""
    every_of = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    imgs = every_of(r"""(?is)<img\s[^>]*?(?:data-src|src)=["']([^"']+)""")
    # of a srcset, the source with the largest width or density
    size = lambda x: F.coalesce(F.regexp_extract(x, r"\s([\d.]+)[wx]\s*$", 1).try_cast("double"), F.lit(0.0))
    largest = lambda x: F.array_max(F.transform(F.split(x, r",\s+"), lambda y: F.struct(size(y).alias("size"), F.split(F.trim(y), r"\s+")[0].alias("u"))))["u"]
    sets = F.transform(every_of(r"""(?is)<(?:img|source)\s[^>]*?srcset=["']([^"']+)"""), largest)
    ld = every_of(r'(?is)<script[^>]*application/ld\+json[^>]*>.*?"image"\s*:\s*\[?\s*(?:\{[^}]*?"url"\s*:\s*)?"([^"]+)"')
    css = every_of(r"""(?is)background(?:-image)?\s*:[^;"'}]*?url\(\s*["']?([^"')]+)""")
    listed = lambda many, kind: F.transform(many, lambda x: F.struct(x.alias("image"), F.lit(kind).alias("source_type")))
    one = lambda c, kind: F.filter(listed(F.array(c), kind), lambda x: x["image"].isNotNull())
    every = F.concat(one(_meta("og:image"), "og"), one(_meta("twitter:image"), "twitter"), listed(ld, "jsonld"), listed(F.concat(sets, imgs, css), "article"))
    found = pages.select("url", F.posexplode(every).alias("place", "x")).select("url", "place", tx.decode_entities(F.col("x.image")).alias("image"), "x.source_type")
    # a picture that a page names more than once counts where it stands first
    return found.groupBy("url", "image").agg(F.min(F.struct("place", "source_type")).alias("x")).select("url", "x.place", "image", "x.source_type")


def best_image(candidates: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Per url the best usable image; with probes (image, ok), the best that is ok."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*[F.lit(x) for x in IMAGE_RANK]), F.col("source_type"))
    rows = candidates.filter(ur.is_usable_image(F.col("image")))
    rows = rows if probes is None else rows.join(probes.filter("ok").select("image").distinct(), "image", "left_semi")
    first = Window.partitionBy("url").orderBy(rank, "place")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "place")


def image_verdict(probes: DataFrame, least_bytes: int = 1500) -> DataFrame:
    """Adds verdict of a crawl log (status, content_type, content_length): the first reason that holds, or ok."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    verdict = (
        F.when(F.col("status").isin(401, 403), "hotlink_or_forbidden").when(F.col("status").isin(404, 410), "missing").when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(kind.contains("svg"), "svg").when(~kind.startswith("image/"), "not_image").when(F.col("content_length") < least_bytes, "too_small").otherwise("ok")
    )
    return probes.withColumns({"verdict": verdict, "ok": verdict == "ok"})
