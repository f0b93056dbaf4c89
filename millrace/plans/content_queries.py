"""Registered queries: text and URL functions, the gate, duplicate groups, related articles and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls as ur
from millrace.operators import classify as cl
from millrace.operators import engagement as en
from millrace.operators import ingest as ing
from millrace.operators import related as rel
from millrace.storage import short_batches

from .derived import articles, read, with_sql


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    c = ur.canonicalize_url(F.col("url"))
    return p.select("page_id", c.alias("canonical"), ur.host(F.col("url")).alias("host"), ur.path(F.col("url")).alias("path"), F.size(ur.segments(F.col("url"))).cast("long").alias("depth"), ur.is_category_index(F.col("url")).alias("category_index"))


def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("text_md5"))


def cap_summary(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.cap_summary(F.col("html")).alias("summary"))


def title_keys(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("id", tx.normalize_title(F.col("title")).alias("title_key"), tx.duplicate_key(F.col("publication"), F.col("title")).alias("duplicate_key"), tx.slugify(F.col("title")).alias("slug"), tx.editorial_score(F.element_at(F.array(F.lit("Excellent"), F.lit("good one"), F.lit("Medium"), F.lit("x")), (F.col("id") % 4 + 1).cast("int")), F.col("excerpt")).alias("editorial_score"))


def language_gate(spark, sf_dir):
    short_batches(spark)
    a = articles(spark, sf_dir)
    return a.select("id", tx.is_english(F.col("title"), F.col("excerpt")).alias("english"))


#: Paths of articles, for each rule of the gate one at least.
PATHS = ["news/a", "about", "shop/item", "contests/win", "tag/contact", "reviews/dealers", "category/news", "subscribe-now", "cars", "legal/a", "f1/galleries", "giveaways-2024", "deals/x", "classifieds/1", "sponsored/a", "news/b"]


def _gated(spark, sf_dir):
    """Articles whose canonical and plain URL have paths, and now and then hosts, of their own."""
    i, n = F.col("id"), len(PATHS)
    part = lambda k: F.element_at(F.array(*[F.lit(x) for x in PATHS]), (k + 1).cast("int"))
    title = F.when(i % 50 == 7, F.lit("Show us your car")).when(i % 50 == 13, F.concat(F.lit("Tickets: "), F.col("title"), F.lit(" 20% off"))).otherwise(F.col("title"))
    host = lambda shop, other: F.when(i % shop == 0, F.lit("shop.")).when(i % other == 0, F.lit("other-")).otherwise("")
    url = lambda host, path: F.concat(F.lit("https://"), host, F.col("publication"), F.lit(".example.com/"), path)
    canonical, plain = url(host(17, 19), part(i % n)), url(host(29, 31), part(F.floor(i / n) * 5 % n))
    return articles(spark, sf_dir).withColumns({"title": title, "canonical_url": F.when(i % 37 != 0, canonical), "url": plain, "source_id": F.col("publication"), "source_url": F.concat(F.lit("https://www."), F.col("publication"), F.lit(".example.com/")), "desk_pick": i % 23 == 0})


def eligibility(spark, sf_dir):
    return ing.with_gate(_gated(spark, sf_dir)).select("id", "canonical_url", "reason")


def purge_report(spark, sf_dir):
    _, report = ing.purge(_gated(spark, sf_dir), F.when(ur.is_merch_url(F.col("url")), "merch").when(ur.is_listing_url(F.col("url")), "listing"))
    return report.groupBy("purge_reason").agg(F.count("*").alias("n"))


def ingest_summary(spark, sf_dir):
    a = ing.with_gate(_gated(spark, sf_dir)).withColumn("english", F.col("lang") == "en")
    return ing.ingest_summary(a.withColumn("inserted", F.col("english") & F.col("reason").isNull()))


def cap_per_source(spark, sf_dir):
    a = articles(spark, sf_dir).withColumnsRenamed({"publication": "source_id", "id": "feed_pos"})
    limits = a.select("source_id").distinct().withColumn("max_articles", F.when(F.col("source_id") == "src0", 3).cast("long"))
    return ing.cap_per_source(a, limits).select("source_id", "feed_pos")


def duplicate_groups(spark, sf_dir):
    return ing.duplicate_groups(articles(spark, sf_dir)).select("id", "duplicate_group_id")


def keep_best(spark, sf_dir):
    a = ing.duplicate_groups(articles(spark, sf_dir))
    return ing.keep_best(a, ["lang"], [F.desc("published_at"), F.asc("id")]).select("id", "lang", "duplicate_group_id")


def merge_articles(spark, sf_dir):
    a = articles(spark, sf_dir).withColumns({"canonical_url": ur.canonicalize_url(F.col("url")), "image_url": F.when(F.col("id") % 3 == 0, "https://img.example.com/a.jpg").when(F.col("id") % 3 == 1, "/logo/x.png")})
    old = a.filter("id % 2 = 0").withColumn("n", F.row_number().over(ing.Window.partitionBy("canonical_url").orderBy("id"))).filter("n = 1").withColumns({"first_seen": F.lit(1).cast("long"), "last_seen": F.lit(1).cast("long")}).select("canonical_url", "title", "url", "image_url", "first_seen", "last_seen")
    return ing.merge_articles(old, a.filter("id % 2 = 1"), 99, ["id"])


def _runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") % 78).cast("string")).alias("source_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))


def _sources(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_nationkey") % 4 != 0).alias("enabled"))


RUN_WEEK = 883_612_800_000  # 1998-01-01


def remaining_sources(spark, sf_dir):
    return ing.remaining_sources(_sources(spark, sf_dir), _runs(spark, sf_dir), RUN_WEEK).select("id")


def run_state(spark, sf_dir):
    left = ing.remaining_sources(_sources(spark, sf_dir), _runs(spark, sf_dir), RUN_WEEK)
    return ing.run_state(_runs(spark, sf_dir), RUN_WEEK, 100 * en.DAY_MS, left)


def source_status(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("source_id", F.concat(F.lit("s"), (F.col("id") % 80).cast("string")))
    return ing.source_status(_sources(spark, sf_dir), a, _runs(spark, sf_dir))


def image_census(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("image_url", F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://i.example.com/"), F.when(F.col("id") % 4 == 0, "logo.png").otherwise("a.jpg"))))
    return ing.image_census(a).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


def week_starts(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", ing.week_start_ms(F.col("started_at")).alias("week"), ing.week_start_ms(F.col("started_at"), 6).alias("ingest_week"))


def _entities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 400).alias("article_id"), F.when(F.col("p_size") % 3 == 0, "generation").when(F.col("p_size") % 3 == 1, "model").otherwise("make").alias("kind"), F.col("p_brand").alias("make"), F.concat(F.lit("M"), (F.col("p_size") % 4).cast("string")).alias("model"), F.concat(F.lit("G"), (F.col("p_size") % 5).cast("string")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, "mentioned").when(F.col("p_partkey") % 4 == 1, "relevant").otherwise("about").alias("relevance"))


def _places(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7 % 400).alias("article_id"), F.when(F.col("s_suppkey") % 3 == 0, "circuit").when(F.col("s_suppkey") % 3 == 1, "event").otherwise("city").alias("kind"), F.concat(F.lit("p"), (F.col("s_nationkey") % 6).cast("string")).alias("slug"))


def _related(spark, sf_dir):
    return rel.related_articles(rel.relation_keys(_entities(spark, sf_dir), _places(spark, sf_dir)), articles(spark, sf_dir))


def related_articles(spark, sf_dir):
    return _related(spark, sf_dir).select("article_id", "related_article_id", "reason", "score", "position")


def related_titles(spark, sf_dir):
    found = rel.with_titles(_related(spark, sf_dir), articles(spark, sf_dir))
    return found.select("article_id", F.array_join(F.transform("related", lambda x: F.concat_ws("|", x["related_article_id"].cast("string"), x["title"])), "\n").alias("related"))


TAG_RULES = {"Rally": ["ting", "rally"], "Design": ["esign", "the the"], "Tuning": ["onnt", "anth"], "Drift": ["drift", "lle "]}


def interest_tags(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", cl.padded(F.col("title"), F.col("excerpt")).alias("text"))
    return a.select("id", F.array_join(cl.tags(F.col("text"), TAG_RULES, "Car Culture"), ",").alias("tags"))


OF_CATEGORY = {"Racing": "motorsport", "Shows": "events", "Garage": "cars", "news": "cars"}
OF_INTEREST = {"Rally": "motorsport", "Design": "culture", "Road Trips": "driving"}
SECTION_WORDS = {"events": ["ering"], "motorsport": ["anth", "etri"], "driving": ["onnt"], "culture": ["lich", "ción"], "cars": ["ment", "the "]}


def primary_section(spark, sf_dir):
    a = articles(spark, sf_dir)
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % k + 1).cast("int"))
    rows = cl.with_section(a, cl.padded(F.col("title"), F.col("excerpt")), F.array(pick(["Racing", "Shows", "Garage", "news", "Other"], 5)), F.array(pick(["Rally", "Design", "Road Trips"], 3)), F.array(pick(["Build", "Video"], 2)), F.array(pick(["Drift", "Stance", "Tuning"], 3)), F.col("publication"), OF_CATEGORY, OF_INTEREST, SECTION_WORDS, ["Drift", "Tuning"], ["src3", "src4"])
    return rows.select("id", "slug", F.col("confidence").cast("long").alias("confidence"))


def count_by_section(spark, sf_dir):
    return cl.count_by_section(primary_section(spark, sf_dir).select(F.col("slug").alias("primary_slug")))


def story_list(spark, sf_dir):
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    stories = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("category_id")), "o_custkey")
    stories = stories.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), "category_id", F.col("o_orderdate").alias("published_at"), (F.col("o_orderstatus") == "P").alias("hidden"))
    found = ing.list_stories(stories, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 50)
    return found.select("id", "source", "category")


QUERIES = {
    "text_page_urls": page_urls, "text_strip_html": strip_html, "text_cap_summary": cap_summary, "text_title_keys": title_keys, "text_language_gate": language_gate,
    "gate_eligibility": eligibility, "gate_purge_report": purge_report, "ingest_summary": ingest_summary, "ingest_cap_per_source": cap_per_source,
    "ingest_duplicate_groups": duplicate_groups, "rank_keep_best": keep_best, "ingest_merge_articles": merge_articles, "ops_remaining_sources": remaining_sources,
    "ops_run_state": run_state, "ops_source_status": source_status, "ops_image_census": image_census, "ops_week_starts": week_starts, "related_articles": related_articles,
    "related_titles": related_titles, "classify_tags": interest_tags, "classify_section": primary_section, "classify_section_counts": count_by_section, "list_stories": story_list,
}

#: Letters with accents, for SQL: those of the Latin blocks.
_ACCENTS = "[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿĀ-ďĒ-ĥĨ-İĴ-ķĹ-ľŃ-ňŌ-őŔ-ťŨ-žƠơƯưǍ-ǜǞ-ǣǦ-ǰǴǵǸ-țȞȟȦ-ȳḀ-ẙẛẠ-ỹ]"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_LPATH = f"CASE WHEN regexp_replace(lower({_PATH}), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower({_PATH}), '/+$', '') END"
CANON = f"""(SELECT CASE WHEN w LIKE '%/' AND p <> '/' THEN substr(w, 1, length(w) - 1) ELSE w END FROM (SELECT p, sc || '://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS w FROM
    (SELECT regexp_extract(url, '^([a-zA-Z]+)://', 1) AS sc, {_HOST} AS h, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p, [x FOR x IN string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&') IF x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')] AS q)))"""
_DEC = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&nbsp;', ' ', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '\"', 'gi'), '&#39;|&apos;', '''', 'gi'), '&amp;', '&', 'gi')"
STRIP = "trim(regexp_replace(" + _DEC("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '&amp;', 'and', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SHOP, _OFF = {"c": "id % 17 = 0", "u": "id % 29 = 0"}, {"c": "(id % 17 <> 0 AND id % 19 = 0)", "u": "(id % 29 <> 0 AND id % 31 = 0)"}
#: What the rules make of each path, by its place in PATHS.
_FIRST = lambda p: f"WHEN {p} = 1 THEN 'about_page' WHEN {p} IN (9, 14) THEN 'corporate' WHEN {_SHOP[p]} OR {p} IN (5, 12) THEN 'commerce' WHEN {p} IN (3, 11) THEN 'competition'"
_LAST = lambda p: f"WHEN {p} IN (6, 7, 8, 10, 13) OR {_SHOP[p]} OR {_OFF[p]} THEN CASE WHEN {p} IN (2, 5) OR {_SHOP[p]} THEN 'commerce' WHEN {p} = 7 THEN 'subscription' WHEN {_OFF[p]} THEN 'corporate' ELSE 'category_page' END"
_PATH_LIST = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
_GATED = f"""g AS (SELECT *, CASE WHEN has THEN 'https://' || CASE WHEN {_SHOP["c"]} THEN 'shop.' WHEN {_OFF["c"]} THEN 'other-' ELSE '' END || publication || '.example.com/' || ({_PATH_LIST})[CAST(c0 + 1 AS INTEGER)] END AS canonical_url,
    CASE WHEN has THEN c0 END AS c, CASE WHEN id % 50 = 7 THEN 'Show us your car' WHEN id % 50 = 13 THEN 'Tickets: ' || title || ' 20% off' ELSE title END AS t2
    FROM (SELECT *, id % {len(PATHS)} AS c0, (id // {len(PATHS)}) * 5 % {len(PATHS)} AS u, id % 37 <> 0 AS has FROM articles))"""
_WORDS = "lower(coalesce(t2, '') || ' ' || coalesce(excerpt, ''))"
_REASON = f"""CASE WHEN id % 23 = 0 THEN NULL WHEN has THEN CASE {_FIRST("c")} ELSE CASE {_FIRST("u")} ELSE rest END END ELSE CASE {_FIRST("u")} ELSE rest END END"""
_REST = f"""CASE WHEN regexp_matches({_WORDS}, '\\btickets?\\b') AND regexp_matches({_WORDS}, '\\b\\d+% off\\b') THEN 'ticket_sales' WHEN contains({_WORDS}, 'members only') THEN 'subscription'
    WHEN regexp_matches(lower(t2), '^\\s*show us\\b') THEN 'low_editorial_value' WHEN (CASE WHEN has THEN c ELSE u END) IN (1, 7, 8, 11) AND trim(t2) <> '' AND trim(t2) = trim(excerpt) THEN 'category_page'
    WHEN c = 2 OR u = 2 THEN 'commerce' WHEN has AND (CASE {_LAST("c")} END) IS NOT NULL THEN CASE {_LAST("c")} END {_LAST("u")} WHEN NOT has THEN 'category_page' END"""
_GATED = f"{_GATED}, gr AS (SELECT *, {_REST} AS rest FROM g), gg AS (SELECT *, {_REASON} AS reason FROM gr)"
_RUNS = "runs AS (SELECT o_orderkey AS id, 's' || (o_custkey % 78) AS source_id, epoch_us(o_orderdate) // 1000 AS started_at, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'error' END AS status FROM orders), sources AS (SELECT 's' || s_suppkey AS id, s_nationkey % 4 <> 0 AS enabled FROM supplier)"
_FOREIGN = ", ".join(f"len([x FOR x IN w IF x IN ({', '.join(repr(v) for v in words)})])" for words in tx.FOREIGN_WORDS.values())
_EN = ", ".join(repr(v) for v in tx.ENGLISH_WORDS)
_RELKEYS = """keys AS (SELECT DISTINCT article_id, lower(make) || '::' || lower(model) || '::' || CASE WHEN kind = 'generation' THEN lower(name) ELSE '' END AS key, CASE WHEN kind = 'generation' THEN 'same-generation' ELSE 'same-vehicle' END AS reason, CASE WHEN kind = 'generation' THEN 90 ELSE 80 END AS score
    FROM (SELECT p_partkey % 400 AS article_id, CASE p_size % 3 WHEN 0 THEN 'generation' WHEN 1 THEN 'model' ELSE 'make' END AS kind, p_brand AS make, 'M' || (p_size % 4) AS model, 'G' || (p_size % 5) AS name, p_partkey % 4 AS r FROM part) WHERE kind <> 'make' AND r <> 0
    UNION SELECT s_suppkey * 7 % 400, CASE WHEN s_suppkey % 3 = 0 THEN 'circuit' ELSE 'event' END || '::p' || (s_nationkey % 6), 'same-event', 70 FROM supplier WHERE s_suppkey % 3 <> 2), kn AS (SELECT * FROM keys WHERE article_id IN (SELECT id FROM articles)),
    pr AS (SELECT a.article_id, b.article_id AS related_article_id, max(a.score) AS score FROM kn a JOIN kn b USING (key) WHERE a.article_id <> b.article_id GROUP BY 1, 2),
    rl AS (SELECT article_id, related_article_id, CASE score WHEN 90 THEN 'same-generation' WHEN 80 THEN 'same-vehicle' ELSE 'same-event' END AS reason, score, CAST(row_number() OVER (PARTITION BY article_id ORDER BY score DESC, related_article_id) AS INTEGER) AS position FROM pr QUALIFY position <= 5)"""
_TX = "(' ' || lower(concat_ws(' ', coalesce(title, ''), coalesce(excerpt, ''))) || ' ')"
_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f"contains({_TX}, '{n}')" for n in needles)} THEN '{name}' END" for name, needles in TAG_RULES.items())


def _section_sql() -> str:
    hits = {s: " + ".join(f"CASE WHEN contains({_TX}, '{n}') THEN {cl.KEYWORD_WEIGHT[s]} ELSE 0 END" for n in words) for s, words in SECTION_WORDS.items()}
    cat = "CASE id % 5 WHEN 0 THEN 'motorsport' WHEN 1 THEN 'events' WHEN 2 THEN 'cars' ELSE '' END"
    intr = "CASE id % 3 WHEN 0 THEN 'motorsport' WHEN 1 THEN 'culture' ELSE 'driving' END"
    base = ", ".join(f"CASE WHEN {cat} = '{s}' THEN 4 ELSE 0 END + CASE WHEN {intr} = '{s}' THEN 2 ELSE 0 END + {hits[s]} AS {s}0" for s in cl.SECTIONS)
    return f"""s0 AS (SELECT id, publication, {base} FROM articles), s1 AS (SELECT id, events0 AS events, motorsport0 AS motorsport, driving0 AS driving,
        culture0 + CASE WHEN id % 2 = 0 AND id % 3 <> 1 THEN 8 ELSE 0 END + CASE WHEN publication IN ('src3', 'src4') AND events0 < 3 AND motorsport0 < 3 AND driving0 < 3 THEN 2 ELSE 0 END AS culture, cars0 + CASE WHEN id % 2 = 0 AND id % 3 = 1 THEN 3 ELSE 0 END AS cars FROM s0),
        s2 AS (SELECT *, list_reverse_sort([events, motorsport, driving, culture, cars]) AS l FROM s1),
        pc AS (SELECT id, CASE WHEN l[1] <= 0 THEN 'culture' WHEN events = l[1] THEN 'events' WHEN motorsport = l[1] THEN 'motorsport' WHEN driving = l[1] THEN 'driving' WHEN culture = l[1] THEN 'culture' ELSE 'cars' END AS slug,
        CAST(CASE WHEN l[1] <= 0 THEN 50 ELSE greatest(55, least(95, 58 + 3 * l[1] + 2 * (l[1] - l[2]))) END AS BIGINT) AS confidence FROM s2)"""


_MERGE = f"""a AS (SELECT *, {CANON} AS canonical_url, CASE id % 3 WHEN 0 THEN 'https://img.example.com/a.jpg' WHEN 1 THEN '/logo/x.png' END AS image_url FROM articles),
    o AS (SELECT * FROM a WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY id) = 1),
    n AS (SELECT * FROM a WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY title, url) = 1)"""
ORACLE_SQL = {
    "text_page_urls": f"SELECT page_id, {CANON} AS canonical, regexp_replace({_HOST}, '^www\\.', '') AS host, {_LPATH} AS path, CAST(len([x FOR x IN string_split({_LPATH}, '/') IF x <> '']) AS BIGINT) AS depth, len([x FOR x IN string_split({_LPATH}, '/') IF x <> '']) = 2 AND string_split({_LPATH}, '/')[2] = 'category' AS category_index FROM pages",
    "text_strip_html": f"SELECT page_id, md5({STRIP}) AS text_md5 FROM pages",
    "text_cap_summary": f"WITH s AS (SELECT page_id, {STRIP} AS t FROM pages), c AS (SELECT *, substr(t, 1, 320) AS k FROM s), d AS (SELECT *, CASE WHEN contains(k, ' ') THEN length(k) - instr(reverse(k), ' ') ELSE -1 END AS sp FROM c) SELECT page_id, CASE WHEN length(t) <= 320 THEN t ELSE trim(CASE WHEN sp > 80 THEN substr(k, 1, sp) ELSE k END) || '…' END AS summary FROM d",
    "text_title_keys": with_sql(["articles"], f"SELECT id, {_NORM('title')} AS title_key, {_NORM('publication')} || '::' || {_NORM('title')} AS duplicate_key, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE id % 4 WHEN 0 THEN 20 WHEN 1 THEN 12 WHEN 2 THEN 6 ELSE 4 END + CASE WHEN length(coalesce(excerpt, '')) >= 180 THEN 8 ELSE 0 END AS editorial_score FROM articles"),
    "text_language_gate": with_sql(["articles"], f"WITH t AS (SELECT id, trim(coalesce(title, '') || ' ' || coalesce(excerpt, '')) AS x FROM articles), w AS (SELECT id, x, regexp_extract_all(lower(x), '\\p{{L}}+') AS w, len(regexp_extract_all(x, '{_ACCENTS}')) AS ac FROM t), h AS (SELECT *, len([v FOR v IN w IF v IN ({_EN})]) AS en, greatest({_FOREIGN}) AS f FROM w) SELECT id, x = '' OR len(w) = 0 OR NOT (f >= 4 OR f >= 3 AND f >= en OR f >= 2 AND en = 0 OR ac >= 8 OR ac >= 5 AND f >= 2) AS english FROM h"),
    "gate_eligibility": with_sql(["articles"], f"WITH {_GATED} SELECT id, canonical_url, reason FROM gg"),
    "gate_purge_report": with_sql(["articles"], f"WITH {_GATED} SELECT CASE WHEN u = 2 THEN 'merch' ELSE 'listing' END AS purge_reason, count(*) AS n FROM g WHERE u IN (2, 7, 13) GROUP BY 1"),
    "ingest_summary": with_sql(["articles"], f"WITH {_GATED}, r AS (SELECT *, lang = 'en' AS english FROM gg) SELECT publication AS source_id, count(*) AS fetched, count(CASE WHEN english AND reason IS NULL THEN 1 END) AS inserted, count(CASE WHEN NOT english THEN 1 END) AS skipped_language, count(CASE WHEN english AND reason = 'commerce' THEN 1 END) AS skipped_merch, count(CASE WHEN english AND reason <> 'commerce' THEN 1 END) AS skipped_non_editorial FROM r GROUP BY 1"),
    "ingest_cap_per_source": with_sql(["articles"], "SELECT publication AS source_id, id AS feed_pos FROM articles QUALIFY row_number() OVER (PARTITION BY publication ORDER BY id) <= CASE WHEN publication = 'src0' THEN 3 ELSE 8 END"),
    "ingest_duplicate_groups": with_sql(["articles"], f"SELECT id, nullif({_NORM('title')}, '') AS duplicate_group_id FROM articles"),
    "rank_keep_best": with_sql(["articles"], f"WITH k AS (SELECT id, lang, published_at, nullif({_NORM('title')}, '') AS duplicate_group_id FROM articles) SELECT id, lang, duplicate_group_id FROM k QUALIFY duplicate_group_id IS NULL OR row_number() OVER (PARTITION BY lang, duplicate_group_id ORDER BY published_at DESC, id) = 1"),
    "ingest_merge_articles": with_sql(["articles"], f"WITH {_MERGE} SELECT coalesce(o.canonical_url, n.canonical_url) AS canonical_url, coalesce(o.title, n.title) AS title, coalesce(o.url, n.url) AS url, CASE WHEN o.image_url LIKE 'https%' THEN o.image_url ELSE coalesce(n.image_url, o.image_url) END AS image_url, CASE WHEN o.id IS NULL THEN 99 ELSE 1 END AS first_seen, CASE WHEN n.id IS NULL THEN 1 ELSE 99 END AS last_seen FROM o FULL JOIN n ON o.canonical_url = n.canonical_url"),
    "ops_remaining_sources": f"WITH {_RUNS} SELECT id FROM sources WHERE enabled AND id NOT IN (SELECT source_id FROM runs WHERE started_at >= {RUN_WEEK} AND status IN ('ok', 'error'))",
    "ops_run_state": f"WITH {_RUNS}, rem AS (SELECT count(*) AS n FROM sources WHERE enabled AND id NOT IN (SELECT source_id FROM runs WHERE started_at >= {RUN_WEEK} AND status IN ('ok', 'error'))), l AS (SELECT *, {RUN_WEEK} - started_at < {100 * en.DAY_MS} AS live FROM runs WHERE status = 'running') SELECT (SELECT id FROM l WHERE live ORDER BY started_at DESC, id DESC LIMIT 1) AS locked_by, count(CASE WHEN NOT live THEN 1 END) AS stale_runs, count(CASE WHEN live THEN 1 END) > 0 AS locked, (SELECT n FROM rem) AS remaining, CASE WHEN count(CASE WHEN live THEN 1 END) > 0 THEN 'locked' WHEN (SELECT n FROM rem) = 0 THEN 'complete' ELSE 'ingest' END AS action FROM l",
    "ops_source_status": with_sql(["articles"], f"WITH {_RUNS}, ac AS (SELECT 's' || (id % 80) AS source_id, count(*) AS articles FROM articles GROUP BY 1), la AS (SELECT source_id, max(CASE WHEN status = 'ok' THEN started_at END) AS last_ok, max(CASE WHEN status = 'error' THEN started_at END) AS last_error FROM runs GROUP BY 1), fa AS (SELECT source_id, count(*) AS failure_count FROM runs JOIN la USING (source_id) WHERE status = 'error' AND started_at > coalesce(last_ok, -1) GROUP BY 1) SELECT s.id AS source_id, coalesce(articles, 0) AS articles, last_ok, last_error, coalesce(failure_count, 0) AS failure_count FROM sources s LEFT JOIN ac ON ac.source_id = s.id LEFT JOIN la ON la.source_id = s.id LEFT JOIN fa ON fa.source_id = s.id"),
    "ops_image_census": with_sql(["articles"], "WITH m AS (SELECT *, id % 3 = 0 OR id % 4 = 0 AS missing, row_number() OVER (PARTITION BY publication, (id % 3 = 0 OR id % 4 = 0) ORDER BY id) AS n FROM articles) SELECT publication, count(*) AS total, count(CASE WHEN missing THEN 1 END) AS missing, coalesce(string_agg(CASE WHEN missing AND n <= 3 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id), '') AS samples FROM m GROUP BY 1"),
    "ops_week_starts": f"WITH {_RUNS} SELECT id, epoch_ms(CAST(date_trunc('week', make_timestamp(started_at * 1000)) AS TIMESTAMP)) AS week, epoch_ms(CAST(date_trunc('week', make_timestamp((started_at - 21600000) * 1000)) AS TIMESTAMP)) + 21600000 AS ingest_week FROM runs",
    "related_articles": with_sql(["articles"], f"WITH {_RELKEYS} SELECT * FROM rl"),
    "related_titles": with_sql(["articles"], f"WITH {_RELKEYS} SELECT article_id, string_agg(concat_ws('|', related_article_id, title), chr(10) ORDER BY score DESC, related_article_id) AS related FROM rl JOIN articles ON id = related_article_id GROUP BY 1"),
    "classify_tags": with_sql(["articles"], f"WITH t AS (SELECT id, [x FOR x IN [{_TAGS}] IF x IS NOT NULL] AS l FROM articles) SELECT id, CASE WHEN len(l) = 0 THEN 'Car Culture' ELSE array_to_string(l, ',') END AS tags FROM t"),
    "classify_section": with_sql(["articles"], f"WITH {_section_sql()} SELECT * FROM pc"),
    "classify_section_counts": with_sql(["articles"], f"WITH {_section_sql()} SELECT s AS primary_slug, count(id) AS n FROM (SELECT unnest(['events', 'motorsport', 'driving', 'culture', 'cars']) AS s) LEFT JOIN pc ON slug = s GROUP BY 1"),
    "list_stories": "SELECT o_orderkey AS id, c_name AS source, n_name AS category FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
}
