"""Registered queries: merges, deletions and lookups of stored tables, tags with confidence, page addresses and teasers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import profiles as pf
from millrace.functions import text as tx
from millrace.functions import urls as ur
from millrace.operators import classify as cl
from millrace.operators import fitment as fi
from millrace.operators import gazetteer as gz
from millrace.operators import ingest as ing
from millrace.operators import ranking as rk
from millrace.sources import sinks

from . import ranking_queries as rq
from .derived import NOW_MS, articles, read, with_sql


# -- merges and deletions -----------------------------------------------------------------------------------------------
def upsert_changed(spark, sf_dir):
    """Suppliers whose catalogue row differs from the stored one; status is the stored table's own."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    old = s.filter("id % 3 != 0").withColumns({"nation": F.when(F.col("id") % 5 == 0, F.col("nation") + 1).otherwise(F.col("nation")), "status": F.concat(F.lit("s"), F.col("id").cast("string"))})
    return ing.upsert_changed(old, s, "id", ["name", "nation"])


def replace_by_source(spark, sf_dir):
    """Customers of the nations that suppliers of a second delivery come from are replaced."""
    old = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("id"))
    new = read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("id"))
    return ing.replace_by_source(old, new)


def cascade_delete(spark, sf_dir):
    """Lines and orders left when the orders of customers in debt go: rows and keys of each table."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), "o_custkey")
    gone = o.join(read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("article_id")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    left = ing.cascade_delete({"orders": (o, ["article_id"]), "lines": (lines, ["l_orderkey"])}, gone)
    count = lambda name, key: left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).cast("long").alias("keys"))
    return count("orders", "article_id").unionByName(count("lines", "l_orderkey"))


def merge_first_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("visitor_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_day"), "o_orderstatus")
    return ing.merge_visitor_first(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus != 'F'").drop("o_orderstatus"))


def merge_primary(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.filter("p_size < 30").select(k.alias("article_id"), F.lit("cars").alias("primary_slug"), F.col("p_size").cast("int").alias("confidence"), F.element_at(F.array(F.lit("rule"), F.lit("manual"), F.lit("ai")), (F.col("p_size") % 3 + 1).cast("int")).alias("source"))
    new = p.filter("p_size >= 10").select(k.alias("article_id"), F.lit("events").alias("primary_slug"), F.lit(80).alias("confidence"), F.lit("rule").alias("source"))
    return cl.merge_primary(old, new)


def backfill(spark, sf_dir):
    a = articles(spark, sf_dir).withColumns({"ai_summary": F.when(F.length("excerpt") > 2000, F.substring("excerpt", 1, 50)), "image_url": F.when(F.col("n_chars") % 2 == 0, "https://i.example.com/a.jpg"), "ingestion_method": F.when(F.col("publication") == "src1", "youtube").otherwise("rss")})
    kinds = [ing.backfill_worklist(a, what).select(F.lit(what).alias("what"), "id") for what in ("summary", "image")]
    return kinds[0].unionByName(kinds[1])


# -- picks, sitemaps and stored lists -----------------------------------------------------------------------------------
def _picks(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("article_id"), (F.col("o_orderstatus") != "F").alias("active"), F.when(F.col("o_orderpriority").startswith("1"), F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 10_500 * 86_400_000).alias("expires_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "Editor's pick").otherwise("Old label").alias("label"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("note ").alias("note"), (F.col("o_custkey") % 7).alias("sort_order"), (F.col("o_custkey") % 2).alias("featured"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("selected_at"),
    )


def live_picks(spark, sf_dir):
    return sinks.live_picks(_picks(spark, sf_dir), NOW_MS).select("article_id", "label", "note")


def homepage_picks(spark, sf_dir):
    return sinks.homepage_picks(sinks.live_picks(_picks(spark, sf_dir), NOW_MS)).select("article_id", "sort_order")


def sitemap_table(spark, sf_dir):
    a = articles(spark, sf_dir).withColumns({"source_id": F.col("publication"), "reason": F.when(F.col("n_chars") < 300, "thin"), "last_processed": F.when(F.col("lang") == "en", F.col("published_at") + 5)})
    sources = a.select(F.col("source_id").alias("id")).distinct().withColumn("enabled", F.col("id") != "src2")
    picks = a.filter("n_chars < 100").select(F.col("id").alias("article_id"))
    return sinks.sitemap_entries(a, sources, picks, spark.createDataFrame([("/", None), ("/about", 7)], "loc string, lastmod long"))


def hydrate(spark, sf_dir):
    """Stored lists with their articles, of which those in Spanish are not eligible any more."""
    lists = rq.default_lists(spark, sf_dir)
    a = articles(spark, sf_dir).withColumn("reason", F.when(F.col("n_chars") % 5 == 0, "gone")).select("id", "title", "reason")
    return rk.hydrate(lists, a).select("list_key", "article_id", F.col("position").cast("long").alias("position"), "title")


# -- classification -----------------------------------------------------------------------------------------------------
CONFIDENT = {"Rally": ["ting", "anth"], "Design": ["die", "the", "una"], "Tuning": ["in the", "und", "ed"], "Drift": ["zz-top", "911"]}


def confident_tags(spark, sf_dir):
    """Tags with how sure one is of each, from needles as whole words in title and text."""
    needles = sorted({n for words in CONFIDENT.values() for n in words})
    a = gz.find_aliases(articles(spark, sf_dir).select("id", "title", "excerpt"), {"in_title": F.col("title"), "in_text": F.col("excerpt")}, needles)
    return a.select("id", F.explode(cl.found_tags(F.col("in_title"), F.col("in_text"), CONFIDENT)).alias("t")).select("id", "t.tag", F.col("t.confidence").cast("long").alias("confidence"))


def teasers(spark, sf_dir):
    """Teasers of articles of which the summary is the title now and then."""
    a = articles(spark, sf_dir)
    summary, extract = F.when(F.col("id") % 3 == 0, F.concat(F.lit("« "), "title", F.lit(" »"))).when(F.col("id") % 3 == 1, F.substring("excerpt", 1, 200)), F.substring("excerpt", 20, 300)
    return a.select("id", F.md5(tx.teaser_excerpt(F.col("title"), summary, extract)).alias("teaser"), tx.same_copy(F.col("title"), F.col("excerpt")).alias("same"))


def page_kinds(spark, sf_dir):
    """What the address of a page says: whether crawlers may read it, whether it looks like an article, and a video's id."""
    p = read(spark, sf_dir, "pages")
    u, where = F.concat(F.lit("https://site.example.com"), F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)), F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    rules = lambda *xs: F.array(*[F.lit(x) for x in xs])
    tube = F.concat(F.lit("https://www.youtube.com/watch?v=id_"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    return p.select("page_id", ur.robots_allowed(where, rules("/en/1", "/de"), rules("/en", "/de", "")).alias("allowed"), ur.looks_like_article(u, F.lit("https://site.example.com/")).alias("article"), ur.video_id(F.when(F.col("page_id") % 2 == 0, tube).otherwise(u)).alias("video"))


def stored_names(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    client = F.when(F.col("event_type") == "click", "outbound_original_click").when(F.col("event_type") == "purchase", "story_save").when(F.col("event_type") == "view", "story_open").otherwise(F.col("event_type"))
    return e.groupBy(pf.stored_event_name(client).alias("event")).agg(F.count("*").alias("n"))


def dimensions(spark, sf_dir):
    """Manufacturers of parts: known ids where there are some, new ones else."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("maker"))
    known = p.filter("maker != 'Brand#12'").groupBy("maker").agg(F.min("product_id").alias("n")).select(tx.slugify(F.col("maker")).alias("slug"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("id"), F.col("maker").alias("name"))
    rows, dimension = fi.assign_dimension(p, known, "maker", "maker:")
    return rows.groupBy("maker_id").agg(F.count("*").alias("n")).join(dimension.select(F.col("id").alias("maker_id"), "slug", "name"), "maker_id")


def assembled(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    products = p.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("s"), (F.col("p_size") % 30).cast("string")).alias("source_id"))
    sources = read(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("feed").alias("kind"), (F.col("n_nationkey") * 3).cast("int").alias("priority"))
    cells = [("brand", "p_brand", 1), ("type", "p_type", 2), ("brand", "p_name", 3)]
    attributes = p.select(F.col("p_partkey").alias("product_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).alias("value"), F.lit(i).alias("id")) for a, c, i in cells])).alias("x")).select("product_id", "x.*")
    found = fi.assemble(products, sources, attributes.filter("product_id % 4 != 0 or id != 3"))
    return found.select("product_id", "source_kind", F.col("source_priority").cast("long").alias("source_priority"), F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"))


QUERIES = {
    "ops_upsert_changed": upsert_changed, "ops_replace_by_source": replace_by_source, "ops_cascade_delete": cascade_delete, "ops_merge_first_days": merge_first_days, "ops_backfill": backfill, "classify_primary_merge": merge_primary,
    "ops_live_picks": live_picks, "ops_homepage_picks": homepage_picks, "ops_sitemap_table": sitemap_table, "rank_hydrate": hydrate, "classify_confident_tags": confident_tags, "text_teasers": teasers,
    "text_page_kinds": page_kinds, "stream_stored_names": stored_names, "parts_dimensions": dimensions, "parts_assembled": assembled,
}

_FOLD = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_HAS = lambda c, n: f"CASE WHEN regexp_matches(replace(lower(coalesce({c}, '')), '’', ''''), '(^|[^a-z0-9]){gz.needle(n)}($|[^a-z0-9])') THEN 1 ELSE 0 END"


def _confident_sql() -> str:
    parts = []
    for tag, needles in CONFIDENT.items():
        head, body = (" + ".join(_HAS(c, n) for n in needles) for c in ("title", "excerpt"))
        parts.append(f"SELECT id, '{tag}' AS tag, {head} AS h, {body} AS b FROM articles")
    return f"SELECT id, tag, CAST(CASE WHEN h > 0 THEN least(94, 78 + 6 * h) ELSE least(82, 64 + 5 * b) END AS BIGINT) AS confidence FROM ({' UNION ALL '.join(parts)}) WHERE h > 0 OR b > 0"


_PICKS = f"""picks AS (SELECT o_orderkey AS article_id, o_custkey % 7 AS sort_order, o_custkey % 2 AS featured, epoch_us(o_orderdate) // 1000 AS selected_at, o_orderkey % 2 AS odd, o_orderkey % 3 AS third FROM orders
    WHERE o_orderstatus <> 'F' AND (o_orderpriority NOT LIKE '1%' OR epoch_us(o_orderdate) // 1000 + {10_500 * 86_400_000} > {NOW_MS}))"""
_WHERE = "regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1)"
ORACLE_SQL = {
    "ops_upsert_changed": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, CASE WHEN s_suppkey % 3 <> 0 THEN 's' || s_suppkey END AS status FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0",
    "ops_replace_by_source": "WITH n AS (SELECT s_nationkey AS source_id, s_suppkey AS id FROM supplier WHERE s_acctbal < 0) SELECT c_nationkey AS source_id, c_custkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT source_id FROM n) UNION ALL SELECT * FROM n",
    "ops_cascade_delete": "WITH g AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0) SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM g) UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g)",
    "ops_merge_first_days": "SELECT CAST(o_custkey AS VARCHAR) AS visitor_key, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_day FROM orders GROUP BY 1",
    "classify_primary_merge": "SELECT p_partkey AS article_id, CASE WHEN p_size < 10 OR p_size < 30 AND p_size % 3 <> 0 THEN 'cars' ELSE 'events' END AS primary_slug, CAST(CASE WHEN p_size < 10 OR p_size < 30 AND p_size % 3 <> 0 THEN p_size ELSE 80 END AS INTEGER) AS confidence, CASE WHEN p_size < 30 AND p_size % 3 = 1 THEN 'manual' WHEN p_size < 30 AND p_size % 3 = 2 THEN 'ai' ELSE 'rule' END AS source FROM part",
    "ops_backfill": with_sql(["articles"], "SELECT 'summary' AS what, id FROM articles WHERE publication IS DISTINCT FROM 'src1' AND (NOT coalesce(length(excerpt) > 2000, false) OR trim(substr(excerpt, 1, 50), ' ') = '') UNION ALL SELECT 'image', id FROM articles WHERE publication IS DISTINCT FROM 'src1' AND NOT coalesce(n_chars % 2 = 0, false)"),
    "ops_live_picks": f"WITH {_PICKS} SELECT article_id, 'Editor''s pick' AS label, CASE WHEN third <> 0 THEN 'note' END AS note FROM picks",
    "ops_homepage_picks": f"WITH {_PICKS} SELECT article_id, sort_order FROM picks ORDER BY sort_order, featured DESC, selected_at DESC, article_id LIMIT 3",
    "ops_sitemap_table": with_sql(["articles"], "SELECT '/story/' || id AS loc, CASE WHEN lang = 'en' THEN published_at + 5 ELSE published_at END AS lastmod FROM articles WHERE publication <> 'src2' AND (coalesce(n_chars >= 300, true) OR n_chars < 100) UNION ALL SELECT '/', NULL UNION ALL SELECT '/about', 7"),
    "rank_hydrate": with_sql(["articles"], f"WITH {rq._L}, d AS (SELECT * FROM l QUALIFY grp IS NULL OR row_number() OVER (PARTITION BY lang, grp ORDER BY pos) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS p FROM d), k AS (SELECT * FROM n WHERE p <= 80 AND n_chars % 5 <> 0) SELECT lang AS list_key, id AS article_id, row_number() OVER (PARTITION BY lang ORDER BY p) - 1 AS position, title FROM k"),
    "classify_confident_tags": with_sql(["articles"], _confident_sql()),
    "text_teasers": with_sql(["articles"], f"""WITH t AS (SELECT id, title, excerpt, CASE id % 3 WHEN 0 THEN '« ' || title || ' »' WHEN 1 THEN substr(excerpt, 1, 200) END AS s, substr(excerpt, 20, 300) AS e FROM articles), f AS (SELECT *, {_FOLD("title")} AS ft, {_FOLD("excerpt")} AS fx, {_FOLD("s")} AS fs, {_FOLD("e")} AS fe FROM t)
        SELECT id, md5(CASE WHEN fs <> '' AND fs <> ft THEN trim(s, ' ') WHEN fe <> '' AND fe <> ft AND fe <> fs THEN trim(e, ' ') END) AS teaser, ft <> '' AND fx <> '' AND (starts_with(ft, fx) OR starts_with(fx, ft)) AS same FROM f"""),
    "text_page_kinds": f"""SELECT page_id, CASE WHEN {_WHERE} LIKE '/en/1%' THEN true WHEN {_WHERE} LIKE '/en%' OR {_WHERE} LIKE '/de%' THEN false ELSE {_WHERE} IS NOT NULL END AS allowed,
        coalesce(len([x FOR x IN string_split(regexp_extract({_WHERE}, '^([^?#]*)', 1), '/') IF x <> '']) >= 1, false) AS article, CASE WHEN page_id % 2 = 0 THEN 'id_' || lpad(CAST(page_id AS VARCHAR), 8, '0') END AS video FROM pages""",
    "stream_stored_names": "SELECT CASE event_type WHEN 'click' THEN 'outbound' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'story_open' END AS event, count(*) AS n FROM events GROUP BY 1",
    "parts_dimensions": "WITH m AS (SELECT p_brand, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN p_brand = 'Brand#12' THEN 'maker:' || replace(lower(p_brand), '#', '-') ELSE 'k' || k END AS maker_id, n, replace(lower(p_brand), '#', '-') AS slug, p_brand AS name FROM m",
    "parts_assembled": "SELECT p_partkey AS product_id, CASE WHEN n_nationkey IS NULL THEN 'manual' ELSE 'feed' END AS source_kind, CAST(coalesce(n_nationkey * 3, 50) AS BIGINT) AS source_priority, 'brand=' || CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE p_brand END || ';type=' || p_type AS attributes FROM part LEFT JOIN nation ON n_nationkey = p_size % 30",
}
