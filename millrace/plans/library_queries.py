"""Registered queries: feature arrays, coverage, terms, images, entities, sources and other operators, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import images as im
from millrace.operators import features as fe
from millrace.operators import fitment as fi
from millrace.operators import gazetteer as gz
from millrace.operators import ingest as ing
from millrace.sources import readers as rd
from millrace.storage import scratch

from .content_queries import _DEC, STRIP
from .derived import articles, read, with_sql


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


# -- features -----------------------------------------------------------------------------------------------------------
def _entities(spark, sf_dir):
    """Three entities an article, from part."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    kind = F.element_at(F.array(F.lit("generation"), F.lit("model"), F.lit("make")), (size % 3 + 1).cast("int"))
    model, generation = F.concat(F.lit("M"), (size % 4).cast("string")), F.concat(F.lit("G"), (size % 5).cast("string"))
    name = F.when(kind == "make", F.col("p_brand")).when(kind == "model", model).otherwise(generation)
    return p.select(F.floor(F.col("p_partkey") / 3).alias("article_id"), F.col("p_partkey").alias("pos"), kind.alias("kind"), name.alias("name"), F.col("p_brand").alias("make"), model.alias("model"), F.lit("about").alias("relevance"))


def _mode():
    return F.element_at(F.array(*[F.lit(x) for x in ("AIR", "Reg Air", "SHIP", "MAIL", "RAIL", "Air")]), (F.col("l_suppkey") % 6 + 1).cast("int"))


def _tags(spark, sf_dir):
    """Interests and categories of articles, from lineitem."""
    rows = read(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    return rows.select(F.floor(F.col("l_partkey") / 3).alias("article_id"), F.when(odd, "interests").otherwise("categories").alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.when(odd, _mode()).otherwise(F.concat("l_returnflag", F.lit("/"), "l_linestatus")).alias("value"))


def feature_arrays(spark, sf_dir):
    found = fe.article_features(articles(spark, sf_dir).select("id"), _entities(spark, sf_dir), _tags(spark, sf_dir))
    return found.select("id", *[_joined(c) for c in ("makes", "models", "generations", "interests", "categories")], F.size(F.coalesce("entity_hits", F.array())).cast("long").alias("hits"))


def feature_coverage(spark, sf_dir):
    return fe.entity_coverage(articles(spark, sf_dir), _entities(spark, sf_dir), "Brand#13")


def feature_terms(spark, sf_dir):
    found = fe.article_features(articles(spark, sf_dir).select("id"), _entities(spark, sf_dir), _tags(spark, sf_dir))
    return fe.top_terms(found)


NAMES = {"air": "Air", "reg air": "Air", "ship": "Sea", "mail": "Mail"}


def _rewritten(spark, sf_dir):
    return fe.rewrite_interests(_tags(spark, sf_dir).filter("kind = 'interests'").select("article_id", F.col("value").alias("interest")), NAMES)


def feature_interests(spark, sf_dir):
    return _rewritten(spark, sf_dir)[0]


def feature_interests_changed(spark, sf_dir):
    return _rewritten(spark, sf_dir)[1].select("article_id", _joined("after"))


def feature_attributes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), _mode().alias("attribute"), F.concat("l_returnflag", "l_linestatus").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return fe.attribute_map(rows).select("product_id", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"))


def facets_union(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    live = p.select(F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    known = p.select(F.upper("p_brand").alias("make"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name")).alias("model"))
    return fe.union_facets(live, known)


def source_missing(spark, sf_dir):
    sources = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return fe.without_rows(sources, read(spark, sf_dir, "lineitem").filter("l_quantity >= 50"), "l_suppkey")


def ops_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("second", -F.col("o_orderkey"))
    return fe.latest(rows, "o_orderdate", "second", 20).select("o_orderkey")


# -- images -------------------------------------------------------------------------------------------------------------
def _states(spark, sf_dir):
    url = lambda k: F.concat(F.lit("https://i.example.com/"), k.cast("string"), F.lit(".jpg"))
    candidates = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), url(F.col("l_partkey")).alias("url"), F.col("l_linenumber").alias("rank"))
    probes = read(spark, sf_dir, "part").filter("p_size % 7 != 0").select(url(F.col("p_partkey")).alias("url"), (F.col("p_size") % 3 == 0).alias("ok"))
    return im.probe_states(candidates, probes)


def image_states(spark, sf_dir):
    return _states(spark, sf_dir)


def image_status(spark, sf_dir):
    return im.image_status(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _states(spark, sf_dir))


def image_display(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    url = lambda n, file: F.concat(F.lit("https://i.example.com/"), (k % n).cast("string"), F.lit(file))
    sources = F.array(F.struct(url(3, "/a.jpg").alias("url"), F.lit("ok").alias("status")), F.struct(url(5, "/logo.png").alias("url"), F.lit("ok").alias("status")), F.struct(url(2, "/b.jpg").alias("url"), F.when(k % 4 == 0, "skipped").otherwise("failed").alias("status")))
    found = im.display_images(F.when(k % 7 != 0, url(3, "/a.jpg")), F.when(k % 2 == 0, url(11, "/c.svg")).otherwise(url(2, "/b.jpg")), sources)
    return o.select("o_orderkey", F.array_join(found, ",").alias("images"))


def video_flags(spark, sf_dir):
    a = articles(spark, sf_dir)
    method, url = F.when(F.col("id") % 4 == 0, "YouTube").otherwise("rss"), F.when(F.col("id") % 6 == 1, "https://x.example.com/Watch?v=1").otherwise(F.col("url"))
    relevance = F.when(F.col("id") % 3 == 0, "excellent reach").when(F.col("id") % 3 == 1, "Good")
    return a.select("id", im.is_video(method, url).alias("video"), im.source_relevance(F.when(F.col("id") % 2 == 0, "video").otherwise("rss"), relevance).alias("relevance"))


# -- entities, sources, parts ---------------------------------------------------------------------------------------------
GAZETTEER = [{"make": "Sich", "make_aliases": ["schau"], "models": [
    {"name": "Para", "aliases": [], "generations": ["ment"], "variants": ["las"], "generation_implies_model": True},
    {"name": "Ther", "aliases": ["here"], "generations": [], "variants": [], "generation_implies_model": False},
]}]
SPECIAL = [{"model": "Para", "name": "Para Special", "needles": ["con", "que"], "confidence": 71}]


def classify_entities(spark, sf_dir):
    return gz.extract_entities(articles(spark, sf_dir), GAZETTEER, SPECIAL).select("article_id", "kind", "name", "in_title", F.col("confidence").cast("long").alias("confidence"))


def _stored(rows, name):
    """Lines of text files, in a folder for each source_id; a file holds so many lines at most."""
    path = scratch(rows.sparkSession, name)
    rows.select("source_id", "value").write.option("maxRecordsPerFile", 100_000).partitionBy("source_id").text(path)
    return path


def source_sitemaps(spark, sf_dir):
    p = read(spark, sf_dir, "pages").filter("url is not null")
    lines = p.select((F.col("page_id") % 40).cast("string").alias("source_id"), F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("\n</loc></url>")).alias("value"))
    return rd.read_sitemaps(spark, _stored(lines, "sitemaps"), "source_id").select("source_id", "url")


def source_feeds(spark, sf_dir):
    """Feeds of all articles, with their titles and whole texts, from stored files."""
    a, i = articles(spark, sf_dir).filter("id is not null"), F.col("id").cast("string")
    day = F.concat(F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 10:00:00 +0000"))
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    item = tag("item", F.concat(tag("title", safe(F.col("title"))), tag("link", F.col("url")), tag("guid", i), tag("pubDate", day), tag("description", safe(F.col("excerpt")))))
    source = (F.col("id") % 50).cast("string").alias("source_id")
    heads = a.select(source).distinct().withColumn("value", F.lit("<rss><channel>"))
    items, _ = rd.read_feeds(spark, _stored(heads.unionByName(a.select(source, item.alias("value"))), "feeds"), 0, key="source_id")
    return items.select("source_id", "guid", "title", "canonical_url", "published_at", F.md5("excerpt").alias("excerpt_md5"))


def image_verdicts(spark, sf_dir):
    rows, k = read(spark, sf_dir, "lineitem"), F.col("l_partkey")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 403, 404, 500)]), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("image/jpeg"), F.lit("image/svg+xml"), F.lit("text/html"), F.lit(None)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    probes = rows.select("l_orderkey", "l_linenumber", status.alias("status"), kind.alias("content_type"), (F.col("l_quantity") * 100).cast("long").alias("content_length"))
    return rd.image_verdict(probes).select("l_orderkey", "l_linenumber", "verdict", "ok")


def parts_specialists(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    requests = fi.canonical(c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("Make "), (F.col("c_nationkey") % 5).cast("string")).alias("make"), F.concat(F.lit("M"), (F.col("c_custkey") % 4).cast("string")).alias("model"), F.when(F.col("c_custkey") % 2 == 0, "brakes").otherwise("exhaust").alias("component")))
    marques = s.select(F.col("s_suppkey").alias("specialist_id"), F.concat(F.lit("make-"), (F.col("s_nationkey") % 5).cast("string")).alias("make"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("m "), (F.col("s_suppkey") % 4).cast("string"))).alias("model"))
    kinds = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "tuning").otherwise("servicing").alias("category"))
    found = fi.match_specialists(requests, kinds, marques, {"brakes": ["servicing"], "exhaust": ["servicing", "tuning"]})
    return fi.specialists_of(requests, found)


def ops_first_wins(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    parts = [s.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.lit("s").alias("part")), c.select((F.col("c_nationkey") + 10).alias("key"), F.col("c_custkey").alias("id"), F.lit("c").alias("part"))]
    return ing.first_wins(parts, "key", "id")


QUERIES = {
    "feature_arrays": feature_arrays, "feature_coverage": feature_coverage, "feature_terms": feature_terms, "feature_interests": feature_interests, "feature_interests_changed": feature_interests_changed, "feature_attributes": feature_attributes,
    "facets_union": facets_union, "source_missing": source_missing, "ops_latest": ops_latest, "image_states": image_states, "image_status": image_status, "image_display": image_display, "image_verdicts": image_verdicts, "video_flags": video_flags,
    "classify_entities": classify_entities, "source_sitemaps": source_sitemaps, "source_feeds": source_feeds, "parts_specialists": parts_specialists, "ops_first_wins": ops_first_wins,
}

_ENT = """ent AS (SELECT p_partkey // 3 AS article_id, p_partkey AS pos, kind, CASE kind WHEN 'make' THEN p_brand WHEN 'model' THEN 'M' || (p_size % 4) ELSE 'G' || (p_size % 5) END AS name, p_brand AS make
    FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'generation' WHEN 1 THEN 'model' ELSE 'make' END AS kind FROM part))"""
_MODE = "(['AIR', 'Reg Air', 'SHIP', 'MAIL', 'RAIL', 'Air'])[CAST(l_suppkey % 6 + 1 AS INTEGER)]"
_TAG = f"tag AS (SELECT l_partkey // 3 AS article_id, CASE WHEN l_linenumber % 2 = 1 THEN 'interests' ELSE 'categories' END AS kind, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 1 THEN {_MODE} ELSE l_returnflag || '/' || l_linestatus END AS value FROM lineitem)"
_LIST = lambda of, value, kind, name: f"coalesce(string_agg({value}, ',' ORDER BY pos, {value}) FILTER ({of}.kind = '{kind}'), '') AS {name}"
_NEW = "CASE lower(trim(value)) WHEN 'air' THEN 'Air' WHEN 'reg air' THEN 'Air' WHEN 'ship' THEN 'Sea' WHEN 'mail' THEN 'Mail' END"
_IMG = "'https://i.example.com/' || l_partkey || '.jpg'"
_STATES = f"""st AS (SELECT article_id, url, rank, CASE WHEN first IS NOT NULL AND n > greatest(first, 3) THEN 'pending' WHEN ok THEN 'ok' ELSE 'failed' END AS state, coalesce(n = first, false) AS is_primary FROM (SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY article_id) AS first FROM
    (SELECT l_orderkey AS article_id, {_IMG} AS url, l_linenumber AS rank, coalesce(p_size % 7 <> 0 AND p_size % 3 = 0, false) AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_IMG}) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)))"""
_UNDONE = lambda c: _DEC(f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')")
_H = lambda *names: "(" + " OR ".join(f"regexp_matches({{0}}, '(^|[^a-z0-9]){n}($|[^a-z0-9])')" for n in names) + ")"
_FOUND = ", ".join(f"{_H(*names).format('t')} AS {key}, {_H(*names).format('h')} AS {key}_h" for key, names in {"mk": ["sich", "schau"], "pa": ["para"], "ge": ["ment"], "va": ["las"], "th": ["ther", "here"], "sp": ["con", "que"]}.items())
_ENTITIES = f"""e0 AS (SELECT id, lower(coalesce(title, '')) AS h, lower(coalesce(title, '') || ' ' || coalesce(excerpt, '')) AS t FROM articles), e1 AS (SELECT id, {_FOUND} FROM e0), e2 AS (SELECT *, pa OR ge AS a, th AND mk AS b FROM e1)"""
ORACLE_SQL = {
    "feature_arrays": with_sql(["articles"], f"""WITH {_ENT}, {_TAG}, e AS (SELECT article_id, {_LIST('ent', 'name', 'make', 'makes')}, {_LIST('ent', 'name', 'model', 'models')}, {_LIST('ent', 'name', 'generation', 'generations')}, count(*) AS hits FROM ent GROUP BY 1),
        t AS (SELECT article_id, {_LIST('tag', 'value', 'interests', 'interests')}, {_LIST('tag', 'value', 'categories', 'categories')} FROM tag GROUP BY 1)
        SELECT id, coalesce(makes, '') AS makes, coalesce(models, '') AS models, coalesce(generations, '') AS generations, coalesce(interests, '') AS interests, coalesce(categories, '') AS categories, coalesce(hits, 0) AS hits FROM articles LEFT JOIN e ON e.article_id = id LEFT JOIN t ON t.article_id = id"""),
    "feature_coverage": with_sql(["articles"], f"WITH {_ENT}, e AS (SELECT article_id, bool_or(kind = 'make') AS a, bool_or(kind = 'model') AS b, bool_or(make = 'Brand#13') AS c, bool_or(make = 'Brand#13' AND kind = 'model') AS d FROM ent GROUP BY 1) SELECT count(*) AS articles, count(CASE WHEN a THEN 1 END) AS with_make, count(CASE WHEN b THEN 1 END) AS with_model, count(CASE WHEN c THEN 1 END) AS with_given_make, count(CASE WHEN d THEN 1 END) AS with_given_model FROM articles LEFT JOIN e ON article_id = id"),
    "feature_terms": with_sql(["articles"], f"WITH {_ENT}, {_TAG}, x AS (SELECT kind, value AS term FROM tag JOIN articles ON id = article_id UNION ALL SELECT 'makes', name FROM ent JOIN articles ON id = article_id WHERE kind = 'make'), c AS (SELECT kind, term, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS INTEGER) AS position FROM c) SELECT *, position <= 5 AS is_theme FROM r"),
    "feature_interests": f"WITH {_TAG} SELECT DISTINCT article_id, {_NEW} AS interest FROM tag WHERE kind = 'interests' AND {_NEW} IS NOT NULL",
    "feature_interests_changed": f"WITH {_TAG}, g AS (SELECT article_id, list_sort(list(value)) AS b, coalesce(list_sort(list(DISTINCT {_NEW}) FILTER ({_NEW} IS NOT NULL)), []) AS a FROM tag WHERE kind = 'interests' GROUP BY 1) SELECT article_id, array_to_string(a, ',') AS after FROM g WHERE a <> b",
    "feature_attributes": f"WITH r AS (SELECT l_partkey AS product_id, {_MODE} AS k, l_returnflag || l_linestatus AS v, l_orderkey * 8 + l_linenumber AS id FROM lineitem), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY product_id, k ORDER BY id DESC, v DESC) = 1) SELECT product_id, string_agg(k || '=' || v, ';' ORDER BY k) AS attributes FROM l GROUP BY 1",
    "facets_union": "WITH u AS (SELECT 0 AS o, p_brand AS make, p_type AS model FROM part UNION ALL SELECT 1, upper(p_brand), CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_name END FROM part) SELECT make, model FROM u QUALIFY row_number() OVER (PARTITION BY lower(make), lower(model) ORDER BY o, make, model) = 1",
    "source_missing": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)",
    "ops_latest": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "image_states": f"WITH {_STATES} SELECT * FROM st",
    "image_status": f"WITH {_STATES}, g AS (SELECT article_id, max(CASE WHEN is_primary THEN url END) AS primary_url FROM st GROUP BY 1) SELECT o_orderkey AS article_id, primary_url, CASE WHEN article_id IS NULL THEN 'missing' WHEN primary_url IS NULL THEN 'failed' ELSE 'ok' END AS image_status FROM orders LEFT JOIN g ON article_id = o_orderkey",
    "image_display": "WITH u AS (SELECT o_orderkey, 'https://i.example.com/' || (o_orderkey % 3) || '/a.jpg' AS a, 'https://i.example.com/' || (o_orderkey % 2) || '/b.jpg' AS b FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN a || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',' || b END WHEN o_orderkey % 7 <> 0 THEN a || ',' || b ELSE b || ',' || a END AS images FROM u",
    "image_verdicts": "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS s, l_linenumber % 4 AS k, l_quantity * 100 AS n FROM lineitem), v AS (SELECT *, CASE WHEN s = 2 THEN 'hotlink_or_forbidden' WHEN s = 3 THEN 'missing' WHEN s = 4 THEN 'http_500' WHEN k = 1 THEN 'svg' WHEN k <> 0 THEN 'not_image' WHEN n < 1500 THEN 'too_small' ELSE 'ok' END AS verdict FROM x) SELECT l_orderkey, l_linenumber, verdict, verdict = 'ok' AS ok FROM v",
    "video_flags": with_sql(["articles"], "SELECT id, id % 4 = 0 OR id % 6 = 1 AS video, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'Excellent' WHEN id % 3 = 0 THEN 'excellent reach' WHEN id % 3 = 1 THEN 'Good' END AS relevance FROM articles"),
    "classify_entities": with_sql(["articles"], f"""WITH {_ENTITIES} SELECT id AS article_id, 'make' AS kind, 'Sich' AS name, mk_h AS in_title, CASE WHEN mk THEN 92 ELSE 80 END AS confidence FROM e2 WHERE mk OR a OR b
        UNION ALL SELECT id, 'model', 'Para', pa_h OR ge_h, CASE WHEN pa THEN 86 ELSE 82 END FROM e2 WHERE a UNION ALL SELECT id, 'generation', 'ment', ge_h, 90 FROM e2 WHERE ge UNION ALL SELECT id, 'variant', 'las', va_h, 80 FROM e2 WHERE a AND va
        UNION ALL SELECT id, 'variant', 'Para Special', sp_h, 71 FROM e2 WHERE a AND sp UNION ALL SELECT id, 'model', 'Ther', th_h, 86 FROM e2 WHERE b"""),
    "source_sitemaps": "SELECT DISTINCT CAST(page_id % 40 AS VARCHAR) AS source_id, trim(url) AS url FROM pages WHERE url IS NOT NULL",
    "source_feeds": with_sql(["articles"], f"""WITH t AS (SELECT id, url, trim(regexp_replace({_UNDONE("title")}, '\\s+', ' ', 'g')) AS title, trim(regexp_replace({_UNDONE("excerpt")}, '\\s+', ' ', 'g')) AS html FROM articles WHERE id IS NOT NULL),
        s AS (SELECT *, {STRIP} AS t FROM t), c AS (SELECT *, substr(t, 1, 320) AS k FROM s), d AS (SELECT *, CASE WHEN contains(k, ' ') THEN length(k) - instr(reverse(k), ' ') ELSE -1 END AS sp FROM c)
        SELECT CAST(id % 50 AS VARCHAR) AS source_id, CAST(id AS VARCHAR) AS guid, title, replace(url, '?utm_source=feed', '') AS canonical_url, epoch_ms(TIMESTAMP '2024-01-01 10:00:00') + (id % 28) * 86400000 AS published_at,
            md5(CASE WHEN length(t) <= 320 THEN t ELSE trim(CASE WHEN sp > 80 THEN substr(k, 1, sp) ELSE k END) || '…' END) AS excerpt_md5 FROM d WHERE title <> ''"""),
    "parts_specialists": "SELECT DISTINCT c_custkey AS request_id, s_suppkey AS specialist_id FROM customer JOIN supplier ON c_nationkey % 5 = s_nationkey % 5 AND (s_suppkey % 3 = 0 OR s_suppkey % 4 = c_custkey % 4) WHERE c_custkey % 2 = 1 OR s_suppkey % 2 = 1",
    "ops_first_wins": "WITH u AS (SELECT s_nationkey AS key, s_suppkey AS id, 's' AS part, 0 AS p FROM supplier UNION ALL SELECT c_nationkey + 10, c_custkey, 'c', 1 FROM customer) SELECT key, id, part FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, id) = 1",
}
