"""Registered queries: the streaming jobs in batch form, and page readers, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.sources import readers as rd
from millrace.streaming import jobs

from .content_queries import CANON, STRIP
from .derived import engagement_events, read, with_sql


def validated(spark, sf_dir):
    e = engagement_events(spark, sf_dir)
    odd = F.when(F.col("id") % 11 == 0, F.lit("pageview")).otherwise(F.col("event"))
    payload = F.to_json(F.struct(odd.alias("event"), F.when(F.col("id") % 13 != 0, F.col("article_id")).otherwise(-F.col("article_id")).alias("articleId"), F.when(F.col("id") % 17 != 0, F.col("surface")).alias("surface"), F.col("cohort"), F.col("detail")))
    rows = jobs.validate_events(e.select("visitor_key", "created_at", payload.alias("payload")))
    return rows.groupBy("event", "error").agg(F.count("*").alias("n"), F.countDistinct("article_id").alias("articles"))


def impressions(spark, sf_dir):
    e = engagement_events(spark, sf_dir).withColumn("day_utc", F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd"))
    return jobs.dedup_impressions(e).groupBy("event", "day_utc").agg(F.count("*").alias("n"))


def daily_uniques(spark, sf_dir):
    return jobs.daily_uniques(engagement_events(spark, sf_dir))


def rate_limit(spark, sf_dir):
    # attempts come in bursts: times are squeezed so that the limit is met
    e = engagement_events(spark, sf_dir).withColumn("created_at", F.floor(F.col("created_at") / 400).cast("long"))
    return jobs.rate_limit(e)


def marks(spark, sf_dir):
    e = engagement_events(spark, sf_dir).filter("event in ('interested', 'less_like_this', 'save')")
    return jobs.toggle_marks(e.select("visitor_key", "article_id", F.when(F.col("event") == "less_like_this", "less").otherwise("interested").alias("polarity"), F.col("created_at").alias("at"), "id"))


def page_metadata(spark, sf_dir):
    return rd.page_metadata(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "title", "canonical_url")


def page_links(spark, sf_dir):
    return rd.page_links(read(spark, sf_dir, "pages")).groupBy("url").agg(F.count("*").alias("links"))


QUERIES = {"stream_validated": validated, "stream_impressions": impressions, "stream_daily_uniques": daily_uniques, "stream_rate_limit": rate_limit, "stream_marks": marks, "source_page_metadata": page_metadata, "source_page_links": page_links}
_RATE = "('impression', 'story_open', 'outbound', 'save', 'share', 'interested', 'less_like_this')"
_PAGE = "regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+[^?#\\s]*(\\?[^#\\s]*)?(#\\S*)?$')"
ORACLE_SQL = {
    "source_page_metadata": f"WITH t AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS html FROM pages), m AS (SELECT page_id, {STRIP} AS title, CASE WHEN {_PAGE} THEN {CANON} END AS canonical_url FROM t) SELECT * FROM m WHERE title <> ''",
    "source_page_links": f"""WITH h AS (SELECT url AS page, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"''#]+)', 1)) AS t FROM pages WHERE url IS NOT NULL),
        f AS (SELECT page, regexp_extract(page, '^([a-zA-Z]+://[^/?#]+)', 1) || t AS url FROM h WHERE t LIKE '/%'), c AS (SELECT DISTINCT page, {CANON} AS link FROM f WHERE {_PAGE}) SELECT page AS url, count(*) AS links FROM c GROUP BY 1""",
    "stream_validated": with_sql(["ev"], """WITH p AS (SELECT CASE WHEN id % 11 = 0 THEN 'pageview' ELSE event END AS event, CASE WHEN event = 'experience_feedback' OR id % 11 = 0 THEN NULL ELSE article_id END AS a, id % 13 = 0 AS neg, id % 17 = 0 AS nos, article_id IS NOT NULL AS given FROM ev),
        q AS (SELECT event, a, CASE WHEN event = 'pageview' THEN 'unknown_event' WHEN event = 'impression' AND nos THEN 'unknown_surface' WHEN event = 'impression' AND neg THEN 'no_articles' WHEN event <> 'impression' AND given AND neg THEN 'bad_article' END AS error FROM p)
        SELECT event, error, count(*) AS n, count(DISTINCT CASE WHEN error IS NULL THEN a END) AS articles FROM q GROUP BY 1, 2"""),
    "stream_impressions": with_sql(["ev"], "WITH d AS (SELECT DISTINCT event, visitor_key, article_id, own_day, surface FROM ev WHERE event = 'impression'), u AS (SELECT event, own_day FROM d UNION ALL SELECT event, own_day FROM ev WHERE event <> 'impression') SELECT event, own_day AS day_utc, count(*) AS n FROM u GROUP BY 1, 2"),
    "stream_daily_uniques": with_sql(["touches"], "SELECT day, article_id, count(CASE WHEN event = 'impression' THEN 1 END) AS impression_uniques, count(CASE WHEN event = 'story_open' THEN 1 END) AS open_uniques, count(CASE WHEN event = 'outbound' THEN 1 END) AS outbound_uniques, count(CASE WHEN event = 'save' THEN 1 END) AS save_uniques, count(CASE WHEN event = 'share' THEN 1 END) AS share_uniques, count(CASE WHEN event = 'interested' THEN 1 END) AS interested_uniques, count(CASE WHEN event = 'less_like_this' THEN 1 END) AS less_like_uniques FROM touches GROUP BY 1, 2"),
}
