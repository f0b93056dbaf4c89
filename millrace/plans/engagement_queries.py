"""Registered queries: engagement analytics on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import engagement as en
from millrace.operators import uniques as un
from millrace.storage import written

from .derived import INTERESTS, NOW_DAY, NOW_MS, dims, engagement_events, with_sql

DAYS = 14
WINDOW = en.desk_window(DAYS, NOW_DAY)
START, END, PSTART, PEND = WINDOW["start"], WINDOW["end"], WINDOW["previous_start"], WINDOW["previous_end"]
_RATES = [c.replace("_uniques", "_rate") for c in en.COUNTERS if c != "impression_uniques"]


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = engagement_events(spark, sf_dir)
    return events, en.daily_touches(events), en.visitor_first(events)


def visitor_first(spark, sf_dir):
    return en.visitor_first(engagement_events(spark, sf_dir))


def daily_touches(spark, sf_dir):
    return en.daily_touches(engagement_events(spark, sf_dir))


def daily_articles(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    return en.daily_articles(touches, first)


def daily_dims(spark, sf_dir):
    events, touches, first = _base(spark, sf_dir)
    return en.daily_dims(touches, dims(spark, sf_dir), first, events)


def window_articles(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    return en.window_articles(touches, first, START, END)


def window_dims(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    return en.window_dims(touches, dims(spark, sf_dir), first, START, END)


def window_feedback(spark, sf_dir):
    return en.window_feedback(en.feedback_dims(engagement_events(spark, sf_dir)), START, END)


def site_overview(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    return en.overview(touches, first, START, END)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def exposure_rates(spark, sf_dir):
    found = en.exposure_rates(window_articles(spark, sf_dir))
    return _rounded(found, [*_RATES, "weighted_score"]).withColumn("open_rate_text", en.format_rate(F.col("open_rate")))


def open_rate_rank(spark, sf_dir):
    found = en.rank_by_open_rate(en.exposure_rates(window_articles(spark, sf_dir)), "article_id")
    return found.select("article_id", "impression_uniques", F.round("open_rate", 9).alias("open_rate"), "is_ranked", "position")


def emerging_interests(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    d = dims(spark, sf_dir)
    found = en.emerging(en.window_dims(touches, d, first, START, END), en.window_dims(touches, d, first, PSTART, PEND), INTERESTS)
    return found.select("dim_value", "impression_uniques", "previous_impressions", F.round("open_rate", 9).alias("open_rate"), F.round("open_rate_delta", 9).alias("open_rate_delta"), "sufficient_both", "position")


def desk_statements(spark, sf_dir):
    _, touches, first = _base(spark, sf_dir)
    d = dims(spark, sf_dir)
    current = en.window_dims(touches, d, first, START, END)
    rising = en.emerging(current, en.window_dims(touches, d, first, PSTART, PEND), INTERESTS)
    return en.desk_statements(en.exposure_rates(current), rising, en.exposure_rates(en.window_articles(touches, first, START, END)), DAYS)


def trending_scores(spark, sf_dir):
    return en.trending_scores(engagement_events(spark, sf_dir))


def trending(spark, sf_dir):
    return en.trending(engagement_events(spark, sf_dir), NOW_MS)


def trending_articles(spark, sf_dir):
    return en.trending_articles(engagement_events(spark, sf_dir), NOW_MS)


def community_list(spark, sf_dir):
    events = engagement_events(spark, sf_dir)
    top = en.top_articles(events).withColumn("position", F.col("article_id"))
    eligible = dims(spark, sf_dir).filter("article_id % 3 != 0").select("article_id").distinct()
    return en.community_list(en.trending_articles(events, NOW_MS), top, eligible)


def cohort_labels(spark, sf_dir):
    return en.cohort_labels(engagement_events(spark, sf_dir))


def event_report(spark, sf_dir):
    return en.event_report(engagement_events(spark, sf_dir))


def top_articles(spark, sf_dir):
    return en.top_articles(engagement_events(spark, sf_dir))


def rate_limited(spark, sf_dir):
    return en.rate_limited(engagement_events(spark, sf_dir), NOW_MS - 86_400_000)


def rolling_writes(spark, sf_dir):
    return en.rolling_writes(engagement_events(spark, sf_dir)).select("id", "visitor_key", "writes_before")


def recent_interactions(spark, sf_dir):
    return en.recent_interactions(engagement_events(spark, sf_dir))


def retained_events(spark, sf_dir):
    return en.retained(engagement_events(spark, sf_dir), "2024-04-14").groupBy("event").agg(F.count("*").alias("n"))


def visit_sessions(spark, sf_dir):
    visits = engagement_events(spark, sf_dir).select("visitor_key", F.floor(F.col("created_at") / 86_400_000).alias("session_id"))
    return en.visit_sessions(visits)


def _stored(spark, sf_dir):
    """Bitmaps by day, stored as a nightly job would."""
    _, touches, first = _base(spark, sf_dir)
    touches = written(touches, "touches")
    numbers = written(un.visitor_numbers(touches), "numbers")
    return touches, numbers, written(un.daily_article_bitmaps(touches, numbers), "article_bitmaps"), written(un.first_day_bitmaps(first, numbers), "first_bitmaps")


def stored_articles(spark, sf_dir):
    _, _, by_article, firsts = _stored(spark, sf_dir)
    return un.window_articles(by_article, firsts, START, END)


def stored_dims(spark, sf_dir):
    touches, numbers, by_article, firsts = _stored(spark, sf_dir)
    d = dims(spark, sf_dir)
    return un.window_dims(written(un.daily_dim_bitmaps(touches, d, numbers), "dim_bitmaps"), by_article, d, firsts, START, END)


def stored_overview(spark, sf_dir):
    touches, numbers, _, firsts = _stored(spark, sf_dir)
    return un.overview(un.daily_dim_bitmaps(touches, dims(spark, sf_dir), numbers), firsts, START, END)


def sketched_dims(spark, sf_dir):
    """Unique visitors of each dimension and event, exact, and whether the estimate is within four standard errors (or one visitor)."""
    _, touches, _ = _base(spark, sf_dir)
    d = dims(spark, sf_dir)
    guessed = un.window_estimates(un.daily_dim_sketches(touches, d), START, END)
    exact = en._fan_out(en.window_touches(touches, START, END), d).select("dim_kind", "dim_value", "visitor_key", "event").distinct().groupBy("dim_kind", "dim_value", "event").agg(F.count("*").alias("exact"))
    near = F.abs(F.col("uniques") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 4 * un.SKETCH_ERROR)
    return exact.join(guessed, ["dim_kind", "dim_value", "event"]).select("dim_kind", "dim_value", "event", "exact", near.alias("near"))


QUERIES = {
    "engagement_stored_articles": stored_articles, "engagement_stored_dims": stored_dims, "engagement_stored_overview": stored_overview, "engagement_sketched_dims": sketched_dims,
    "engagement_visitor_first": visitor_first, "engagement_daily_touches": daily_touches, "engagement_daily_articles": daily_articles, "engagement_daily_dims": daily_dims,
    "engagement_window_articles": window_articles, "engagement_window_dims": window_dims, "engagement_window_feedback": window_feedback, "engagement_overview": site_overview,
    "engagement_exposure_rates": exposure_rates, "engagement_open_rate_rank": open_rate_rank, "engagement_emerging": emerging_interests, "engagement_desk_statements": desk_statements,
    "engagement_trending_scores": trending_scores, "engagement_trending": trending, "engagement_trending_articles": trending_articles, "engagement_community": community_list, "engagement_cohort_labels": cohort_labels,
    "engagement_event_report": event_report, "engagement_top_articles": top_articles, "engagement_rate_limited": rate_limited, "engagement_rolling_writes": rolling_writes,
    "engagement_recent": recent_interactions, "engagement_retained": retained_events, "engagement_sessions": visit_sessions,
}


def _counts(returning: str, of: str = "*") -> str:
    one = lambda c: f"count(DISTINCT CASE WHEN {c} THEN visitor_key END)" if of == "v" else f"count(CASE WHEN {c} THEN 1 END)"
    cells = [f"{one(f"event = '{e}'")} AS {n}" for e, n in en.RATE_EVENTS.items()]
    return ", ".join([*cells, f"{one(f"event = 'impression' AND {returning}")} AS returning_uniques"])


_FAN = "SELECT t.*, d.dim_kind, d.dim_value FROM {0} t JOIN dims d USING (article_id) UNION ALL SELECT *, 'site', 'all' FROM {0}"
_WT = f"wt AS (SELECT DISTINCT article_id, visitor_key, event FROM touches WHERE day BETWEEN '{START}' AND '{END}')"
_PT = f"pt AS (SELECT DISTINCT article_id, visitor_key, event FROM touches WHERE day BETWEEN '{PSTART}' AND '{PEND}')"
_WA = f"wa AS (SELECT article_id, {_counts(f"first_day < '{START}'")} FROM wt LEFT JOIN firsts USING (visitor_key) GROUP BY 1)"


def _dim_sql(name: str, touches: str, start: str) -> str:
    return f"{name}_f AS ({_FAN.format(touches)}), {name} AS (SELECT dim_kind, dim_value, {_counts(f"first_day < '{start}'", 'v')}, count(*) AS event_count FROM {name}_f LEFT JOIN firsts USING (visitor_key) GROUP BY 1, 2)"


_RATE = ", ".join(f"CAST({c} AS DOUBLE) / nullif(impression_uniques, 0) AS {r}" for c, r in zip([c for c in en.COUNTERS if c != "impression_uniques"], _RATES, strict=True))
_SCORE = "interested_rate * 3 + save_rate * 2 + share_rate * 2 + outbound_rate - less_like_rate * 2"
_FB = """fb AS (SELECT coalesce(day_utc, own_day) AS day, visitor_key, unnest(CASE WHEN split_part(coalesce(detail, ''), ':', 1) <> '' AND split_part(coalesce(detail, ''), ':', 2) <> ''
    THEN ['rating:' || split_part(detail, ':', 1), 'reason:' || split_part(detail, ':', 2), 'theme:' || split_part(detail, ':', 1) || '/' || split_part(detail, ':', 2)]
    ELSE ['theme:unspecified'] END) AS dim_value FROM ev WHERE event = 'experience_feedback'),
    fd AS (SELECT day, 'feedback' AS dim_kind, dim_value, count(DISTINCT visitor_key) AS impression_uniques, count(*) AS event_count FROM fb GROUP BY 1, 2, 3)"""
_FMT = lambda x: f"(regexp_replace(printf('%.1f', floor({x} * 1000 + 0.5) / 10), '\\.0$', '') || '%')"
_EMERGING = f"{_WT}, {_PT}, {_dim_sql('cd', 'wt', START)}, {_dim_sql('pd', 'pt', PSTART)}, em AS (SELECT c.dim_value, c.impression_uniques, p.impression_uniques AS previous_impressions, CAST(c.open_uniques AS DOUBLE) / nullif(c.impression_uniques, 0) AS open_rate, CAST(c.open_uniques AS DOUBLE) / nullif(c.impression_uniques, 0) - CAST(p.open_uniques AS DOUBLE) / nullif(p.impression_uniques, 0) AS open_rate_delta, c.impression_uniques >= 8 AND coalesce(p.impression_uniques >= 8, false) AS sufficient_both FROM cd c LEFT JOIN pd p ON p.dim_kind = c.dim_kind AND p.dim_value = c.dim_value WHERE c.dim_kind = 'interest')"
_SCORED = """sc AS (SELECT article_id, count(CASE WHEN event = 'interested' THEN 1 END) AS interested, count(CASE WHEN event = 'save' THEN 1 END) AS save, count(CASE WHEN event = 'share' THEN 1 END) AS share,
    count(CASE WHEN event = 'outbound' THEN 1 END) AS outbound, count(CASE WHEN event = 'less_like_this' THEN 1 END) AS less_like_this,
    CAST(sum(CASE event WHEN 'interested' THEN 3 WHEN 'save' THEN 2 WHEN 'share' THEN 2 WHEN 'outbound' THEN 1 ELSE -2 END) AS BIGINT) AS score, count(DISTINCT visitor_key) AS unique_visitors
    FROM {0} WHERE event IN ('interested', 'save', 'share', 'outbound', 'less_like_this') AND coalesce(article_id, 0) <> 0 GROUP BY 1)"""
_RECENT7 = f"r7 AS (SELECT * FROM ev WHERE created_at >= {NOW_MS - 7 * en.DAY_MS})"
_TREND = f"{_RECENT7}, {_SCORED.format('r7')}, q AS (SELECT count(*) AS articles_observed, list(article_id ORDER BY score DESC, unique_visitors DESC, article_id) AS ids FROM sc WHERE score > 0 AND unique_visitors >= 5), s AS (SELECT count(DISTINCT visitor_key) AS visitors, count(CASE WHEN event IN ('interested', 'save', 'share', 'outbound') AND coalesce(article_id, 0) <> 0 THEN 1 END) AS positive_events FROM r7), tr AS (SELECT *, visitors >= 8 AND positive_events >= 12 AND articles_observed >= 3 AS open FROM s, q)"
_LINE = lambda what, k, tail="": f"'{what} ' || {k} || ': ' || {_FMT('open_rate')} || ' of impressions led to an opening (' || impression_uniques || ' visitors in {DAYS} days){tail}'"
_BEST = lambda d: f"ORDER BY open_rate {d}, impression_uniques {d} LIMIT 1"

ORACLE_SQL = {
    "engagement_visitor_first": with_sql(["firsts"], "SELECT * FROM firsts"),
    "engagement_daily_touches": with_sql(["touches"], "SELECT * FROM touches"),
    "engagement_daily_articles": with_sql(["touches", "firsts"], f"SELECT day, article_id, {_counts('first_day < day')} FROM touches LEFT JOIN firsts USING (visitor_key) GROUP BY 1, 2"),
    "engagement_daily_dims": with_sql(["touches", "firsts", "dims"], f"WITH f AS ({_FAN.format('touches')}), {_FB} SELECT day, dim_kind, dim_value, {_counts('first_day < day', 'v')}, count(*) AS event_count FROM f LEFT JOIN firsts USING (visitor_key) GROUP BY 1, 2, 3 UNION ALL SELECT day, dim_kind, dim_value, impression_uniques, 0, 0, 0, 0, 0, 0, 0, event_count FROM fd"),
    "engagement_stored_articles": with_sql(["touches", "firsts"], f"WITH {_WT}, {_WA} SELECT * FROM wa"),
    "engagement_stored_dims": with_sql(["touches", "firsts", "dims"], f"WITH {_WT}, {_dim_sql('cd', 'wt', START)} SELECT * FROM cd"),
    "engagement_stored_overview": with_sql(["touches", "firsts"], f"WITH w AS (SELECT * FROM touches LEFT JOIN firsts USING (visitor_key) WHERE day BETWEEN '{START}' AND '{END}') SELECT {_counts(f"first_day < '{START}'", 'v')} FROM w"),
    "engagement_sketched_dims": with_sql(["touches", "dims"], f"WITH {_WT}, f AS ({_FAN.format('wt')}) SELECT dim_kind, dim_value, event, count(DISTINCT visitor_key) AS exact, true AS near FROM f GROUP BY 1, 2, 3"),
    "engagement_window_articles": with_sql(["touches", "firsts"], f"WITH {_WT}, {_WA} SELECT * FROM wa"),
    "engagement_window_dims": with_sql(["touches", "firsts", "dims"], f"WITH {_WT}, {_dim_sql('cd', 'wt', START)} SELECT * FROM cd"),
    "engagement_window_feedback": with_sql(["ev"], f"WITH {_FB} SELECT dim_kind, dim_value, CAST(sum(impression_uniques) AS BIGINT) AS impression_uniques, CAST(sum(event_count) AS BIGINT) AS event_count FROM fd WHERE day BETWEEN '{START}' AND '{END}' GROUP BY 1, 2"),
    "engagement_overview": with_sql(["touches", "firsts"], f"WITH w AS (SELECT * FROM touches LEFT JOIN firsts USING (visitor_key) WHERE day BETWEEN '{START}' AND '{END}') SELECT {_counts(f"first_day < '{START}'", 'v')} FROM w"),
    "engagement_exposure_rates": with_sql(["touches", "firsts"], f"WITH {_WT}, {_WA}, r AS (SELECT *, {_RATE}, impression_uniques >= 8 AS sufficient FROM wa) SELECT article_id, {', '.join(en.COUNTERS)}, {', '.join(f'round({r}, 9) AS {r}' for r in _RATES)}, sufficient, round(CASE WHEN sufficient THEN {_SCORE} END, 9) AS weighted_score, CASE WHEN open_rate IS NULL THEN '—' ELSE {_FMT('open_rate')} END AS open_rate_text FROM r"),
    "engagement_open_rate_rank": with_sql(["touches", "firsts"], f"WITH {_WT}, {_WA}, r AS (SELECT *, {_RATE}, impression_uniques >= 8 AS is_ranked FROM wa) SELECT article_id, impression_uniques, round(open_rate, 9) AS open_rate, is_ranked, CAST(row_number() OVER (PARTITION BY is_ranked ORDER BY CASE WHEN is_ranked THEN coalesce(open_rate, 0) ELSE 0 END DESC, impression_uniques DESC, article_id) AS INTEGER) AS position FROM r"),
    "engagement_emerging": with_sql(["touches", "firsts", "dims"], f"WITH {_EMERGING} SELECT dim_value, impression_uniques, previous_impressions, round(open_rate, 9) AS open_rate, round(open_rate_delta, 9) AS open_rate_delta, sufficient_both, CAST(row_number() OVER (ORDER BY sufficient_both DESC, open_rate_delta DESC NULLS LAST, dim_value) AS INTEGER) AS position FROM em"),
    "engagement_desk_statements": with_sql(["touches", "firsts", "dims"], f"""WITH {_EMERGING}, {_WA},
        pr AS (SELECT dim_value AS k, impression_uniques, CAST(open_uniques AS DOUBLE) / nullif(impression_uniques, 0) AS open_rate FROM cd WHERE dim_kind = 'publisher' AND impression_uniques >= 8),
        ar AS (SELECT CAST(article_id AS VARCHAR) AS k, impression_uniques, CAST(open_uniques AS DOUBLE) / nullif(impression_uniques, 0) AS open_rate FROM wa WHERE impression_uniques >= 8),
        pt1 AS (SELECT * FROM pr {_BEST('DESC')}), pt2 AS (SELECT * FROM pr {_BEST('ASC')}), at1 AS (SELECT * FROM ar {_BEST('DESC')}), at2 AS (SELECT * FROM ar {_BEST('ASC')})
        SELECT 0 AS line_no, {_LINE('Publisher', 'k')} AS statement FROM pt1 UNION ALL SELECT 1, {_LINE('Publisher', 'k', ', the least with enough data')} FROM pt2 WHERE k <> (SELECT k FROM pt1)
        UNION ALL SELECT 2, * FROM (SELECT 'Interest ' || dim_value || ' is opened more often, by ' || {_FMT('open_rate_delta')} || ' of impressions (' || impression_uniques || ' visitors in {DAYS} days)' FROM em WHERE sufficient_both AND open_rate_delta > 0 ORDER BY open_rate_delta DESC, dim_value LIMIT 1)
        UNION ALL SELECT 3, {_LINE('Article', 'k')} FROM at1 UNION ALL SELECT 4, {_LINE('Article', 'k', ', the least with enough data')} FROM at2 WHERE k <> (SELECT k FROM at1)"""),
    "engagement_trending_scores": with_sql(["ev"], f"WITH {_SCORED.format('ev')} SELECT * FROM sc"),
    "engagement_trending": with_sql(["ev"], f"WITH {_TREND} SELECT CASE WHEN open THEN 'trending' ELSE 'discover' END AS mode, visitors, positive_events, articles_observed, CASE WHEN NOT open THEN 'thin data: ' || visitors || ' visitors, ' || positive_events || ' positive events, ' || articles_observed || ' articles' END AS reason FROM tr"),
    "engagement_trending_articles": with_sql(["ev"], f"WITH {_TREND} SELECT article_id, score, unique_visitors FROM sc WHERE score > 0 AND unique_visitors >= 5 AND (SELECT open FROM tr)"),
    "engagement_community": with_sql(["ev", "dims"], f"""WITH {_TREND}, tl AS (SELECT unnest(ids) AS article_id, generate_subscripts(ids, 1) AS slot FROM tr WHERE open), te AS (SELECT 'trending' AS source, slot, article_id FROM tl WHERE article_id IN (SELECT article_id FROM dims WHERE article_id % 3 <> 0)),
        di AS (SELECT 'discover' AS source, article_id AS slot, article_id FROM (SELECT article_id, count(*) AS n FROM ev WHERE article_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, article_id LIMIT 12)),
        al AS (SELECT * FROM te UNION ALL SELECT * FROM di WHERE NOT EXISTS (SELECT 1 FROM te)), nu AS (SELECT source, CAST(row_number() OVER (ORDER BY slot) AS INTEGER) AS position, article_id FROM al) SELECT * FROM nu WHERE position <= 4"""),
    "engagement_cohort_labels": with_sql(["ev"], "WITH c AS (SELECT cohort FROM ev WHERE cohort IS NOT NULL AND cohort <> '' GROUP BY 1 HAVING count(DISTINCT visitor_key) >= 8), m AS (SELECT cohort, article_id, count(DISTINCT visitor_key) AS visitors FROM ev WHERE event IN ('interested', 'save') AND article_id IS NOT NULL AND cohort IN (SELECT cohort FROM c) GROUP BY 1, 2 HAVING count(DISTINCT visitor_key) >= 5) SELECT article_id, cohort, visitors FROM m QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY visitors DESC, cohort) = 1"),
    "engagement_event_report": with_sql(["ev"], "SELECT event, n, CAST(row_number() OVER (ORDER BY n DESC, event) AS INTEGER) AS position FROM (SELECT event, count(*) AS n FROM ev GROUP BY 1)"),
    "engagement_top_articles": with_sql(["ev"], "SELECT article_id, count(*) AS n FROM ev WHERE article_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, article_id LIMIT 12"),
    "engagement_rate_limited": with_sql(["ev"], f"SELECT visitor_key, count(*) AS writes, count(*) >= 40 AS limited FROM ev WHERE created_at >= {NOW_MS - 86_400_000 - en.WRITE_WINDOW_MS} GROUP BY 1"),
    "engagement_rolling_writes": with_sql(["ev"], f"SELECT id, visitor_key, count(*) OVER (PARTITION BY visitor_key ORDER BY created_at RANGE BETWEEN {en.WRITE_WINDOW_MS} PRECEDING AND CURRENT ROW) - 1 AS writes_before FROM ev"),
    "engagement_recent": with_sql(["ev"], "WITH r AS (SELECT visitor_key, article_id, event, max(created_at) AS seen_at FROM ev WHERE article_id IS NOT NULL GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY visitor_key ORDER BY seen_at DESC, article_id, event) AS INTEGER) AS position FROM r) WHERE position <= 30"),
    "engagement_retained": with_sql(["ev"], "SELECT event, count(*) AS n FROM ev WHERE created_at >= epoch_ms(TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1"),
    "engagement_sessions": with_sql(["ev"], "SELECT visitor_key, count(DISTINCT created_at // 86400000) AS sessions, count(DISTINCT created_at // 86400000) >= 3 AS eligible FROM ev GROUP BY 1"),
}
