"""Engagement analytics: raw events to distinct daily touches, unique-visitor rollups, rates, trends and reports.

Events have: id, event, article_id, visitor_key, cohort, created_at (epoch ms), day_utc, surface, detail.
Every function takes and returns DataFrames; times are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered
from millrace.storage import sized_broadcast

#: Events that make touches, in the order of their counters.
RATE_EVENTS = {"impression": "impression_uniques", "story_open": "open_uniques", "outbound": "outbound_uniques", "save": "save_uniques", "share": "share_uniques", "interested": "interested_uniques", "less_like_this": "less_like_uniques"}
#: Weights of score events, and the floors of rates and of the trending gate.
WEIGHTS = {"interested": 3, "save": 2, "share": 2, "outbound": 1, "less_like_this": -2}
POSITIVE_EVENTS = ["interested", "save", "share", "outbound"]
IMPRESSION_FLOOR, ARTICLE_VISITORS, GATE_VISITORS, GATE_POSITIVE, GATE_ARTICLES = 8, 5, 8, 12, 3
COHORT_VISITORS, COHORT_ARTICLE_VISITORS = 8, 5
RETENTION_DAYS, TRENDING_DAYS = 90, 7
WRITE_WINDOW_MS, WRITE_LIMIT = 10 * 60 * 1000, 40
DAY_MS = 86_400_000
WINDOWS = (7, 14, 28)
COUNTERS = [*RATE_EVENTS.values(), "returning_uniques"]


# -- days and windows -------------------------------------------------------------------------------------------------
def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def event_day(day: str = "day_utc", ms: str = "created_at") -> Column:
    """The stored UTC day, else the day of the time stamp."""
    return F.coalesce(F.col(day), utc_day(F.col(ms)))


def add_days(day: str, n: int) -> str:
    import datetime

    return (datetime.date.fromisoformat(day) + datetime.timedelta(days=n)).isoformat()


def desk_window(days: int, end_day: str) -> dict[str, str]:
    """The window of so many days (7, 14 or 28; else 7) that ends on a day, and the one right before it; all inclusive."""
    days = days if days in WINDOWS else 7
    start = add_days(end_day, 1 - days)
    return {"start": start, "end": end_day, "previous_start": add_days(start, -days), "previous_end": add_days(start, -1)}


def retention_cutoff(now_day: str, days: int = RETENTION_DAYS) -> str:
    return add_days(now_day, -days)


def retained(events: DataFrame, now_day: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Raw rows from UTC midnight of the cutoff day on."""
    return events.filter(F.col("created_at") >= F.unix_millis(F.to_timestamp(F.lit(retention_cutoff(now_day, days)))))


# -- touches and rollups ----------------------------------------------------------------------------------------------
def visitor_first(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(visitor_key, first_day) over impressions of articles, merged with known first days by the earlier."""
    rows = events.filter((F.col("event") == "impression") & F.col("article_id").isNotNull()).select("visitor_key", event_day().alias("first_day"))
    rows = rows if known is None else rows.unionByName(known.select("visitor_key", "first_day"))
    return rows.groupBy("visitor_key").agg(F.min("first_day").alias("first_day"))


def daily_touches(events: DataFrame) -> DataFrame:
    """Distinct (day, article_id, visitor_key, event) of the rate events."""
    rows = events.filter(F.col("event").isin(*RATE_EVENTS) & F.col("article_id").isNotNull())
    return rows.select(event_day().alias("day"), "article_id", "visitor_key", "event").distinct()


def _counters(returning: Column, distinct: bool = False) -> list[Column]:
    one = (lambda c: F.countDistinct(F.when(c, F.col("visitor_key")))) if distinct else (lambda c: F.count(F.when(c, 1)))
    counts = [one(F.col("event") == e).alias(name) for e, name in RATE_EVENTS.items()]
    return [*counts, one((F.col("event") == "impression") & returning).alias("returning_uniques")]


def daily_articles(touches: DataFrame, first: DataFrame) -> DataFrame:
    """Per (day, article_id): unique visitors by event; touches are distinct, so counting is enough."""
    joined = touches.join(first, "visitor_key", "left")
    return joined.groupBy("day", "article_id").agg(*_counters(F.col("first_day") < F.col("day")))


def article_dims(articles: DataFrame, interests: DataFrame, entities: DataFrame, primary: DataFrame, known_interests: list[str] | None = None) -> DataFrame:
    """Distinct (article_id, dim_kind, dim_value): known interests, marques, section and publisher; blanks dropped."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wanted = interests if known_interests is None else interests.filter(F.col("interest").isin(*known_interests))
    parts = [
        wanted.select("article_id", F.lit("interest").alias("dim_kind"), F.col("interest").alias("dim_value")),
        entities.filter(F.col("kind") == "make").select("article_id", F.lit("marque").alias("dim_kind"), squeeze(F.coalesce("make", "name")).alias("dim_value")),
        primary.select("article_id", F.lit("category").alias("dim_kind"), F.col("primary_slug").alias("dim_value")),
        articles.select(F.col("id").alias("article_id"), F.lit("publisher").alias("dim_kind"), F.col("publication").alias("dim_value")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter("dim_value is not null and dim_value != ''").distinct()


def _fan_out(touches: DataFrame, dims: DataFrame) -> DataFrame:
    site = touches.withColumns({"dim_kind": F.lit("site"), "dim_value": F.lit("all")})
    return touches.join(dims, "article_id").select(*touches.columns, "dim_kind", "dim_value").unionByName(site)


def dim_counts(touches: DataFrame, dims: DataFrame, first: DataFrame, keys: list[str], returning: Column) -> DataFrame:
    """Unique visitors by event for each dimension; event_count is the number of touches.

    First one row per (dimension, visitor, event), which spreads a hot dimension over its visitors; then a count.
    """
    fanned = _fan_out(touches, dims)
    by_visitor = fanned.groupBy(*keys, "dim_kind", "dim_value", "visitor_key", "event").agg(F.count("*").alias("n")).join(first, "visitor_key", "left")
    return by_visitor.groupBy(*keys, "dim_kind", "dim_value").agg(*_counters(returning), F.sum("n").alias("event_count"))


def feedback_dims(events: DataFrame) -> DataFrame:
    """Per (day, value): rating, reason and theme of feedback; impression_uniques holds its distinct visitors."""
    parts = F.split(F.coalesce("detail", F.lit("")), ":")
    rating, reason = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    valid = (rating != "") & F.coalesce(reason != "", F.lit(False))
    values = F.when(valid, F.array(F.concat(F.lit("rating:"), rating), F.concat(F.lit("reason:"), reason), F.concat(F.lit("theme:"), rating, F.lit("/"), reason))).otherwise(F.array(F.lit("theme:unspecified")))
    rows = events.filter("event = 'experience_feedback'").select(event_day().alias("day"), "visitor_key", F.explode(values).alias("dim_value"))
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTERS if c != "impression_uniques"]
    found = rows.groupBy("day", "dim_value").agg(F.countDistinct("visitor_key").alias("impression_uniques"), F.count("*").alias("event_count"))
    return found.select("day", F.lit("feedback").alias("dim_kind"), "dim_value", "impression_uniques", *zero, "event_count")


def daily_dims(touches: DataFrame, dims: DataFrame, first: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per (day, dim_kind, dim_value): the counters and event_count; with events, their feedback too."""
    rows = dim_counts(touches, dims, first, ["day"], F.col("first_day") < F.col("day"))
    return rows if events is None else rows.unionByName(feedback_dims(events))


def window_touches(touches: DataFrame, start: str, end: str) -> DataFrame:
    """Touches of the window, one per (article, visitor, event) over all its days: uniques of a window are no sum of days."""
    return touches.filter(F.col("day").between(start, end)).select("article_id", "visitor_key", "event").distinct()


def window_articles(touches: DataFrame, first: DataFrame, start: str, end: str) -> DataFrame:
    joined = window_touches(touches, start, end).join(first, "visitor_key", "left")
    return joined.groupBy("article_id").agg(*_counters(F.col("first_day") < start))


def window_dims(touches: DataFrame, dims: DataFrame, first: DataFrame, start: str, end: str) -> DataFrame:
    return dim_counts(window_touches(touches, start, end), dims, first, [], F.col("first_day") < start)


def window_feedback(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Feedback from stored daily rollups: here, and only here, daily uniques are summed."""
    rows = daily.filter((F.col("dim_kind") == "feedback") & F.col("day").between(start, end))
    return rows.groupBy("dim_kind", "dim_value").agg(F.sum("impression_uniques").alias("impression_uniques"), F.sum("event_count").alias("event_count"))


def overview(touches: DataFrame, first: DataFrame, start: str, end: str, approx: bool = False) -> DataFrame:
    """Distinct visitors of the site by event over a window. approx counts by sketches, in bounded memory."""
    rows = touches.filter(F.col("day").between(start, end)).join(first, "visitor_key", "left")
    if approx:
        cells = [F.approx_count_distinct(F.when(F.col("event") == e, F.col("visitor_key"))).alias(n) for e, n in RATE_EVENTS.items()]
        return rows.agg(*cells, F.approx_count_distinct(F.when((F.col("event") == "impression") & (F.col("first_day") < start), F.col("visitor_key"))).alias("returning_uniques"))
    return rows.select("visitor_key", "event", "first_day").distinct().agg(*_counters(F.col("first_day") < start))


# -- rates ------------------------------------------------------------------------------------------------------------
def exposure_rates(counts: DataFrame, floor: int = IMPRESSION_FLOOR) -> DataFrame:
    """Adds each counter's rate per impression (null without any), sufficient, and weighted_score where sufficient."""
    base = F.nullif(F.col("impression_uniques"), F.lit(0))
    rates = {c.replace("_uniques", "_rate"): F.coalesce(F.col(c), F.lit(0)) / base for c in COUNTERS if c != "impression_uniques"}
    found = counts.withColumns(rates).withColumn("sufficient", F.col("impression_uniques") >= floor)
    score = F.col("interested_rate") * 3 + F.col("save_rate") * 2 + F.col("share_rate") * 2 + F.col("outbound_rate") - F.col("less_like_rate") * 2
    return found.withColumn("weighted_score", F.when(F.col("sufficient"), score))


def format_rate(rate: Column) -> Column:
    tenths = F.floor(rate * 1000 + 0.5) / 10
    shown = F.regexp_replace(F.format_string("%.1f", tenths), r"\.0$", "")
    return F.when(rate.isNull(), "—").otherwise(F.concat(shown, F.lit("%")))


def rank_by_open_rate(rates: DataFrame, key: str, floor: int = IMPRESSION_FLOOR) -> DataFrame:
    """Adds is_ranked and position: rows above the floor by open rate, impressions, key; the others by impressions, key."""
    ranked = F.col("impression_uniques") >= floor
    rate = F.when(ranked, F.coalesce("open_rate", F.lit(0.0))).otherwise(F.lit(0.0))
    # either list may hold any number of rows, so ranges of it are numbered side by side
    return numbered(rates.withColumns({"is_ranked": ranked, "_rate": rate}), ["is_ranked"], [F.desc("_rate"), F.desc("impression_uniques"), F.asc(key)]).drop("_rate")


def emerging(current: DataFrame, previous: DataFrame, known: list[str] | None = None, floor: int = IMPRESSION_FLOOR) -> DataFrame:
    """Interests of the current window with the change of their open rate; ranked: enough data in both first, then by change."""
    keep = lambda df: exposure_rates(df.filter((F.col("dim_kind") == "interest") & (F.lit(True) if known is None else F.col("dim_value").isin(*known))), floor)
    before = keep(previous).select("dim_value", F.col("open_rate").alias("previous_open_rate"), F.col("impression_uniques").alias("previous_impressions"), F.col("sufficient").alias("previous_sufficient"))
    found = keep(current).join(before, "dim_value", "left")
    found = found.withColumns({"open_rate_delta": F.col("open_rate") - F.col("previous_open_rate"), "sufficient_both": F.col("sufficient") & F.coalesce("previous_sufficient", F.lit(False))})
    order = Window.orderBy(F.desc("sufficient_both"), F.desc_nulls_last("open_rate_delta"), "dim_value")
    # one row per interest of a fixed list, so one task may hold them
    return found.withColumn("position", F.row_number().over(order))


def desk_statements(dims: DataFrame, interests: DataFrame, articles: DataFrame, days: int, floor: int = IMPRESSION_FLOOR) -> DataFrame:
    """At most five lines: best and worst publisher, a rising interest, best and worst article above the floor."""
    pick = lambda df, key: df.filter(F.col("impression_uniques") >= floor).agg(F.max_by(F.struct(F.col(key).cast("string").alias("k"), "open_rate", "impression_uniques"), F.struct("open_rate", F.col("impression_uniques"))).alias("top"), F.min_by(F.struct(F.col(key).cast("string").alias("k"), "open_rate", "impression_uniques"), F.struct("open_rate", F.col("impression_uniques"))).alias("low"))
    line = lambda what, at, tail="": F.concat(F.lit(what + " "), at["k"], F.lit(": "), format_rate(at["open_rate"]), F.lit(" of impressions led to an opening ("), at["impression_uniques"].cast("string"), F.lit(f" visitors in {days} days){tail}"))
    parts = []
    for at, (df, key, what) in enumerate([(dims.filter("dim_kind = 'publisher'"), "dim_value", "Publisher"), (articles, "article_id", "Article")]):
        found = pick(df, key)
        parts.append(found.select(F.lit(3 * at).alias("line_no"), line(what, F.col("top")).alias("statement")))
        parts.append(found.filter("top.k != low.k").select(F.lit(3 * at + 1).alias("line_no"), line(what, F.col("low"), ", the least with enough data").alias("statement")))
    rising = interests.filter("sufficient_both and open_rate_delta > 0").agg(F.min_by(F.struct("dim_value", "open_rate_delta", "impression_uniques"), "position").alias("r"))
    parts.append(rising.select(F.lit(2).alias("line_no"), F.concat(F.lit("Interest "), F.col("r.dim_value"), F.lit(" is opened more often, by "), format_rate(F.col("r.open_rate_delta")), F.lit(" of impressions ("), F.col("r.impression_uniques").cast("string"), F.lit(f" visitors in {days} days)")).alias("statement")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter("statement is not null")


# -- trends, cohorts, reports -----------------------------------------------------------------------------------------
def trending_scores(events: DataFrame) -> DataFrame:
    """Per article, from raw rows: counts of score events, their weighted sum and distinct visitors."""
    rows = events.filter(F.col("event").isin(*WEIGHTS) & (F.coalesce("article_id", F.lit(0)) != 0))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("event"))
    counts = [F.count(F.when(F.col("event") == e, 1)).alias(e) for e in WEIGHTS]
    return rows.groupBy("article_id").agg(*counts, F.sum(weight).cast("long").alias("score"), F.countDistinct("visitor_key").alias("unique_visitors"))


def _qualified(rows: DataFrame) -> DataFrame:
    return trending_scores(rows).filter((F.col("score") > 0) & (F.col("unique_visitors") >= ARTICLE_VISITORS))


def trending(events: DataFrame, now_ms: int, days: int = TRENDING_DAYS) -> DataFrame:
    """The gate, one row: mode (trending or discover), reason and observed counts.

    It opens with enough distinct visitors over all events, positive rows and qualified articles.
    """
    rows = events.filter(F.col("created_at") >= now_ms - days * DAY_MS)
    listed = _qualified(rows).agg(F.count("*").alias("articles_observed"))
    seen = rows.agg(F.countDistinct("visitor_key").alias("visitors"), F.count(F.when(F.col("event").isin(*POSITIVE_EVENTS) & (F.coalesce("article_id", F.lit(0)) != 0), 1)).alias("positive_events"))
    open_ = (F.col("visitors") >= GATE_VISITORS) & (F.col("positive_events") >= GATE_POSITIVE) & (F.col("articles_observed") >= GATE_ARTICLES)
    gate = seen.join(listed)  # one row each
    short = F.concat_ws("", F.lit("thin data: "), F.col("visitors").cast("string"), F.lit(" visitors, "), F.col("positive_events").cast("string"), F.lit(" positive events, "), F.col("articles_observed").cast("string"), F.lit(" articles"))
    return gate.select(F.when(open_, "trending").otherwise("discover").alias("mode"), "visitors", "positive_events", "articles_observed", F.when(open_, F.lit(None)).otherwise(short).alias("reason"))


def trending_articles(events: DataFrame, now_ms: int, days: int = TRENDING_DAYS) -> DataFrame:
    """(article_id, score, unique_visitors) of the qualified articles, if the gate is open; best: highest score, most visitors, smallest id."""
    rows = events.filter(F.col("created_at") >= now_ms - days * DAY_MS)
    gate = trending(events, now_ms, days).filter("mode = 'trending'").select("mode")
    return _qualified(rows).join(F.broadcast(gate)).select("article_id", "score", "unique_visitors")  # the gate is one row or none


def community_list(trend: DataFrame, discover: DataFrame, eligible: DataFrame, most: int = 4) -> DataFrame:
    """(source, position, article_id): the best trending articles that are still eligible, else the discover list (article_id, position)."""
    picked = trend.join(eligible.select("article_id"), "article_id", "left_semi").orderBy(F.desc("score"), F.desc("unique_visitors"), "article_id").limit(most)
    rows = picked.withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("unique_visitors"), "article_id")).cast("long")).select(F.lit(0).alias("source_rank"), F.lit("trending").alias("source"), "at", "article_id")
    fallback = discover.orderBy("position").limit(most)
    rows = rows.unionByName(fallback.select(F.lit(1).alias("source_rank"), F.lit("discover").alias("source"), F.col("position").cast("long").alias("at"), "article_id"))
    # twice `most` rows at most from here on
    best = rows.agg(F.min("source_rank").alias("best"))
    rows = rows.join(F.broadcast(best), rows.source_rank == best.best).drop("best")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("at")))
    return rows.select("source", "position", "article_id")


def cohort_labels(events: DataFrame) -> DataFrame:
    """(article_id, cohort, visitors): the cohort with most visitors that marked the article; ties to the smaller name."""
    rows = events.filter("cohort is not null and cohort != ''")
    sizes = rows.groupBy("cohort").agg(F.countDistinct("visitor_key").alias("n")).filter(F.col("n") >= COHORT_VISITORS)
    marked = rows.filter(F.col("event").isin("interested", "save") & F.col("article_id").isNotNull())
    marked = marked.groupBy("cohort", "article_id").agg(F.countDistinct("visitor_key").alias("visitors")).filter(F.col("visitors") >= COHORT_ARTICLE_VISITORS)
    best = Window.partitionBy("article_id").orderBy(F.desc("visitors"), "cohort")
    return marked.join(sized_broadcast(sizes.select("cohort")), "cohort", "left_semi").withColumn("r", F.row_number().over(best)).filter("r = 1").select("article_id", "cohort", "visitors")


def event_report(events: DataFrame) -> DataFrame:
    """(event, n, position), most frequent first; ties by name."""
    return events.groupBy("event").agg(F.count("*").alias("n")).withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "event")))


def top_articles(events: DataFrame, n: int = 12) -> DataFrame:
    return events.filter("article_id is not null").groupBy("article_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article_id").limit(n)


def rate_limited(events: DataFrame, now_ms: int) -> DataFrame:
    """(visitor_key, writes, limited) over the last ten minutes."""
    rows = events.filter(F.col("created_at") >= now_ms - WRITE_WINDOW_MS)
    return rows.groupBy("visitor_key").agg(F.count("*").alias("writes")).withColumn("limited", F.col("writes") >= WRITE_LIMIT)


def rolling_writes(events: DataFrame) -> DataFrame:
    """Each stored row with the number of the visitor's rows in the ten minutes before it.

    Time is cut into buckets of ten minutes, and each bucket also gets the rows of the one before it, so a visitor with
    most rows is dealt over their buckets instead of one sorted task.
    """
    bucket = F.floor(F.col("created_at") / WRITE_WINDOW_MS)
    dealt = events.withColumn("_x", F.explode(F.array(F.struct(bucket.alias("at"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("at"), F.lit(False).alias("own")))))
    before = Window.partitionBy("visitor_key", "_x.at").orderBy("created_at").rangeBetween(-WRITE_WINDOW_MS, 0)
    return dealt.withColumn("writes_before", F.count("*").over(before) - 1).filter("_x.own").drop("_x")


def recent_interactions(events: DataFrame, n: int = 30) -> DataFrame:
    """Per visitor the latest of each (article, kind), newest first, at most n."""
    rows = events.filter("article_id is not null").groupBy("visitor_key", "article_id", "event").agg(F.max("created_at").alias("seen_at"))
    order = Window.partitionBy("visitor_key").orderBy(F.desc("seen_at"), "article_id", "event")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def visit_sessions(visits: DataFrame, least: int = 3) -> DataFrame:
    """(visitor_key, sessions, eligible) from rows with an explicit session_id."""
    return visits.groupBy("visitor_key").agg(F.countDistinct("session_id").alias("sessions")).withColumn("eligible", F.col("sessions") >= least)


def feedback_gate(first_paint: Column, dwell_ms: Column, scrolled: Column, engaged: Column, submitted: Column, dismissed_at: Column, visits: Column, now_ms: int, least_dwell: int = 20_000, rest_days: int = 14) -> Column:
    """Whether to ask for feedback: not at first paint, from the third visit on, not if it was given or lately dismissed, and on any sign of interest."""
    responded = submitted | F.coalesce(F.lit(now_ms) - dismissed_at < rest_days * DAY_MS, F.lit(False))
    return F.coalesce(~first_paint & ~responded & (visits >= 3) & (engaged | scrolled | (dwell_ms >= least_dwell)), F.lit(False))
