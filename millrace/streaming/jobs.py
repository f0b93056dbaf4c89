"""Structured Streaming twins of the engagement jobs. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import engagement as en

#: Events that clients may send, and places of an impression.
CLIENT_EVENTS = ["impression", "story_open", "outbound", "save", "unsave", "share", "interested", "less_like_this", "experience_feedback"]
SURFACES = ["home", "category", "editorial_api"]
MOST_IDS, MOST_DETAIL = 80, 80
PAYLOAD = "event string, articleId string, articleIds array<string>, cohort string, surface string, detail string, rating string, reason string"


def sanitize_cohort(c: F.Column) -> F.Column:
    """Whitespace collapsed; null if empty, over 80 characters, or with <, > or control characters."""
    squeezed = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when((squeezed != "") & (F.length(squeezed) <= 80) & ~squeezed.rlike(r"[<>\p{Cntrl}]"), squeezed)


def is_visitor_key(c: F.Column) -> F.Column:
    return c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def validate_events(raw: DataFrame) -> DataFrame:
    """Payload lines (payload, visitor_key, created_at) as one row per article, or one row with an error.

    Works on batch and stream alike; good rows have a null error.
    """
    p = F.from_json("payload", PAYLOAD)
    positive = lambda c: F.when(c.rlike(r"^[1-9]\d{0,17}(?:\.0+)?$"), F.regexp_replace(c, r"\.0+$", "").cast("long"))
    rows = raw.withColumn("p", p)
    listed = F.coalesce(F.col("p.articleIds"), F.array(F.col("p.articleId")))
    ids = F.array_distinct(F.filter(F.transform(listed, positive), lambda x: x.isNotNull()))
    one = positive(F.col("p.articleId"))
    given = F.coalesce(F.col("p.articleId"), F.lit("")) != ""
    event = F.col("p.event")
    error = (
        F.when(F.col("p").isNull() | ~F.trim("payload").startswith("{"), "not_an_object").when(event.isNull() | ~event.isin(*CLIENT_EVENTS), "unknown_event")
        .when((event == "impression") & ~F.coalesce(F.col("p.surface").isin(*SURFACES), F.lit(False)), "unknown_surface").when((event == "impression") & (F.size(ids) == 0), "no_articles").when((event == "impression") & (F.size(ids) > MOST_IDS), "too_many_articles")
        .when((event != "impression") & given & one.isNull(), "bad_article").when(~event.isin("impression", "experience_feedback") & one.isNull(), "no_article")
    )
    articles = F.when(event == "impression", ids).when(event == "experience_feedback", F.array(F.lit(None).cast("long"))).otherwise(F.array(one))
    detail = F.coalesce(F.nullif(F.substring(F.trim("p.detail"), 1, MOST_DETAIL), F.lit("")), F.when((F.col("p.rating") != "") & (F.col("p.reason") != ""), F.concat_ws(":", "p.rating", "p.reason")))
    rows = rows.withColumns({"error": error, "article_id": F.explode(F.when(error.isNull(), articles).otherwise(F.array(F.lit(None).cast("long"))))})
    return rows.select("visitor_key", "created_at", event.alias("event"), "article_id", sanitize_cohort(F.col("p.cohort")).alias("cohort"), F.when(event == "impression", F.col("p.surface")).alias("surface"), F.when(event != "impression", detail).alias("detail"), en.utc_day(F.col("created_at")).alias("day_utc"), "error", "payload")


def dedup_impressions(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One impression per visitor, article, UTC day and surface; other events all. The day is in the key, so state may be dropped a day later."""
    timed = events.withColumn("ts", F.timestamp_millis("created_at"))
    keys = ["visitor_key", "article_id", "day_utc", "surface"]
    views = timed.filter("event = 'impression'")
    views = views.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else views.dropDuplicates(keys)
    return views.drop("ts").unionByName(timed.filter("event != 'impression'").drop("ts"))


def daily_uniques(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, article_id, counters) by tumbling UTC days: touches are made distinct first, as streams can't count distinct."""
    timed = events.filter(F.col("event").isin(*en.RATE_EVENTS) & F.col("article_id").isNotNull()).withColumn("ts", F.timestamp_millis("created_at")).withColumn("day", en.event_day())
    keys = ["day", "article_id", "visitor_key", "event"]
    counts = [F.count(F.when(F.col("event") == e, 1)).alias(n) for e, n in en.RATE_EVENTS.items()]
    if not events.isStreaming:
        return timed.dropDuplicates(keys).groupBy("day", "article_id").agg(*counts)
    touches = timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return touches.groupBy(F.window("ts", "1 day").alias("w"), "article_id").agg(*counts).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "article_id", *en.RATE_EVENTS.values())


def trending_windows(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Score events of sliding 7-day windows, by day; visitors by sketch. The exact list is the batch job on the stored log."""
    rows = events.filter(F.col("event").isin(*en.WEIGHTS) & F.col("article_id").isNotNull()).withColumn("ts", F.timestamp_millis("created_at")).withWatermark("ts", delay)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in en.WEIGHTS.items() for x in pair]), F.col("event"))
    return rows.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "article_id").agg(F.sum(weight).alias("score"), F.approx_count_distinct("visitor_key").alias("visitors"))


def accept_writes(times: list[int], impressions: list[bool], kept: list[int]) -> tuple[list[bool], list[int]]:
    """Which attempts are stored: impressions always; others while fewer than the limit were stored in the ten minutes before."""
    out, stored = [], deque(kept)
    for at, free in zip(times, impressions, strict=True):
        while stored and stored[0] < at - en.WRITE_WINDOW_MS:
            stored.popleft()
        ok = free or len(stored) < en.WRITE_LIMIT
        if ok:
            stored.append(at)
        out.append(ok)
    return out, list(stored)


def with_stretch(rows: DataFrame, key: str, at: str, gap_ms: int, name: str = "stretch") -> DataFrame:
    """rows with the number of their stretch: a key's rows between two gaps of more than gap_ms.

    A gap lies between two buckets of gap_ms, so only a row for each bucket is put in order for a key, not all its rows.
    """
    bucket = F.floor(F.col(at) / gap_ms)
    ends = rows.groupBy(F.col(key).alias("_key"), bucket.alias("_bucket")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    order = Window.partitionBy("_key").orderBy("_bucket")
    fresh = F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap_ms).cast("long"), F.lit(0))
    numbers = ends.withColumn("_fresh", fresh).select("_key", "_bucket", F.sum("_fresh").over(order).alias(name))
    return rows.join(numbers, rows[key].eqNullSafe(F.col("_key")) & (bucket == F.col("_bucket"))).drop("_key", "_bucket")


def ordered_fold(rows: DataFrame, key: str | list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Rows of each key in order through fold(key, state, frame) -> (state, result), batch after batch; None is the state at first.

    A key's rows pass through one task, as they depend on each other, but only its state is held, not its rows. fold is
    called once more for each key, with an empty frame, after its last row. Of several key columns it gets a tuple.
    """
    keys = [key] if isinstance(key, str) else key

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, empty = None, None, None
        for frame in frames:
            empty = frame.iloc[:0]
            for value, part in frame.groupby(key, sort=False, dropna=False):
                if current is None or value != current[0]:
                    if current is not None:
                        yield fold(current[0], state, empty)[1]
                    current, state = (value,), None
                state, out = fold(value, state, part)
                yield out
        if current is not None:
            yield fold(current[0], state, empty)[1]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def rate_limit(events: DataFrame) -> DataFrame:
    """Adds accepted to each attempt (id, visitor_key, event, created_at): an ordered fold per visitor, with state in a stream.

    State is the times stored in the last ten minutes; it is dropped when none is left. So nothing is carried over a gap
    of more than ten minutes, and the batch form folds each stretch between two gaps by itself: one visitor with most
    rows is dealt over many tasks, unless there is never such a gap.
    """
    rows = events.select("id", "visitor_key", "event", "created_at")
    schema = "id long, visitor_key string, event string, created_at long, accepted boolean"

    def judged(kept: list[int], frame: pd.DataFrame) -> tuple[list[int], pd.DataFrame]:
        accepted, kept = accept_writes(frame.created_at.tolist(), (frame.event == "impression").tolist(), kept)
        return kept, frame.assign(accepted=accepted)[["id", "visitor_key", "event", "created_at", "accepted"]]

    if not events.isStreaming:
        parts = with_stretch(rows, "visitor_key", "created_at", en.WRITE_WINDOW_MS)
        return ordered_fold(parts, ["visitor_key", "stretch"], ["created_at", "id"], lambda _, kept, frame: judged(kept or [], frame), schema)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["created_at", "id"])
        kept, rows = judged(list(state.get[0]) if state.exists else [], rows)
        state.update((kept,))
        state.setTimeoutDuration(en.WRITE_WINDOW_MS)
        yield rows

    return rows.groupBy("visitor_key").applyInPandasWithState(step, schema, "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _marked(lists: dict[str, list[int]], polarity: str, article: int, most: int) -> None:
    """One toggle: the two polarities exclude each other, the same mark again clears it, and only the newest stay."""
    mine = lists.setdefault(polarity, [])
    had = article in mine
    for marks in lists.values():
        if article in marks:
            marks.remove(article)
    if not had:
        mine.insert(0, article)
        del mine[most:]


MARKS = "visitor_key string, polarity string, article_id long, slot int"


def toggle_marks(toggles: DataFrame, most: int = 50) -> DataFrame:
    """(visitor_key, polarity, article_id, slot): an ordered fold of marks (at, id), newest first; in a stream, each visitor's marks after every batch.

    The two polarities exclude each other; the same mark again clears it; each keeps its newest `most`, and one
    that was dropped does not come back. So it is no "latest state" query.
    """
    rows = toggles.select("visitor_key", "article_id", "polarity", "at", "id")

    def listed(visitor: str, lists: dict[str, list[int]]) -> pd.DataFrame:
        return pd.DataFrame([(visitor, p, a, i + 1) for p, marks in lists.items() for i, a in enumerate(marks)], columns=["visitor_key", "polarity", "article_id", "slot"])

    def fold(visitor: str, lists: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        lists = {} if lists is None else lists
        for r in frame.itertuples():
            _marked(lists, r.polarity, r.article_id, most)
        return lists, listed(visitor, lists if frame.empty else {})

    if not toggles.isStreaming:
        return ordered_fold(rows, "visitor_key", ["at", "id"], fold, MARKS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lists = {p: list(marks) for p, marks in zip(*state.get, strict=True)} if state.exists else {}
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples():
            _marked(lists, r.polarity, r.article_id, most)
        state.update((list(lists), list(lists.values())))
        yield listed(key[0], lists)

    return rows.groupBy("visitor_key").applyInPandasWithState(step, MARKS, "polarities array<string>, marks array<array<long>>", "update", GroupStateTimeout.NoTimeout)


def quarantine_batch(out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch with two sinks: valid events go to out/events, the others with their error to out/rejected; run twice, it leaves the same rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = validate_events(batch)
        rows.filter("error is null").drop("error", "payload").write.mode("overwrite").parquet(f"{out}/events/batch_id={batch_id}")
        rows.filter("error is not null").select("visitor_key", "created_at", "error", "payload").write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")

    return run


def late_rows(batch: DataFrame, closed_day: str) -> tuple[DataFrame, DataFrame]:
    """(rows of days that are still open, rows of closed_day and before, which only a rollup of stored days takes in)."""
    late = en.event_day() <= closed_day
    return batch.filter(~late), batch.filter(late)


def rollup_days(log: DataFrame, dims: DataFrame, first: DataFrame, out: str) -> None:
    """Replaces the days that log, all stored rows of these days, has rows of."""
    from millrace.sources.sinks import write_daily

    touches = en.daily_touches(log)
    write_daily(en.daily_articles(touches, first), f"{out}/daily_articles")
    write_daily(en.daily_dims(touches, dims, first, log), f"{out}/daily_dims")


def rollup_batch(dims: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that stores the batch's raw rows and first days, then rolls the days it touches up anew from all that is stored.

    So a day that comes in several batches, or late, is counted whole, and a batch that runs twice changes nothing. A
    first day that moves to an earlier one changes only days rolled up after that; repair() mends the others.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("log_day", en.event_day())
        rows.write.mode("overwrite").parquet(f"{out}/log/batch_id={batch_id}")
        en.visitor_first(batch).write.mode("overwrite").parquet(f"{out}/visitor_first/batch_id={batch_id}")
        days = [r.log_day for r in rows.select("log_day").distinct().collect()]  # days of one batch
        stored = spark.read.parquet(f"{out}/log").filter(F.col("log_day").isin(*days))
        rollup_days(stored.drop("batch_id", "log_day"), dims, stored_first(spark, out), out)

    return run


def stored_first(spark, out: str) -> DataFrame:
    """(visitor_key, first_day) over all batches stored."""
    return spark.read.parquet(f"{out}/visitor_first").groupBy("visitor_key").agg(F.min("first_day").alias("first_day"))


def repair(spark, dims: DataFrame, out: str, since_day: str) -> None:
    """Rolls up anew all stored days from since_day on, with what is known of first days by now."""
    stored = spark.read.parquet(f"{out}/log").filter(F.col("log_day") >= since_day)
    rollup_days(stored.drop("batch_id", "log_day"), dims, stored_first(spark, out), out)
