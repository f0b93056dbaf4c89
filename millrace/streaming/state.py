"""Streams with state of their own for each key, by transformWithStateInPandas: exact trending windows, first days, sessions.

The session needs the RocksDB state store (PROVIDER). State survives restarts with the checkpoint of the query; a batch that
failed is run again on the state before it, so sinks that overwrite a batch's rows end with the rows of the batch jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import engagement as en

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

HOUR_MS = 3_600_000
SCORE_EVENTS = list(en.WEIGHTS)
TOTALS = ", ".join(f"{e} long" for e in SCORE_EVENTS)
TRENDING = f"article_id long, part int, {TOTALS}, unique_visitors long, version long"


class TrendingWindow(StatefulProcessor):
    """Score events of one (article, part) that are no older than the watermark: hourly lists, rows by visitor, and totals.

    A timer stands at the oldest row; when the watermark passes it, all rows before the watermark leave, to the millisecond.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "times array<long>, events array<string>, visitors array<string>")
        self.visitors = handle.getMapState("visitors", "visitor string", "n long")
        self.totals = handle.getValueState("totals", f"{TOTALS}, unique_visitors long, version long, timer long")

    def _load(self) -> dict[str, int]:
        names = [*SCORE_EVENTS, "unique_visitors", "version", "timer"]
        return dict(zip(names, self.totals.get() if self.totals.exists() else [0] * len(names), strict=True))

    def _count(self, totals: dict[str, int], changes: dict[str, int]) -> None:
        """Rows more or less for each visitor."""
        for visitor, change in changes.items():
            before = self.visitors.getValue((visitor,))[0] if self.visitors.containsKey((visitor,)) else 0
            after = before + change
            totals["unique_visitors"] += (after > 0) - (before > 0)
            if after > 0:
                self.visitors.updateValue((visitor,), (after,))
            elif before:
                self.visitors.removeKey((visitor,))

    def _store(self, key: tuple, totals: dict[str, int]) -> Iterator[pd.DataFrame]:
        totals["version"] += 1
        self.totals.update(tuple(totals.values()))
        yield pd.DataFrame([(*key, *(totals[e] for e in SCORE_EVENTS), totals["unique_visitors"], totals["version"])], columns=[f.split()[0] for f in TRENDING.split(", ")])

    def _set_timer(self, totals: dict[str, int], at: int) -> None:
        if totals["timer"] and totals["timer"] != at:
            self.handle.deleteTimer(totals["timer"])
        if at and totals["timer"] != at:
            self.handle.registerTimer(at)
        totals["timer"] = at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = timerValues.getCurrentWatermarkInMs()
        fresh = pd.concat(list(rows))
        fresh = fresh[fresh.created_at >= start]
        if fresh.empty:
            return
        totals, changes = self._load(), {}
        for hour, part in fresh.groupby(fresh.created_at // HOUR_MS):
            at = (int(hour),)
            old = self.hours.getValue(at) if self.hours.containsKey(at) else ([], [], [])
            self.hours.updateValue(at, ([*old[0], *map(int, part.created_at)], [*old[1], *part.event], [*old[2], *part.visitor_key]))
        for event, visitor in zip(fresh.event, fresh.visitor_key, strict=True):
            totals[event] += 1
            changes[visitor] = changes.get(visitor, 0) + 1
        self._count(totals, changes)
        oldest = int(fresh.created_at.min()) + 1  # the first moment of the watermark at which a row is out
        self._set_timer(totals, min(oldest, totals["timer"]) if totals["timer"] else oldest)
        yield from self._store(key, totals)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = timerValues.getCurrentWatermarkInMs()
        totals, changes = self._load(), {}
        totals["timer"] = 0  # it has fired
        hours = sorted(hour for (hour,) in self.hours.keys())
        oldest = 0
        for hour in hours:
            if hour * HOUR_MS >= start and oldest:
                break
            rows = list(zip(*self.hours.getValue((hour,)), strict=True))
            kept = [r for r in rows if r[0] >= start]
            for time, event, visitor in rows:
                if time < start:
                    totals[event] -= 1
                    changes[visitor] = changes.get(visitor, 0) - 1
            if not kept:
                self.hours.removeKey((hour,))
            elif len(kept) < len(rows):
                self.hours.updateValue((hour,), tuple(map(list, zip(*kept, strict=True))))
            if kept:
                oldest = oldest or min(r[0] for r in kept) + 1
        self._count(totals, changes)
        self._set_timer(totals, oldest)
        yield from self._store(key, totals)

    def close(self) -> None:
        pass


def trending_stream(events: DataFrame, parts: int = 8, days: int = en.TRENDING_DAYS) -> DataFrame:
    """Updates of counts (article_id, part, a count by event, unique_visitors, version) over the last seven days of the log.

    The end of the window is the latest time seen in earlier batches, its start is seven days before that to the
    millisecond. An article's visitors are dealt over `parts` states, so a hot article is no single key; a visitor is
    in one of them, so unique visitors add up. trending_now() has the totals. Rows that come late count while they are in
    the window; a part all of whose rows have left has counts of 0.
    """
    rows = events.filter(F.col("event").isin(*SCORE_EVENTS) & (F.coalesce("article_id", F.lit(0)) != 0))
    rows = rows.select("article_id", F.pmod(F.xxhash64("visitor_key"), F.lit(parts)).cast("int").alias("part"), "event", "visitor_key", "created_at", F.timestamp_millis("created_at").alias("ts"))
    timed = rows.withWatermark("ts", f"{days} days")
    return timed.groupBy("article_id", "part").transformWithStateInPandas(TrendingWindow(), TRENDING, "Update", "EventTime")


def trending_now(updates: DataFrame) -> DataFrame:
    """The same columns as engagement.trending_scores(), from all stored updates or the latest of each part."""
    latest = updates.groupBy("article_id", "part").agg(F.max_by(F.struct(*SCORE_EVENTS, "unique_visitors"), "version").alias("x"))
    sums = [F.sum(f"x.{c}").alias(c) for c in [*SCORE_EVENTS, "unique_visitors"]]
    found = latest.groupBy("article_id").agg(*sums).filter("unique_visitors > 0")
    score = sum((F.col(e) * w for e, w in en.WEIGHTS.items()), F.lit(0))
    return found.select("article_id", *SCORE_EVENTS, score.cast("long").alias("score"), "unique_visitors")


def _clock(keep_days: int | None) -> str:
    """State that expires needs the clock, and a query that has it never ends by itself: availableNow works without keep_days only."""
    return "ProcessingTime" if keep_days else "None"


class FirstDay(StatefulProcessor):
    """The earliest day of a visitor; a row goes out when it is new or moves."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = min(frame.day.min() for frame in rows)
        known = self.day.get()[0] if self.day.exists() else None
        if known is None or earliest < known:
            self.day.update((earliest,))
            yield pd.DataFrame({"visitor_key": [key[0]], "first_day": [earliest]})

    def close(self) -> None:
        pass


def first_day_stream(events: DataFrame, keep_days: int | None = None) -> DataFrame:
    """Updates (visitor_key, first_day) of engagement.visitor_first(): the least of a visitor's updates counts.

    keep_days: state of visitors who have not moved for so many days may go; none of it goes by default.
    """
    rows = events.filter((F.col("event") == "impression") & F.col("article_id").isNotNull()).select("visitor_key", en.event_day().alias("day"))
    ttl = keep_days * en.DAY_MS if keep_days else None
    return rows.groupBy("visitor_key").transformWithStateInPandas(FirstDay(ttl), "visitor_key string, first_day string", "Update", _clock(keep_days))


class Sessions(StatefulProcessor):
    """The distinct sessions of a visitor and their number."""

    def __init__(self, least: int, ttl_ms: int | None):
        self.least, self.ttl_ms = least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "session string", "flag boolean", self.ttl_ms)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        after = before
        for session in {s for frame in rows for s in frame.session_id.dropna()}:
            if not self.seen.containsKey((session,)):
                self.seen.updateValue((session,), (True,))
                after += 1
        if after > before or not self.count.exists():
            self.count.update((after,))
            yield pd.DataFrame({"visitor_key": [key[0]], "sessions": [after], "eligible": [after >= self.least]})

    def close(self) -> None:
        pass


def session_stream(visits: DataFrame, least: int = 3, keep_days: int | None = None) -> DataFrame:
    """Updates (visitor_key, sessions, eligible) of engagement.visit_sessions(): a visitor's largest number counts.

    Sessions are told by their id, not by gaps. keep_days: an id that was first seen so many days ago may be forgotten (and
    would count anew); by default none is.
    """
    rows = visits.select("visitor_key", F.col("session_id").cast("string").alias("session_id"))
    ttl = keep_days * en.DAY_MS if keep_days else None
    return rows.groupBy("visitor_key").transformWithStateInPandas(Sessions(least, ttl), "visitor_key string, sessions long, eligible boolean", "Update", _clock(keep_days))
