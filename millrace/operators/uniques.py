"""Unique visitors of any window of days from stored days: exact bitmaps of numbered visitors, or sketches of bounded size.

A window reads days, not touches: a row for each day, dimension, event and 32768 visitors at most, however many touches
there were. Uniques of a window are no sum of days, but bitmaps and sketches of days can be merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.engagement import RATE_EVENTS, _fan_out
from millrace.operators.ranking import numbered

#: Relative standard error of the sketches of hll_sketch_agg with 2**12 registers.
SKETCH_BITS, SKETCH_ERROR = 12, 0.016
DIM = ["dim_kind", "dim_value"]


def visitor_numbers(touches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(visitor_key, number): a number from 0 for each visitor; known ones keep theirs, new ones follow. Dense, so that bitmaps are."""
    visitors = touches.select("visitor_key").filter("visitor_key IS NOT NULL").distinct()
    if known is None:
        return numbered(visitors, [], [F.asc("visitor_key")]).select("visitor_key", (F.col("position").cast("long") - 1).alias("number"))
    fresh = numbered(visitors.join(known, "visitor_key", "left_anti"), [], [F.asc("visitor_key")])
    begin = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("begin"))
    return known.select("visitor_key", "number").unionByName(fresh.join(F.broadcast(begin)).select("visitor_key", (F.col("position") - 1 + F.col("begin")).alias("number")))  # begin is one row


def _bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, bitmap) of the numbers of each key."""
    return rows.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def daily_article_bitmaps(touches: DataFrame, numbers: DataFrame) -> DataFrame:
    """(day, article_id, event, bucket, bitmap) of engagement.daily_touches(), to be stored by day."""
    return _bitmaps(touches.join(numbers, "visitor_key"), ["day", "article_id", "event"])


def daily_dim_bitmaps(touches: DataFrame, dims: DataFrame, numbers: DataFrame) -> DataFrame:
    """(day, dim_kind, dim_value, event, bucket, bitmap), with the site as a dimension, to be stored by day."""
    return _bitmaps(_fan_out(touches.join(numbers, "visitor_key"), dims), ["day", *DIM, "event"])


def first_day_bitmaps(first: DataFrame, numbers: DataFrame) -> DataFrame:
    """(first_day, bucket, bitmap): which visitors came first on a day."""
    return _bitmaps(first.join(numbers, "visitor_key"), ["first_day"])


def _merged(stored: DataFrame, keys: list[str], start: str, end: str, day: str = "day") -> DataFrame:
    """One bitmap a bucket over the days of a window."""
    return stored.filter(F.col(day).between(start, end)).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _counters(cells: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, event, n) the counters of the rate events, and returning_uniques, whose event is called returning."""
    count = lambda event: F.coalesce(F.sum(F.when(F.col("event") == event, F.col("n"))), F.lit(0)).cast("long")
    return cells.groupBy(*keys).agg(*[count(e).alias(name) for e, name in RATE_EVENTS.items()], count("returning").alias("returning_uniques"))


def _window(stored: DataFrame, firsts: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    merged = _merged(stored, [*keys, "event"], start, end)
    before = firsts.filter(F.col("first_day") < start).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("earlier"))
    # both bitmaps of a bucket as two rows, of which those that are in both are kept
    seen = merged.filter("event = 'impression'").join(before, "bucket")
    both = seen.select(*keys, "bucket", F.explode(F.array("bitmap", "earlier")).alias("bitmap")).groupBy(*keys, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    cells = merged.select(*keys, "event", F.bitmap_count("bitmap").alias("n")).unionByName(both.select(*keys, F.lit("returning").alias("event"), F.bitmap_count("bitmap").alias("n")))
    return _counters(cells, keys)


def window_articles(stored: DataFrame, firsts: DataFrame, start: str, end: str) -> DataFrame:
    """As engagement.window_articles(), from daily_article_bitmaps() and first_day_bitmaps()."""
    return _window(stored, firsts, ["article_id"], start, end)


def window_dims(stored: DataFrame, by_article: DataFrame, dims: DataFrame, firsts: DataFrame, start: str, end: str) -> DataFrame:
    """As engagement.window_dims(): uniques from daily_dim_bitmaps(), event_count from the articles' own bitmaps."""
    touches = _merged(by_article, ["article_id", "event"], start, end).groupBy("article_id").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
    counted = _fan_out(touches, dims).groupBy(*DIM).agg(F.sum("n").alias("event_count"))
    return _window(stored, firsts, DIM, start, end).join(counted, DIM)


def overview(stored: DataFrame, firsts: DataFrame, start: str, end: str) -> DataFrame:
    """As engagement.overview(): the site's row of the dimensions."""
    return _window(stored.filter("dim_kind = 'site'"), firsts, DIM, start, end).drop(*DIM)


# -- sketches ---------------------------------------------------------------------------------------------------------
def daily_dim_sketches(touches: DataFrame, dims: DataFrame) -> DataFrame:
    """(day, dim_kind, dim_value, event, sketch): about 4 KB each at most, whatever the number of visitors."""
    return _fan_out(touches, dims).groupBy("day", *DIM, "event").agg(F.hll_sketch_agg("visitor_key", F.lit(SKETCH_BITS)).alias("sketch"))


def window_estimates(stored: DataFrame, start: str, end: str) -> DataFrame:
    """(dim_kind, dim_value, event, uniques) over a window, with a relative standard error of SKETCH_ERROR."""
    rows = stored.filter(F.col("day").between(start, end)).groupBy(*DIM, "event").agg(F.hll_union_agg("sketch").alias("sketch"))
    return rows.select(*DIM, "event", F.hll_sketch_estimate("sketch").alias("uniques"))


def rolling(stored: DataFrame, days: int) -> DataFrame:
    """(end_day, dim_kind, dim_value, event, uniques) of the window of so many days that ends on each stored day, by sketches.

    Each stored row goes to the `days` windows it belongs to; windows that end after the last stored day are left out.
    """
    ends = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    rows = stored.withColumn("_k", ends).withColumn("end_day", F.date_format(F.date_add(F.col("day").cast("date"), F.col("_k")), "yyyy-MM-dd"))
    last = stored.agg(F.max("day").alias("_last"))
    rows = rows.join(F.broadcast(last), F.col("end_day") <= F.col("_last"))  # one row
    return rows.groupBy("end_day", *DIM, "event").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("uniques"))
