"""Windows from stored days against windows from touches."""

import random

from millrace.operators import engagement as en
from millrace.operators import uniques as un

LOG = "id long, event string, article_id long, visitor_key string, cohort string, created_at long, day_utc string, surface string, detail string"
DAY = 86_400_000
T0 = 19_700 * DAY


def test_windows_of_stored_days_equal_those_of_touches(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([*en.RATE_EVENTS, "other"]), rng.choice([1, 1, 2, 3, None]), f"v{rng.randint(0, 60)}", None, T0 + rng.randint(0, 19) * DAY, None, "home", None) for i in range(900)]
    log = spark.createDataFrame(rows, LOG).cache()
    dims = spark.createDataFrame([(1, "interest", "a"), (2, "interest", "a"), (2, "marque", "b"), (9, "marque", "c")], "article_id long, dim_kind string, dim_value string")
    touches, first = en.daily_touches(log).cache(), en.visitor_first(log).cache()
    # numbers are given in two batches; the ones of the first stay
    early = un.visitor_numbers(touches.filter("day < '2023-12-14'")).cache()
    numbers = un.visitor_numbers(touches, early).cache()
    n = numbers.count()
    assert sorted(r.number for r in numbers.collect()) == list(range(n)) and early.join(numbers, ["visitor_key", "number"]).count() == early.count() < n
    by_article, by_dim, firsts = un.daily_article_bitmaps(touches, numbers).cache(), un.daily_dim_bitmaps(touches, dims, numbers).cache(), un.first_day_bitmaps(first, numbers).cache()
    rows_of = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    for start, end in [("2023-12-10", "2023-12-23"), ("2023-12-09", "2023-12-09"), ("2023-12-01", "2024-12-31"), ("2030-01-01", "2030-01-02")]:
        want = en.window_articles(touches, first, start, end)
        assert rows_of(un.window_articles(by_article, firsts, start, end), want) == rows_of(want, want)
        want = en.window_dims(touches, dims, first, start, end)
        assert rows_of(un.window_dims(by_dim, by_article, dims, firsts, start, end), want) == rows_of(want, want)
    want = en.overview(touches, first, "2023-12-10", "2023-12-23")
    assert rows_of(un.overview(by_dim, firsts, "2023-12-10", "2023-12-23"), want) == rows_of(want, want)


def test_sketches_of_rolling_windows_keep_their_error(spark):
    rng = random.Random(2)
    touches = spark.createDataFrame([(f"2024-01-{d:02}", 1, f"v{rng.randint(0, 6000)}", "impression") for d in range(1, 9) for _ in range(1500)], "day string, article_id long, visitor_key string, event string").distinct().cache()
    dims = spark.createDataFrame([], "article_id long, dim_kind string, dim_value string")
    stored = un.daily_dim_sketches(touches, dims).cache()
    for r in un.rolling(stored, 3).collect():
        exact = touches.filter(f"day <= '{r.end_day}' and date_diff('{r.end_day}', day) < 3").select("visitor_key").distinct().count()
        assert abs(r.uniques - exact) <= 4 * un.SKETCH_ERROR * exact
    assert un.rolling(stored, 3).count() == 8
    whole = un.window_estimates(stored, "2024-01-01", "2024-01-08").first()
    assert abs(whole.uniques - touches.select("visitor_key").distinct().count()) <= 4 * un.SKETCH_ERROR * whole.uniques
