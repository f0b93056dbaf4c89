"""Ordered jobs with one visitor that holds half of all rows, against a serial fold."""

import random


from millrace.operators import engagement as en
from millrace.streaming import jobs

LOG = "id long, event string, article_id long, visitor_key string, created_at long, day_utc string"
W = en.WRITE_WINDOW_MS


def log(rng, n=1500):
    """Bursts, some of them with exactly ten minutes between, of one visitor and some others."""
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 200, 900, W, W + 1, 3 * W]) if rng.random() < 0.02 else rng.randint(0, 4000)
        rows.append((i, rng.choice(["save", "share", "impression", "interested"]), 1, "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b"]), at, None))
    rng.shuffle(rows)
    return rows


def test_rate_limit_equals_the_serial_fold(spark):
    rows = log(random.Random(1))
    want, kept = {}, {}
    for i, event, _, visitor, at, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        mine = [t for t in kept.get(visitor, []) if t >= at - W]
        want[i] = event == "impression" or len(mine) < en.WRITE_LIMIT
        kept[visitor] = [*mine, at] if want[i] else mine
    frame = spark.createDataFrame(rows, LOG)
    assert {r.id: r.accepted for r in jobs.rate_limit(frame).collect()} == want and {True, False} == set(want.values())
    stretches = jobs.with_stretch(frame, "visitor_key", "created_at", W)
    assert stretches.filter("visitor_key = 'hot'").select("stretch").distinct().count() > 5 and stretches.count() == len(rows)
    assert jobs.rate_limit(frame.filter("false")).count() == 0


def test_rolling_writes_equal_a_count_by_hand(spark):
    rows = log(random.Random(2), 400)
    want = {i: sum(v == w and at - W <= b <= at for _, _, _, w, b, _ in rows) - 1 for i, _, _, v, at, _ in rows}
    found = en.rolling_writes(spark.createDataFrame(rows, LOG))
    assert {r.id: r.writes_before for r in found.collect()} == want and "_x" not in found.columns
    # the visitor's rows are dealt by their time, too
    assert "hashpartitioning(visitor_key" in found._jdf.queryExecution().toString() and ".at" in str(found._jdf.queryExecution().sparkPlan())
