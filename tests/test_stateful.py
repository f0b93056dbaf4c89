"""Streams with state against their batch jobs: after every trigger of a replayed log, and with a batch that fails."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import engagement as en
from millrace.streaming import state as st

LOG = "id long, event string, article_id long, visitor_key string, created_at long, day_utc string"
T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def rocks(spark):
    for key, value in st.PROVIDER.items():
        spark.conf.set(key, value)
    yield spark
    for key in st.PROVIDER:
        spark.conf.unset(key)


def some_log(rng, n, days):
    events = [*en.WEIGHTS, "impression", "story_open"]
    return [(i, rng.choice(events), rng.choice([1, 1, 1, 2, 3, 0, None]), f"v{rng.randint(0, 9)}", T0 + rng.randint(0, days * en.DAY_MS), None) for i in range(n)]


def replayed(spark, batches, schema, job, check=None, fail_at=None):
    """All rows that job(stream) gives for one batch after the other; check(number of batches, rows so far) after each."""
    folder, out, checkpoint = tempfile.mkdtemp(prefix="spark-log-"), tempfile.mkdtemp(prefix="spark-out-"), tempfile.mkdtemp(prefix="spark-ck-")
    failed = []

    def sink(rows, number):
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number}")
        if number == fail_at and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        for attempt in range(2):
            stream = job(spark.readStream.schema(schema).parquet(folder))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
            try:
                query.awaitTermination(240)
                assert not query.isActive
                break
            except Exception:
                assert fail_at is not None and attempt == 0
        if check:
            check(n + 1, spark.read.parquet(f"{out}/*"))
    assert bool(failed) == (fail_at is not None)
    return spark.read.parquet(f"{out}/*")


def test_trending_equals_the_batch_job_at_every_trigger(rocks):
    rng = random.Random(1)
    log = sorted(some_log(rng, 260, 20), key=lambda r: r[4])
    late = [log.pop(rng.randint(0, 180)) for _ in range(20)]
    batches = [log[:60], log[60:120] + late[:10], log[120:160], log[160:240] + late[10:], [(999, "save", 3, "v1", T0 + 60 * en.DAY_MS, None)]]

    def check(n, rows):
        seen, ends = [], [max(r[4] for r in b if r[1] in en.WEIGHTS and r[2]) for b in batches[:n]]
        for k, batch in enumerate(batches[:n]):
            # a row counts if it was no older than seven days before the latest row of the batches before it
            start = max(ends[:k], default=0) - 7 * en.DAY_MS
            seen += [r for r in batch if r[4] >= start]
        now = max(ends)  # each run ends with a batch without rows, which moves the window on
        want = en.trending_scores(rocks.createDataFrame([r for r in seen if r[4] >= now - 7 * en.DAY_MS], LOG))
        got = st.trending_now(rows)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    found = replayed(rocks, batches, LOG, lambda s: st.trending_stream(s, parts=2), check)
    assert [tuple(r) for r in st.trending_now(found).select("article_id", "save", "unique_visitors").collect()] == [(3, 1, 1)]


def test_first_days_and_sessions_with_a_batch_that_fails(rocks):
    rng = random.Random(2)
    log = [(i, "impression", 1, f"v{rng.randint(0, 7)}", T0 + rng.randint(0, 9) * en.DAY_MS, None) for i in range(80)]
    batches = [log[:30], log[30:50], log[50:]]
    whole = rocks.createDataFrame(log, LOG)
    found = replayed(rocks, batches, LOG, st.first_day_stream, fail_at=1)
    got = found.groupBy("visitor_key").agg(F.min("first_day").alias("first_day"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, en.visitor_first(whole).collect()))

    visits = lambda df: df.select("visitor_key", F.floor(F.col("created_at") / en.DAY_MS).alias("session_id"))
    found = replayed(rocks, batches, LOG, lambda s: st.session_stream(visits(s)), fail_at=1)
    got = found.groupBy("visitor_key").agg(F.max("sessions").alias("sessions"), F.max("eligible").alias("eligible"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, en.visit_sessions(visits(whole)).collect()))
