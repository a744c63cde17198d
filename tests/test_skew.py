"""A hot key holding a third of all rows: results stay whole and the plans reduce map-side
before the shuffle (partial WindowGroupLimit / partial aggregates), so the hot group is never
shipped whole to one task."""

import datetime as dt

from pyspark.sql import functions as F

from reelhouse import schemas as S
from reelhouse import session
from reelhouse.operators import lookup as L
from reelhouse.operators import progress as P
from reelhouse.operators import upsert as U

N = 3000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _measured_plans(monkeypatch, module):
    """Plans of the sides that ``module`` measures: a checkpoint cuts them from the result's plan."""
    plans, real = [], module.measured_side
    monkeypatch.setattr(module, "measured_side", lambda df, *a: plans.append(_plan(df)) or real(df, *a))
    return plans


def _jobs(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.range(N).select(
        F.concat(F.lit("job-"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("vid-hot")).otherwise(F.concat(F.lit("vid-"), (F.col("id") % 97).cast("string"))).alias("video_id"),
        F.lit("transcode").alias("type"), F.lit("pending").alias("status"), F.lit("").alias("result"),
        F.lit("").alias("error_msg"),
        (F.lit(base) + F.make_interval(mins=F.col("id") % 500)).alias("created_at"))
    return df.withColumn("updated_at", F.col("created_at")).repartition(6)


def test_latest_per_key_hot_video(spark):
    jobs = _jobs(spark)
    latest = L.latest_job_per_video(jobs)
    plan = _plan(latest)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    rows = {r.video_id: r.id for r in latest.collect()}
    # brute force on the driver for this small fixture
    data = jobs.collect()
    exp = {}
    for r in data:
        cur = exp.get(r.video_id)
        if cur is None or (r.created_at, r.id) > (cur.created_at, cur.id):
            exp[r.video_id] = r
    assert rows == {k: v.id for k, v in exp.items()}


def test_upsert_hot_key_combines_map_side(spark, monkeypatch):
    plans = _measured_plans(monkeypatch, U)
    target = spark.createDataFrame([("job-hot", "v", "transcode", "pending", "", "", dt.datetime(2024, 1, 1),
                                     dt.datetime(2024, 1, 1))], S.JOBS)
    changes = spark.range(N).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("job-hot")).otherwise(F.concat(F.lit("job-"), F.col("id").cast("string"))).alias("id"),
        F.lit("v2").alias("video_id"), F.lit("transcode").alias("type"),
        F.when(F.col("id") == N - 3, "completed").otherwise("running").alias("status"),
        F.lit("").alias("result"), F.lit("").alias("error_msg"),
        F.lit(dt.datetime(2024, 2, 1)).alias("created_at"), F.lit(dt.datetime(2024, 2, 1)).alias("updated_at")
    ).repartition(6)
    out = U.upsert_jobs(target, changes)
    assert any("partial_max_by" in p for p in plans) and "CollectLimit" not in "".join(plans) + _plan(out)
    hot = out.filter("id = 'job-hot'").collect()[0]
    assert (hot.status, hot.video_id) == ("completed", "v")  # last change wins, immutable kept
    assert out.count() == 1 + 2 * N // 3


def test_until_terminal_hot_channel(spark, monkeypatch):
    plans = _measured_plans(monkeypatch, session)
    msgs = spark.range(N).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("video:hot:progress")).otherwise(
            F.concat(F.lit("video:j"), (F.col("id") % 50).cast("string"), F.lit(":progress"))).alias("channel"),
        F.format_string('{"TotalFrames":100,"CurrentFrames":%d,"Status":"%s"}', F.col("id") % 100,
                        F.when(F.col("id") == 1500, "end").otherwise("continue")).alias("payload")
    ).repartition(6)
    out = P.until_terminal(msgs)
    assert any("partial_min" in p for p in plans) and "CollectLimit" not in "".join(plans) + _plan(out)
    hot = [r.event_id for r in out.filter("job_id = 'hot'").collect()]
    assert sorted(hot) == list(range(0, 1501, 3))
