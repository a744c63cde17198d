"""Streaming queries, run to completion with ``availableNow`` over input files that Spark
writes from the supplied tables: stream_progress (S2, P5, P6), progress_for_video (J5),
stream_logs (S6, L1, L2), stream_progress_events (S4, P1-P3, P9, S3). Each returns the
sink's contents as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..session import scratch_path
from ..sources.fixtures import Fixtures
from ..streaming.log_stream import run_log_stream
from ..streaming.progress_stream import run_progress_stream
from ..operators import progress as P
from ..streaming.progress_stream import run_events_stream
from .progress_queries import _MSGS_CTE
from .registry import register

_UNTIL_END = _MSGS_CTE + """
, d AS (SELECT g.channel, g.job_id, g.event_id, g.total_frames, g.current_frames, g.status, g.percentage
        FROM g JOIN t ON t.channel = g.channel WHERE t.stop IS NULL OR g.event_id <= t.stop)
"""
DELIVERED_COLS = ["channel", "job_id", "event_id", "total_frames", "current_frames", "status", "percentage"]


def _stage_messages(spark, sf_dir) -> str:
    stage = scratch_path(spark, "progress-in")
    Fixtures(spark, sf_dir).progress_msgs.select("event_id", "channel", "payload").write.json(stage)
    return stage


@register("stream_progress", ["progress_msgs"], _UNTIL_END + "SELECT * FROM d")
def stream_progress(spark, sf_dir):
    stage = _stage_messages(spark, sf_dir)
    root = scratch_path(spark, "progress-out")
    run_progress_stream(spark, stage, f"{root}/delivered", f"{root}/quarantine", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/delivered").select(*DELIVERED_COLS)


@register("progress_for_video", ["progress_msgs", "jobs"], _UNTIL_END + """
, lj AS (SELECT id, video_id FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) x WHERE rn = 1)
SELECT d.*, lj.video_id FROM d JOIN lj ON lj.id = d.job_id
""")
def progress_for_video(spark, sf_dir):
    stage = _stage_messages(spark, sf_dir)
    root = scratch_path(spark, "progress-video-out")
    latest = L.latest_job_per_video(Fixtures(spark, sf_dir).jobs)
    run_progress_stream(spark, stage, f"{root}/delivered", f"{root}/quarantine", f"{root}/_checkpoint",
                        latest_jobs=latest)
    return spark.read.parquet(f"{root}/delivered").select(*DELIVERED_COLS, "video_id")


@register("stream_logs", ["log_records"], """
SELECT event_id, level, 'logs:media-api:' || level AS channel,
  '{"category":' || to_json(category) || ',"level":' || to_json(level) || ',"message":' || to_json(message)
    || CASE WHEN coalesce(source_id, '') <> '' THEN ',"source_id":' || to_json(source_id) ELSE '' END || '}' AS envelope
FROM log_records
WHERE category IN ('default', 'video', 'job', 'auth') AND level IN ('info', 'warn', 'error')
""")
def stream_logs(spark, sf_dir):
    stage = scratch_path(spark, "logs-in")
    Fixtures(spark, sf_dir).log_records.write.json(stage)
    root = scratch_path(spark, "logs-out")
    run_log_stream(spark, stage, f"{root}/envelopes", f"{root}/quarantine", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/envelopes").select("event_id", "level", "channel", "envelope")


@register("stream_progress_events", same_as="progress_events")
def stream_progress_events(spark, sf_dir):
    """P9 as a stream: transcoder lines (plus each job's closing progress=end line, written
    after its last line) -> events, equal to the batch ``progress_events``."""
    fx = Fixtures(spark, sf_dir)
    lines = fx.progress_lines.select("event_id", "job_id", "line")
    ends = lines.groupBy("job_id").agg((F.max("event_id") + 1).alias("event_id")) \
        .select("event_id", "job_id", F.lit("progress=end").alias("line"))
    stage = scratch_path(spark, "lines-in")
    lines.unionByName(ends).write.json(stage)
    totals = P.parse_probes(fx.probes).filter(F.col("ok") & (F.col("total_frames") != 0))
    root = scratch_path(spark, "events-out")
    run_events_stream(spark, stage, totals, f"{root}/events", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/events").select(
        "job_id", "seq", "status", "total_frames", "current_frames", "percentage", "channel", "payload")

