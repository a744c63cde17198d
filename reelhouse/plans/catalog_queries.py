"""Catalog read queries: video_info, published_page, next_pending_jobs, video_lookup,
status_flags, videos_without_job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..sources.fixtures import Fixtures
from .registry import register


@register("video_info", ["videos", "jobs"], """
, latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) t
  WHERE rn = 1)
SELECT v.id, v.title, v.description, v.filename AS source_filename, v.resource_id, v.status,
  CAST(v.duration AS DOUBLE) / 1e9 AS duration_seconds, l.result AS manifest_path, l.error_msg AS error_message,
  v.created_at, v.updated_at
FROM videos v JOIN latest l ON v.id = l.video_id
""")
def video_info(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return L.video_info(fx.videos, fx.jobs)


@register("latest_jobs", ["jobs"], """
SELECT id, video_id, type, status, result, error_msg, created_at, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) t
WHERE rn = 1
""")
def latest_jobs(spark, sf_dir):
    return L.latest_job_per_video(Fixtures(spark, sf_dir).jobs)


@register("published_page", ["videos"], """
SELECT id, title, description, duration, filename, resource_id, status, created_at, updated_at
FROM videos WHERE status = 'published' ORDER BY created_at, id LIMIT 10 OFFSET 20
""")
def published_page(spark, sf_dir):
    return L.published_page(Fixtures(spark, sf_dir).videos, page=3)


@register("next_pending_jobs", ["jobs"], """
SELECT id, video_id, type, status, created_at, updated_at
FROM jobs WHERE status = 'pending' AND type = 'transcode' ORDER BY created_at, id LIMIT 5
""")
def next_pending_jobs(spark, sf_dir):
    return L.next_pending_jobs(Fixtures(spark, sf_dir).jobs, free_slots=5)


@register("video_lookup", ["video_keys", "videos"], """
SELECT k.id, v.id IS NOT NULL AS found, v.title, v.description, v.duration, v.filename, v.resource_id,
  v.status, v.created_at, v.updated_at
FROM (SELECT DISTINCT id FROM video_keys) k LEFT JOIN videos v ON k.id = v.id
""")
def video_lookup(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return L.lookup_videos(fx.video_keys, fx.videos)


@register("status_flags", ["videos", "jobs"], """
SELECT 'video' AS kind, id, status, status = 'pending' AS is_pending, status = 'processing' AS is_active,
  status = 'published' AS is_done, status = 'failed' AS is_failed, status = 'archived' AS is_archived,
  status IN ('pending', 'failed') AS can_advance
FROM videos
UNION ALL
SELECT 'job' AS kind, id, status, status = 'pending', status = 'running', status = 'completed',
  status = 'failed', false, status IN ('pending', 'failed')
FROM jobs
""")
def status_flags(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    v = L.status_flags(fx.videos, "video").select(
        F.lit("video").alias("kind"), "id", "status", "is_pending",
        F.col("is_processing").alias("is_active"), F.col("is_published").alias("is_done"), "is_failed",
        "is_archived", F.col("can_be_processed").alias("can_advance"))
    j = L.status_flags(fx.jobs, "job").select(
        F.lit("job").alias("kind"), "id", "status", "is_pending",
        F.col("is_running").alias("is_active"), F.col("is_completed").alias("is_done"), "is_failed",
        F.lit(False).alias("is_archived"), F.col("can_be_started").alias("can_advance"))
    return v.unionByName(j)


@register("videos_without_job", ["videos", "jobs"], """
SELECT v.id, v.title, v.status FROM videos v WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.video_id = v.id)
""")
def videos_without_job(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return L.videos_without_job(fx.videos, fx.jobs).select("id", "title", "status")
