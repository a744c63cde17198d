"""Two-table commits as queries: commit_uploads (X13), commit_starts, commit_completions and
commit_failures (X14-X16). Each writes both tables with a batch's changes together, below the shared checkpoint
folder, and returns them as a reader of the committed folder finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import lookup as L
from ..session import scratch_path
from ..sources.fixtures import Fixtures
from .commit import commit_job_batch, commit_upload_batch, committed
from .machine_queries import NOW
from .registry import ORACLES, register


def _tables(spark, folder: str) -> DataFrame:
    videos, jobs = committed(spark, folder)
    none = F.lit(None).cast("string")
    return videos.select(
        F.lit("videos").alias("table_name"), "id", F.col("id").alias("video_id"), "status", "duration",
        none.alias("result"), none.alias("error_msg"), "created_at", "updated_at").unionByName(
        jobs.select(
            F.lit("jobs").alias("table_name"), "id", "video_id", "status", F.lit(None).cast("long").alias("duration"),
            "result", "error_msg", "created_at", "updated_at"))


def _current(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """videos and jobs in the columns and types of the data model."""
    return tuple(getattr(fx, t).select(*[F.col(f.name).cast(f.dataType) for f in S.TABLES[t].fields]) for t in ("videos", "jobs"))


def _job_batch(spark, fx: Fixtures, kind: str, batch: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "catalog")
    commit_job_batch(*_current(fx), kind, batch, NOW, folder)
    return _tables(spark, folder)


@register("commit_uploads", ["videos", "jobs", "uploads"], f"""
, a AS (SELECT * FROM uploads WHERE coalesce(upload_id, '') <> '' AND coalesce(filename, '') <> '' AND coalesce(resource_id, '') <> '')
SELECT 'videos' AS table_name, id, id AS video_id, status, duration, NULL AS result, NULL AS error_msg, created_at, updated_at FROM videos
UNION ALL SELECT 'videos', 'vid-' || upload_id, 'vid-' || upload_id, 'pending', 0, NULL, NULL, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM a
UNION ALL SELECT 'jobs', id, video_id, status, NULL, result, error_msg, created_at, updated_at FROM jobs
UNION ALL SELECT 'jobs', 'job-' || upload_id, 'vid-' || upload_id, 'pending', NULL, '', '', TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM a
""")
def commit_uploads(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    folder = scratch_path(spark, "catalog")
    commit_upload_batch(*_current(fx), fx.uploads, NOW, folder)
    return _tables(spark, folder)


def _committed(outcomes: str, duration: str, result: str, error_msg: str) -> str:
    """Both tables after the accepted rows of a batch query's oracle."""
    return f"""
, o AS MATERIALIZED (SELECT * FROM ({ORACLES[outcomes]}) q WHERE accepted)
SELECT 'videos' AS table_name, v.id, v.id AS video_id, coalesce(o.video_status, v.status) AS status, {duration} AS duration,
  NULL AS result, NULL AS error_msg, v.created_at,
  CASE WHEN o.job_id IS NULL THEN v.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
FROM videos v LEFT JOIN o ON o.video_id = v.id
UNION ALL
SELECT 'jobs', j.id, j.video_id, coalesce(o.job_status, j.status), NULL, {result}, {error_msg}, j.created_at,
  CASE WHEN o.job_id IS NULL THEN j.updated_at ELSE TIMESTAMP '{NOW}' END
FROM jobs j LEFT JOIN o ON o.job_id = j.id
"""


@register("commit_starts", ["videos", "jobs"], _committed("start_jobs", "v.duration", "j.result", "j.error_msg"))
def commit_starts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    batch = L.runnable_jobs(fx.jobs).select(F.col("id").alias("job_id"), F.col("created_at").alias("seq"))
    return _job_batch(spark, fx, "start", batch)


@register("commit_completions", ["videos", "jobs"],
          _committed("complete_jobs", "coalesce(o.video_duration, v.duration)", "coalesce(o.job_result, j.result)", "j.error_msg"))
def commit_completions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return _job_batch(spark, fx, "complete", fx.job_outcomes.filter(F.col("outcome") == "complete"))


@register("commit_failures", ["videos", "jobs"],
          _committed("fail_jobs", "v.duration", "j.result", "coalesce(o.job_error_msg, j.error_msg)"))
def commit_failures(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return _job_batch(spark, fx, "fail", fx.job_outcomes.filter(F.col("outcome") == "fail"))
