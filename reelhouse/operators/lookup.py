"""Catalog reads: keyed lookup (F1), filters (F2, F3), latest-per-key (T1), oldest-pending
(T2), paging (T3), dispatch batch (T4), video info (J3 + F7) and projections (F8).

Scale notes
- Latest-per-key uses ``row_number() = 1``, which Spark plans as a partial WindowGroupLimit
  before the shuffle and a final one after it: a video owning a third of all jobs is cut
  to one row per map task before the exchange; no group is ever materialised whole.
- Top-k / paging use ``orderBy().limit()`` which plans TakeOrderedAndProject: each task
  keeps its own k best rows, only k x tasks rows reach the final merge.
- Keyed lookups are equi-joins; both sides are hash-partitioned on the key and AQE may
  switch to a broadcast at runtime when one side proves small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import ns_to_seconds

JOB_COLS = ["id", "video_id", "type", "status", "result", "error_msg", "created_at", "updated_at"]
VIDEO_COLS = ["id", "title", "description", "duration", "filename", "resource_id", "status",
              "created_at", "updated_at"]


def published(videos: DataFrame) -> DataFrame:
    """published videos only (pushed to the parquet scan when videos is a plain scan)."""
    return videos.filter(F.col("status") == S.VIDEO_PUBLISHED)


def runnable_jobs(jobs: DataFrame) -> DataFrame:
    """jobs a worker may pick: pending transcode jobs."""
    return jobs.filter((F.col("status") == S.JOB_PENDING) & (F.col("type") == S.JOB_TYPE_TRANSCODE))


def latest_job_per_video(jobs: DataFrame) -> DataFrame:
    """T1 (batch form): for every video the job with the greatest created_at, ties broken by
    the greatest id. ``row_number() = 1`` plans WindowGroupLimit twice: a Partial one before
    the shuffle keeps one row per video per task, so a video owning a third of all jobs
    sends at most one row per map task; the Final one after the shuffle picks the winner."""
    w = Window.partitionBy("video_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return jobs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_job_per_video_agg(jobs: DataFrame) -> DataFrame:
    """T1 as ``max_by(struct, struct(created_at, id))`` (partial + final SortAggregate); same
    result, measured slower than the window form above, kept for comparison in tests."""
    best = F.max_by(F.struct(*[F.col(c) for c in jobs.columns]), F.struct("created_at", "id"))
    return jobs.groupBy("video_id").agg(best.alias("j")).select("j.*")


def video_info(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """J3 + F7: each video with its latest job, projected as the info record.
    Videos without any job are an error in the service; they are left out here and
    reported by ``videos_without_job``."""
    latest = latest_job_per_video(jobs).select(
        F.col("video_id"), F.col("result").alias("manifest_path"), F.col("error_msg").alias("error_message"))
    v = videos.select("id", "title", "description", "duration", "filename", "resource_id", "status",
                      "created_at", "updated_at")
    return (v.join(latest, v["id"] == latest["video_id"], "inner")
             .select("id", "title", "description",
                     F.col("filename").alias("source_filename"), "resource_id", "status",
                     ns_to_seconds("duration").alias("duration_seconds"),
                     "manifest_path", "error_message", "created_at", "updated_at"))


def videos_without_job(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """J3 error set: videos for which the info read fails (no job at all)."""
    return videos.join(jobs.select(F.col("video_id").alias("id")), "id", "left_anti")


def lookup_videos(keys: DataFrame, videos: DataFrame, key_col: str = "id") -> DataFrame:
    """F1 batch form: every requested key with the video's columns and a ``found`` flag
    (not found is the service's error case)."""
    from .joins import request_left_join
    v = videos.select(*VIDEO_COLS, F.lit(True).alias("_found"))
    k = keys.select(F.col(key_col).alias("id")).distinct()
    out = request_left_join(k, v, "id")  # a small key batch only scans the table
    return out.select("id", F.coalesce("_found", F.lit(False)).alias("found"),
                      *[c for c in VIDEO_COLS if c != "id"])


def next_pending_jobs(jobs: DataFrame, free_slots: int = S.WORKER_LIMIT) -> DataFrame:
    """The oldest runnable jobs, enough to fill ``free_slots`` workers (T2 is
    free_slots = 1). Ties on created_at are broken by id. ``id`` is the table's
    key, so the top-k runs on the scan; six columns are projected, as the service reads them."""
    if free_slots < 1:
        raise ValueError("free_slots must be >= 1")
    return (runnable_jobs(jobs)
            .select("id", "video_id", "type", "status", "created_at", "updated_at")
            .orderBy(F.col("created_at").asc(), F.col("id").asc())
            .limit(free_slots))


def published_page(videos: DataFrame, page: int, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Page ``page`` (1-based) of published videos, ordered by created_at, id so that a
    page is well defined. Pages below 1 are rejected before planning."""
    if page < 1:
        raise ValueError("page must be >= 1")
    return (published(videos).select(*VIDEO_COLS)
            .orderBy(F.col("created_at").asc(), F.col("id").asc())
            .offset((page - 1) * page_size).limit(page_size))


def published_page_after(videos: DataFrame, after: tuple | None = None,
                         page_size: int = S.PAGE_SIZE) -> DataFrame:
    """T3 for deep pages: the page that follows the row ``after`` = (created_at, id) of the
    previous page's last row (None: the first page). Same rows as ``published_page`` for the
    matching page number, but each task keeps only ``page_size`` rows at any depth (offset
    paging keeps offset + page_size), and the seek predicate reaches the scan."""
    pub = published(videos).select(*VIDEO_COLS)
    if after is not None:
        ts, key = after
        ts = F.lit(ts).cast("timestamp")
        pub = pub.filter((F.col("created_at") > ts) | ((F.col("created_at") == ts) & (F.col("id") > F.lit(key))))
    return pub.orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(page_size)


def status_flags(df: DataFrame, kind: str) -> DataFrame:
    """the status predicates as boolean columns (kind = 'video' or 'job')."""
    from ..functions.exprs import job_status_flags, video_status_flags
    flags = video_status_flags() if kind == "video" else job_status_flags()
    return df.select("id", "status", *[c.alias(n) for n, c in flags.items()])


def upload_result(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """F8: upload response projection over video ⋈ job."""
    j = jobs.select(F.col("id").alias("job_id"), F.col("video_id"))
    return (videos.select(F.col("id").alias("video_id"), "status", "resource_id")
            .join(j, "video_id").select("video_id", "job_id", "status", "resource_id"))
