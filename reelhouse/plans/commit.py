"""All-or-nothing writes of videos and jobs.

A batch is decided once and its changes are joined to both tables. Both results are one frame with a
column ``table_name``, written by one Spark job into one folder (partitioned by table), and a marker of one row
beside it is written last. Readers go by the marker, so a job that fails half-way leaves the
folder committed before fully visible, and its own folder is never read. Each commit has a new folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import machine as M
from ..operators.upsert import apply_updates, upsert_jobs, upsert_videos
from ..session import checkpoint_cut


def commit_both(videos: DataFrame, jobs: DataFrame, folder: str) -> None:
    """Both tables as one write to a new ``folder``, then its marker."""
    def rows(df: DataFrame, table: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), *[f.name for f in S.TABLES[table].fields])

    both = rows(videos, "videos").unionByName(rows(jobs, "jobs"), allowMissingColumns=True)
    both.write.partitionBy("table_name").parquet(folder)
    videos.sparkSession.range(1).write.parquet(_marker(folder))


def _marker(folder: str) -> str:
    return f"{folder.rstrip('/')}-committed"


def committed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(videos, jobs) of a folder that was committed, else None."""
    try:
        if spark.read.schema("id long").parquet(_marker(folder)).isEmpty():
            return None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # only a missing marker means that nothing was committed
        return None

    def table(name: str) -> DataFrame:
        return spark.read.schema(S.TABLES[name]).parquet(f"{folder.rstrip('/')}/table_name={name}")

    def present(name: str) -> DataFrame:
        try:
            return table(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], S.TABLES[name])  # an empty table has no folder

    return present("videos"), present("jobs")


def commit_upload_batch(videos: DataFrame, jobs: DataFrame, uploads: DataFrame, now, folder: str) -> None:
    """X13 under U7: accepted uploads become new videos and jobs together."""
    new_v, new_j = M.uploaded_rows(M.upload_batch(uploads, now))
    seq = F.lit(0).cast("long").alias("seq")
    commit_both(upsert_videos(videos, new_v.select("*", seq)), upsert_jobs(jobs, new_j.select("*", seq)), folder)


def commit_job_batch(videos: DataFrame, jobs: DataFrame, kind: str, batch: DataFrame, now, folder: str) -> DataFrame:
    """X14 / X15 / X16 under U7: decides a start / complete / fail batch against the tables, writes
    the accepted changes of jobs and videos together and returns the outcomes."""
    decide = {"start": M.start_jobs, "complete": M.complete_jobs, "fail": M.fail_jobs}[kind]
    out = checkpoint_cut(decide(batch, jobs, videos))  # decided once, used for two tables
    acc = out.filter("accepted")
    ts = F.lit(now).cast("timestamp")
    job_cols = [F.col("job_id").alias("id"), F.col("job_status").alias("status"), ts.alias("updated_at")]
    vid_cols = [F.col("video_id").alias("id"), F.col("video_status").alias("status"), ts.alias("updated_at")]
    if kind == "complete":
        job_cols.append(F.col("job_result").alias("result"))
        vid_cols.append(F.col("video_duration").alias("duration"))
    if kind == "fail":
        job_cols.append(F.col("job_error_msg").alias("error_msg"))
    commit_both(apply_updates(videos, acc.select(*vid_cols)), apply_updates(jobs, acc.select(*job_cols)), folder)
    return out
