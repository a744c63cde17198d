"""Coupled replay (X14-X16 over X2-X4, X7, X9-X11): interleaved start, complete and fail commands
for many jobs of many videos, each judged against what the accepted ones before it left.

A command changes its job and its job's video together, so neither table can be replayed alone, and
the commands of one video don't compose into a small function (its jobs' states are part of it).
But only accepted commands change anything.

Videos with at most ``FOLD_COMMANDS`` commands in a distinct order, that is nearly all, are folded: their
commands are collected, sorted and judged one after the other. The others go in rounds. Each round finds, per video, the first command that
the video's present state accepts (an aggregate, combined map-side): all commands before it are thereby
rejected, it is applied, and those after it go on to the next round with the new states. A video without
such a command is settled. There are as many rounds as the longest chain of accepted commands in one
video, plus one, however many commands are rejected; rows that are settled leave, and a video that
owns most rows is spread over all tasks in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import first_error
from ..session import checkpoint_cut, measured_side, scratch_path
from .joins import join_back

#: Most commands of a video that are collected into one row; a video with more goes in rounds.
FOLD_COMMANDS = 256

START, COMPLETE, FAIL = "start", "complete", "fail"
#: Job and video status after each accepted command.
JOB_AFTER = {START: S.JOB_RUNNING, COMPLETE: S.JOB_COMPLETED, FAIL: S.JOB_FAILED}
VIDEO_AFTER = {START: S.VIDEO_PROCESSING, COMPLETE: S.VIDEO_PUBLISHED, FAIL: S.VIDEO_FAILED}


def _after(cmd: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), cmd)


def _rejection(cmd: Column, job: Column, video: Column, video_duration: Column, duration: Column) -> Column:
    """The first rule that the command breaks: the job's, then the video's."""
    startable = job.isin(S.JOB_PENDING, S.JOB_FAILED)
    return first_error(
        (~cmd.isin(START, COMPLETE, FAIL) | cmd.isNull(), "unknown command"),
        (job.isNull(), S.ERR_JOB_NOT_FOUND),
        ((cmd == START) & ~startable, S.ERR_JOB_CANNOT_START),
        ((cmd == COMPLETE) & (job != S.JOB_RUNNING), S.ERR_JOB_CANNOT_COMPLETE),
        ((cmd == FAIL) & (job != S.JOB_RUNNING), S.ERR_JOB_CANNOT_FAIL),
        (video.isNull(), S.ERR_VIDEO_NOT_FOUND),
        ((cmd == START) & ~video.isin(S.VIDEO_PENDING, S.VIDEO_FAILED), S.ERR_VIDEO_CANNOT_PROCESS),
        ((cmd == COMPLETE) & (video_duration != 0), S.ERR_DURATION_SET),
        ((cmd == COMPLETE) & (F.coalesce(duration, F.lit(0)) < 0), S.ERR_DURATION_NEGATIVE),
        ((cmd == COMPLETE) & (video != S.VIDEO_PROCESSING), S.ERR_VIDEO_CANNOT_PUBLISH),
        ((cmd == FAIL) & (video != S.VIDEO_PROCESSING), S.ERR_VIDEO_CANNOT_FAIL),
    )


def _row_rejection() -> Column:
    return _rejection(*[F.col(c) for c in ("cmd", "job_status", "video_status", "video_duration", "duration")])


def _named_once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(cmds: Column) -> Column:
    """A video's sorted commands with the states that each met and its error. The state: the video's
    status and duration, the status of each job that changed, and the commands so far."""
    def step(acc: Column, c: Column) -> Column:
        job = F.coalesce(F.element_at(acc["jobs"], c["job_id"]), c["job_status"])
        met = F.struct(job.alias("job_status"), acc["video_status"].alias("video_status"), acc["video_duration"].alias("video_duration"),
                       _rejection(c["cmd"], job, acc["video_status"], acc["video_duration"], c["duration"]).alias("error"))

        def after(m: Column) -> Column:
            took = m["error"].isNull()
            jobs = F.map_concat(F.map_filter(acc["jobs"], lambda k, _: k != c["job_id"]), F.create_map(c["job_id"], _after(c["cmd"], JOB_AFTER)))
            return F.struct(
                F.when(took, _after(c["cmd"], VIDEO_AFTER)).otherwise(m["video_status"]).alias("video_status"),
                F.when(took & (c["cmd"] == COMPLETE), F.coalesce(c["duration"], F.lit(0).cast("long"))).otherwise(m["video_duration"]).alias("video_duration"),
                F.when(took, jobs).otherwise(acc["jobs"]).alias("jobs"), F.concat(acc["met"], F.array(m)).alias("met"))

        return _named_once(met, after)

    first = F.get(cmds, F.lit(0))
    start = F.struct(first["video_status"].alias("video_status"), first["video_duration"].alias("video_duration"),
                     F.create_map().cast("map<string,string>").alias("jobs"),
                     F.array().cast("array<struct<job_status:string,video_status:string,video_duration:bigint,error:string>>").alias("met"))
    return F.zip_with(cmds, F.aggregate(cmds, start, step, lambda acc: acc["met"]), lambda c, m: F.struct(c.alias("c"), m.alias("m")))


def _folded(todo: DataFrame, cols: list[str], path: str) -> DataFrame:
    """Writes the outcome of the commands whose videos can be folded; returns the other commands."""
    spark = todo.sparkSession
    many = todo.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("seq").alias("_d"))
    many = many.filter((F.col("_n") > FOLD_COMMANDS) | (F.col("_d") < F.col("_n"))).select("video_id")
    many, small = measured_side(many)
    many = F.broadcast(many) if small else many
    each = F.struct("seq", *[c for c in cols if c not in ("seq", "video_id")])
    videos = todo.join(many, "video_id", "left_anti").groupBy("video_id").agg(F.array_sort(F.collect_list(each)).alias("cmds"))
    judged = videos.select("video_id", F.explode(_fold(F.col("cmds"))).alias("x"))
    met = ("job_status", "video_status", "video_duration")
    judged.select(*["video_id" if c == "video_id" else F.col(f"x.m.{c}" if c in met else f"x.c.{c}").alias(c) for c in cols],
                  F.col("x.m.error").alias("error")).write.parquet(path)
    return todo.join(many, "video_id", "left_semi").select(*todo.columns)


def replay_job_batch(cmds: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """Every command (seq, job_id, cmd, duration, result, error_msg) with its outcome and what it left.

    ``seq`` orders the commands of a video and must be distinct and non-null there (ValueError if no
    round can settle it otherwise). A null duration counts as 0. Returns seq, job_id, video_id, cmd,
    accepted, error, and after the command: job_status, job_result, job_error_msg (what an accepted command wrote),
    video_status, video_duration."""
    cols = ["seq", "job_id", "video_id", "cmd", "duration", "result", "error_msg", "job_status", "video_status", "video_duration"]
    j = jobs.select(F.col("id").alias("job_id"), "video_id", F.col("status").alias("job_status"))
    v = videos.select(F.col("id").alias("video_id"), F.col("status").alias("video_status"), F.col("duration").alias("video_duration"))
    todo = cmds.select("seq", "job_id", "cmd", "duration", "result", "error_msg").join(j, "job_id", "left").join(v, "video_id", "left")
    todo = todo.select(*cols)
    todo = checkpoint_cut(todo.withColumn("error", _row_rejection()))
    folder = scratch_path(cmds.sparkSession, "job-replay")  # what a round settles is written there, one table for all rounds
    todo.filter("video_status IS NULL").write.parquet(f"{folder}/round=0")  # without a video nothing changes: judged once
    rest, n = _folded(todo.filter("video_status IS NOT NULL"), cols, f"{folder}/round=folded"), 0
    left = not rest.isEmpty()
    while left:
        # of the accepted commands the first; the state that it leaves
        won = rest.filter(F.col("error").isNull()).groupBy("video_id").agg(
            F.min(F.struct("seq", "job_id", "cmd", F.coalesce("duration", F.lit(0).cast("long")).alias("duration"))).alias("_w"))
        judged = join_back(rest, won, "video_id", "left")
        later = F.coalesce(F.col("seq") > F.col("_w.seq"), F.lit(False))
        here = F.coalesce((F.col("seq") == F.col("_w.seq")) & (F.col("job_id") == F.col("_w.job_id")), F.lit(False))
        judged = checkpoint_cut(judged.select(*cols, "error", "_w", later.alias("_later"), here.alias("_here")))
        n += 1
        judged.filter("NOT _later").select(*cols, "error").write.parquet(f"{folder}/round={n}")
        left, unsettled = judged.agg(F.count_if("_later"), F.count_if(F.expr("NOT _later AND NOT _here AND error IS NULL"))).first()
        if unsettled:
            raise ValueError("commands of one video need distinct values of seq, none of them null")
        own = F.col("job_id") == F.col("_w.job_id")
        rest = judged.filter("_later").select(
            "seq", "job_id", "video_id", "cmd", "duration", "result", "error_msg",
            F.when(own, _after(F.col("_w.cmd"), JOB_AFTER)).otherwise(F.col("job_status")).alias("job_status"),
            _after(F.col("_w.cmd"), VIDEO_AFTER).alias("video_status"),
            F.when(F.col("_w.cmd") == COMPLETE, F.col("_w.duration")).otherwise(F.col("video_duration")).alias("video_duration"))
        rest = rest.withColumn("error", _row_rejection())
    out = cmds.sparkSession.read.schema(todo.schema).parquet(folder).select(*cols, "error")
    ok = F.col("error").isNull()
    return out.select(
        "seq", "job_id", "video_id", "cmd", ok.alias("accepted"), "error",
        F.when(ok, _after(F.col("cmd"), JOB_AFTER)).otherwise(F.col("job_status")).alias("job_status"),
        F.when(ok & (F.col("cmd") == COMPLETE), F.col("result")).alias("job_result"),
        F.when(ok & (F.col("cmd") == FAIL), F.col("error_msg")).alias("job_error_msg"),
        F.when(ok, _after(F.col("cmd"), VIDEO_AFTER)).otherwise(F.col("video_status")).alias("video_status"),
        F.when(ok & (F.col("cmd") == COMPLETE), F.coalesce("duration", F.lit(0).cast("long"))).otherwise(F.col("video_duration")).alias("video_duration"))


def replayed_states(outcomes: DataFrame, jobs: DataFrame, videos: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The jobs and videos tables after a replayed batch: the last accepted command of each row
    decides its status, the last one that wrote a column decides that column."""
    acc, ts = outcomes.filter("accepted"), F.lit(now).cast("timestamp")

    def last(column: str, when: Column | None = None) -> Column:
        value = F.struct("seq", column)
        return F.max(value if when is None else F.when(when, value))[column]

    j = acc.groupBy(F.col("job_id").alias("id")).agg(
        last("job_status").alias("_s"), last("job_result", F.col("cmd") == COMPLETE).alias("_r"),
        last("job_error_msg", F.col("cmd") == FAIL).alias("_e"))
    jobs_after = join_back(jobs, j, "id", "left").select(
        "id", "video_id", "type", F.coalesce("_s", "status").alias("status"), F.coalesce("_r", "result").alias("result"),
        F.coalesce("_e", "error_msg").alias("error_msg"), "created_at",
        F.when(F.col("_s").isNotNull(), ts).otherwise(F.col("updated_at")).alias("updated_at"))
    v = acc.groupBy(F.col("video_id").alias("id")).agg(last("video_status").alias("_s"), last("video_duration").alias("_d"))
    after = [F.coalesce("_s", "status").alias("status"), F.coalesce("_d", "duration").alias("duration"),
             F.when(F.col("_s").isNotNull(), ts).otherwise(F.col("updated_at")).alias("updated_at")]
    named = {"status": after[0], "duration": after[1], "updated_at": after[2]}
    return jobs_after, join_back(videos, v, "id", "left").select(*[named.get(c, F.col(c)) for c in videos.columns])
