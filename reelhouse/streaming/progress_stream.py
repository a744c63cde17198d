"""Structured Streaming forms of the progress pipeline. All work is built-in functions.

- S2 source: ``readStream`` of JSON message files (channel, event_id, payload). Kafka is a
  format swap: key = channel, value = payload, ordered per channel by its partitioning.
- P6: payloads are decoded with ``from_json``; malformed ones go to a quarantine sink (a
  second query over the same source, with its own checkpoint); the stream goes on.
- P5: each micro-batch delivers the messages up to and including a channel's first terminal
  one. That point is an aggregate (combined map-side), so a channel holding a third of a batch
  is no single task's work. Closed channels are kept in a table (``BatchState``) and drop later
  messages however late they come; no clock decides.
- J5: each delivered message joined with the latest job of its video.
- S3 sink: key = channel, value = JSON payload.

Each micro-batch overwrites the folder of its batch id in the sink, so a batch that runs again
leaves its rows once. A sink folder is a table partitioned by ``batch``.

The delivery rule follows arrival order (as a pub/sub reader does), inside a micro-batch the
order of event ids. When the input arrives in event order the result equals the batch operator
``progress.until_terminal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.exprs import channel_of, job_of_channel, percentage
from ..operators.progress import decode_messages, event_json, go_trim_space, parse_frame_lines, quarantine
from ..session import checkpoint_cut
from .batch_state import BatchState

MSG_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("channel", T.StringType()),
                           T.StructField("payload", T.StringType())])
DELIVERED = ["channel", "event_id", "total_frames", "current_frames", "status", "percentage"]
CLOSED = T.StructType([T.StructField("channel", T.StringType())])
LAST = 9223372036854775807  # rows without a position come last


def read_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of message files (JSON lines with event_id, channel, payload)."""
    r = spark.readStream.schema(MSG_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def deliver(messages: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5 on one micro-batch: (delivered messages, channels closed by it). ``closed`` are the
    channels closed before."""
    at = F.coalesce(F.col("event_id"), F.lit(LAST))
    good = decode_messages(messages).filter(~F.col("malformed")).select(*DELIVERED) \
        .join(closed.select("channel"), "channel", "left_anti")
    stops = good.filter(F.col("status").isin(*S.PROGRESS_TERMINAL)).groupBy("channel").agg(F.min(at).alias("_stop"))
    kept = good.join(stops, "channel", "left").filter(F.col("_stop").isNull() | (at <= F.col("_stop")))
    return kept.select(*DELIVERED, job_of_channel("channel").alias("job_id")), stops.select("channel")


def as_published(delivered: DataFrame) -> DataFrame:
    """S3 sink shape: key = channel, value = JSON payload."""
    return delivered.select(F.col("channel").alias("key"),
                            event_json("total_frames", "current_frames", "status", "percentage").alias("value"))


def run_progress_stream(spark: SparkSession, in_path: str, out_path: str, quarantine_path: str,
                        checkpoint: str, max_files_per_trigger: int | None = None,
                        latest_jobs: DataFrame | None = None) -> None:
    """Run the progress stream over everything available now (``availableNow``), writing
    delivered messages and quarantined ones. With ``latest_jobs`` the delivered messages are
    joined to it (J5)."""
    msgs = read_messages(spark, in_path, max_files_per_trigger)
    if latest_jobs is not None:
        # read by every micro-batch: materialised once (reliable checkpoint in the shared folder)
        latest_jobs = checkpoint_cut(latest_jobs.select("id", "video_id"))
    state = BatchState(spark, checkpoint + "/closed", CLOSED, "channel")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            out, closed = deliver(batch, state.before(batch_id))
            if latest_jobs is not None:
                out = progress_for_video(out, latest_jobs)
            out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            state.write(batch_id, closed)
        finally:
            batch.unpersist()

    q = (msgs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint + "/delivered")
         .trigger(availableNow=True).start())
    qb = (quarantine(decode_messages(msgs)).writeStream.format("parquet").option("path", quarantine_path)
          .option("checkpointLocation", checkpoint + "/quarantine").outputMode("append")
          .trigger(availableNow=True).start())
    q.awaitTermination()
    qb.awaitTermination()


def progress_for_video(delivered: DataFrame, latest_jobs: DataFrame) -> DataFrame:
    """Each delivered message of the latest job of a video."""
    lj = latest_jobs.select(F.col("id").alias("job_id"), "video_id")
    return delivered.join(lj, "job_id")


# ---------------------------------------------------------------- P9 as a stream (S4 -> S3)
LINE_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("job_id", T.StringType()),
                            T.StructField("line", T.StringType())])
TEXT_STATE = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("closed", T.BooleanType()),
                           T.StructField("current_frames", T.LongType()), T.StructField("percentage", T.LongType())])
# Lines that close a text: the transcoder's own last one, and the one a reader adds after a
# failed read.
END_LINE, ERROR_LINE = "progress=end", "progress=error"


def text_to_events(lines: DataFrame, totals: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P1 + P2 + P3 on one micro-batch: (events, changed state). Per job 'continue' events in
    offset order up to its first closing line, then one terminal event with the last frames /
    percentage, of this batch or of the state ``before`` it. Jobs without a usable probe total
    (missing, failed, 0) emit nothing."""
    parsed = parse_frame_lines(lines.select("event_id", "job_id", "line", go_trim_space(F.col("line")).alias("_t")))
    closing = F.when(F.col("_t") == END_LINE, S.PROGRESS_END).when(F.col("_t") == ERROR_LINE, S.PROGRESS_ERROR)
    rows = (parsed.join(totals.select("job_id", "total_frames"), "job_id")
            .join(before.filter("closed").select("job_id"), "job_id", "left_anti")
            .select("job_id", F.coalesce("event_id", F.lit(LAST)).alias("seq"), "total_frames", closing.alias("closing"),
                    F.when(F.col("outcome") == "frame", F.col("frame")).alias("current_frames"),
                    percentage("frame", "total_frames").alias("percentage")))
    stops = rows.filter(F.col("closing").isNotNull()).groupBy("job_id") \
        .agg(F.min(F.struct("seq", "closing", "total_frames")).alias("_stop"))
    frames = (rows.filter(F.col("percentage").isNotNull()).join(stops, "job_id", "left")
              .filter(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop.seq"))))
    last = frames.groupBy("job_id").agg(F.max_by(F.struct("current_frames", "percentage"), "seq").alias("_l"))
    old = before.select("job_id", F.col("current_frames").alias("_c"), F.col("percentage").alias("_p"))
    zero = F.lit(0).cast("long")
    state = last.join(stops, "job_id", "full").join(old, "job_id", "left").select(
        "job_id", "_stop", F.col("_stop").isNotNull().alias("closed"),
        F.coalesce("_l.current_frames", "_c", zero).alias("current_frames"),
        F.coalesce("_l.percentage", "_p", zero).alias("percentage"))
    ends = state.filter("closed").select("job_id", F.col("_stop.seq").alias("seq"), F.col("_stop.closing").alias("status"),
                                         F.col("_stop.total_frames").alias("total_frames"), "current_frames", "percentage")
    events = frames.select("job_id", "seq", F.lit(S.PROGRESS_CONTINUE).alias("status"), "total_frames", "current_frames",
                           "percentage").unionByName(ends)
    return events.withColumn("channel", channel_of("job_id")), state.drop("_stop")


def run_events_stream(spark: SparkSession, in_path: str, totals: DataFrame, out_path: str, checkpoint: str,
                      max_files_per_trigger: int | None = None) -> None:
    """S4 records (event_id, job_id, line) -> events, with the payload that S3 publishes."""
    r = spark.readStream.schema(LINE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # probe totals: materialised once, not re-parsed in every micro-batch
    totals = checkpoint_cut(totals.select("job_id", "total_frames"))
    state = BatchState(spark, checkpoint + "/jobs", TEXT_STATE, "job_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            events, changed = text_to_events(batch, totals, state.before(batch_id))
            payload = event_json("total_frames", "current_frames", "status", "percentage").alias("payload")
            events.select("*", payload).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            state.write(batch_id, changed)
        finally:
            batch.unpersist()

    q = (r.json(in_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint + "/lines")
         .trigger(availableNow=True).start())
    q.awaitTermination()
