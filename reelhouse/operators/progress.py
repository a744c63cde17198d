"""Progress pipeline, batch form: raw transcoder text (P1), probe documents (P8), percentages
(P2), terminal events (P3), the full text -> events pipeline (P9), message decoding with a
quarantine for bad JSON (P6, P7), delivery up to the terminal event (P5) and the final
progress state per job (P4).

Scale notes
- Everything is per-row expressions plus per-job aggregates; the "first terminal event of a
  channel" and "last frame of a job" are aggregates (map-side combined) joined back on the
  job / channel key, so one job with a third of all messages never lands in one task whole.
- Per-job / per-channel summaries (probe totals, last frame, first terminal position) are
  joined back with ``joins.join_back``: broadcast when a bounded count proves them small
  (jobs in flight are far fewer than messages), else a shuffle join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import (channel_of, job_of_channel, json_text_or_absent, parse_float64, parse_int64, percentage,
                               seconds_to_ns, whole_json)
from ..session import checkpoint_cut
from .joins import join_back

FRAME_PREFIX = "frame="
EVENT_JSON_FIELDS = ["TotalFrames", "CurrentFrames", "Status", "Percentage"]


def go_trim_space(c):
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def parse_frame_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Classify each line after trimming: 'frame' (a frame= line with a valid int64),
    'bad_frame' (frame= with anything else: logged and skipped), 'ignored' (other keys)."""
    t = go_trim_space(F.col(line))
    is_frame = t.startswith(FRAME_PREFIX)
    digits = t.substr(F.lit(len(FRAME_PREFIX) + 1), F.length(t))
    value = F.when(is_frame, parse_int64(digits))
    outcome = F.when(~is_frame, "ignored").when(value.isNull(), "bad_frame").otherwise("frame")
    return lines.select(*[c for c in lines.columns if c != line], outcome.alias("outcome"), value.alias("frame"))


def parse_probes(probes: DataFrame, doc: str = "doc") -> DataFrame:
    """Probe document -> duration (float seconds -> int64 ns, truncated) and total
    frames. ``streams`` may be an object or an array (first element). Both values are strings in a
    document that is one JSON value; numbers out of range and any other failure reject."""
    d = F.col(doc)
    valid = whole_json(d) & json_text_or_absent(d, "$.format.duration") \
        & json_text_or_absent(d, "$.streams.nb_read_frames") & json_text_or_absent(d, "$.streams[0].nb_read_frames")
    dur_s = F.get_json_object(d, "$.format.duration")
    frames_s = F.coalesce(F.get_json_object(d, "$.streams.nb_read_frames"),
                          F.get_json_object(d, "$.streams[0].nb_read_frames"))
    dur = seconds_to_ns(parse_float64(dur_s))
    frames = parse_int64(frames_s)
    err = (F.when(~valid, S.ERR_PROBE_PARSE)
            .when(dur.isNull(), S.ERR_PROBE_DURATION)
            .when(frames.isNull(), S.ERR_PROBE_FRAMES))
    return probes.select(*[c for c in probes.columns if c != doc], err.isNull().alias("ok"), err.alias("error"),
                         F.when(err.isNull(), dur).alias("duration_ns"),
                         F.when(err.isNull(), frames).alias("total_frames"))


def kept_probes(parsed: DataFrame, *columns: str) -> DataFrame:
    """Columns of ``parse_probes``' outcome, computed once into a checkpoint: a filter on it would else move below
    the DISTINCT that may have made the probes, and parse a document for each row of the table under it."""
    return checkpoint_cut(parsed.select(*columns))


def usable_totals(parsed: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, total_frames) of the parsed probes whose progress can be told."""
    return kept_probes(parsed, key, "ok", "total_frames").filter(F.col("ok") & (F.col("total_frames") != 0)).select(key, "total_frames")


def progress_rejections(probes: DataFrame, key: str = "job_id") -> DataFrame:
    """F9 (progress rule) + P8 failures: the jobs whose progress never starts, with the
    error the service logs: the probe parse error, else 'total frames cannot be zero'."""
    from .integrity import progress_error
    parsed = kept_probes(parse_probes(probes), key, "error", "total_frames")
    err = F.coalesce(F.col("error"), progress_error("total_frames"))
    return parsed.select(key, err.alias("error")).filter(F.col("error").isNotNull())


def frame_percentages(frames: DataFrame, probes: DataFrame, key: str = "job_id") -> DataFrame:
    """Every valid frame line of a job with a usable total (probe ok, total != 0):
    percentage = min(frame*100 / total, 100), truncating division, no lower bound."""
    return _percentages(frames, usable_totals(probes, key), key)


def _percentages(frames: DataFrame, tot: DataFrame, key: str) -> DataFrame:
    f = frames.filter(F.col("outcome") == "frame").select(key, "event_id", "frame")
    return join_back(f, tot, key, "inner").select(key, "event_id", F.col("frame").alias("current_frames"), "total_frames",
                                   percentage("frame", "total_frames").alias("percentage"))


def event_json(total, current, status, pct):
    """S3 payload: Go field names as keys, in declaration order."""
    return F.to_json(F.struct(F.col(total).alias("TotalFrames"), F.col(current).alias("CurrentFrames"),
                              F.col(status).alias("Status"), F.col(pct).alias("Percentage")))


def progress_events(lines: DataFrame, probes: DataFrame, key: str = "job_id",
                    failed_reads: DataFrame | None = None) -> DataFrame:
    """Text -> events for each job with a usable probe: one 'continue' event per valid
    frame line in event order, then the terminal event that keeps the last frames /
    percentage (0 / 0 when no frame line): 'end' after a clean end of the text, 'error' for
    the jobs in ``failed_reads``. Rows whose percentage overflowed are left out (see
    ``percentage``). Each event has its channel and payload.

    ``failed_reads`` names jobs; with an ``event_id`` column, where the read failed (the first such place
    counts): lines from there on were not read, and the 'error' event stands there, also if no line was
    read before it."""
    failed = at = None
    if failed_reads is not None:
        at = F.min("event_id") if "event_id" in failed_reads.columns else F.lit(None).cast("long")
        failed = failed_reads.groupBy(key).agg(at.alias("_failed_at"), F.lit(True).alias("_read_failed"))
        lines = join_back(lines, failed, key, "left") \
            .filter(F.col("_failed_at").isNull() | (F.col("event_id") < F.col("_failed_at"))).select(*lines.columns)
    parsed = parse_frame_lines(lines)
    tot = usable_totals(parse_probes(probes), key)
    cont = _percentages(parsed, tot, key).filter(F.col("percentage").isNotNull())
    cont = cont.select(key, F.col("event_id").alias("seq"), F.lit(S.PROGRESS_CONTINUE).alias("status"),
                       "total_frames", "current_frames", "percentage")
    # a job's stop and last frame in one pass over the lines; a frame without a percentage is none
    counted = (F.col("outcome") == "frame") & F.try_multiply("frame", F.lit(100).cast("long")).isNotNull()
    stops = parsed.groupBy(key).agg((F.max("event_id") + 1).alias("seq"), F.max_by("frame", F.when(counted, F.col("event_id"))).alias("_last"))
    terminal = F.lit(S.PROGRESS_END)
    if failed is not None:
        stops = stops.join(failed, key, "full_outer").withColumn("seq", F.coalesce("_failed_at", "seq")).filter("seq IS NOT NULL")
        terminal = F.when(F.col("_read_failed"), F.lit(S.PROGRESS_ERROR)).otherwise(F.lit(S.PROGRESS_END))
    ends = join_back(stops, tot, key, "inner")
    ends = (ends.select(key, "seq", terminal.alias("status"), "total_frames",
                          F.coalesce("_last", F.lit(0).cast("long")).alias("current_frames"),
                          F.coalesce(percentage("_last", "total_frames"), F.lit(0).cast("long")).alias("percentage")))
    ev = cont.unionByName(ends)
    return ev.select("*", channel_of(F.col(key)).alias("channel"),
                     event_json("total_frames", "current_frames", "status", "percentage").alias("payload"))


def decode_messages(msgs: DataFrame, payload: str = "payload") -> DataFrame:
    """P6 / S2 decode: JSON payload -> progress fields. Missing keys read as zero / '' (Go
    decoding), as does the payload ``null``; anything but one JSON object or null sets
    ``malformed`` (to be logged and skipped)."""
    schema = ", ".join(["TotalFrames BIGINT", "CurrentFrames BIGINT", "Status STRING", "Percentage INT",
                        "_corrupt_record STRING"])
    j = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = msgs.select("*", j.alias("_j"))
    t = F.trim(payload)
    is_object = t.startswith("{") & F.col("_j").isNotNull() & F.col("_j._corrupt_record").isNull()
    bad = ~F.coalesce((t == "null") | (is_object & whole_json(payload)), F.lit(False))
    return out.select(*msgs.columns, bad.alias("malformed"),
                      F.coalesce("_j.TotalFrames", F.lit(0).cast("long")).alias("total_frames"),
                      F.coalesce("_j.CurrentFrames", F.lit(0).cast("long")).alias("current_frames"),
                      F.coalesce("_j.Status", F.lit("")).alias("status"),
                      F.coalesce("_j.Percentage", F.lit(0)).alias("percentage"))


def quarantine(decoded: DataFrame) -> DataFrame:
    """The malformed messages, with the log text the reader would emit."""
    return decoded.filter("malformed").select("event_id", "channel", "payload",
                                              F.lit(S.ERR_UNMARSHAL).alias("error"))


def until_terminal(msgs: DataFrame, channel: str = "channel", seq: str = "event_id") -> DataFrame:
    """P5 + P7: per channel, good messages in order up to and including the first terminal
    one (end / error); channels are isolated, the job id comes back from the channel."""
    d = decode_messages(msgs).filter(~F.col("malformed"))
    term = F.col("status").isin(*S.PROGRESS_TERMINAL)
    stops = d.groupBy(channel).agg(F.min(F.when(term, F.col(seq))).alias("_stop"))
    kept = join_back(d, stops, channel, "inner").filter(F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop")))
    return kept.select(channel, job_of_channel(F.col(channel)).alias("job_id"), seq,
                       "total_frames", "current_frames", "status", "percentage")


def progress_state(msgs: DataFrame, channel: str = "channel", seq: str = "event_id") -> DataFrame:
    """The Progress object per channel after its good messages: updates apply while the
    status is 'continue'; after end / error every further message is rejected
    ('current frames cannot be updated')."""
    d = decode_messages(msgs).filter(~F.col("malformed"))
    term = F.col("status").isin(*S.PROGRESS_TERMINAL)
    stops = d.groupBy(channel).agg(F.min(F.when(term, F.col(seq))).alias("_stop"))
    j = join_back(d, stops, channel, "inner")
    applied = F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))
    last = F.max_by(F.struct("status", "total_frames", "current_frames", "percentage", F.col(seq).alias("seq")),
                    F.when(applied, F.col(seq)))
    agg = j.groupBy(channel).agg(last.alias("_s"), F.count(F.lit(1)).alias("n_messages"),
                                 F.count(F.when(applied, 1)).alias("n_applied"))
    return agg.select(channel, job_of_channel(F.col(channel)).alias("job_id"),
                      F.col("_s.status").alias("status"), F.col("_s.total_frames").alias("total_frames"),
                      F.col("_s.current_frames").alias("current_frames"), F.col("_s.percentage").alias("percentage"),
                      F.col("_s.seq").alias("last_event_id"), "n_messages", "n_applied",
                      (F.col("n_messages") - F.col("n_applied")).alias("n_rejected"))
