"""Progress and log queries: parse_frames, probe_parse, progress_rejections, percentages,
progress_events, failed_read_events, progress_until_end, progress_quarantine, progress_state, log_envelopes,
log_quarantine, formatted_logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as LG
from ..operators import progress as P
from ..sources.fixtures import Fixtures
from .registry import register

_FRAMES_CTE = r"""
, tl AS (SELECT event_id, job_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM progress_lines),
fu AS (SELECT *, starts_with(t, 'frame=') AS is_frame, substr(t, 7) AS d FROM tl),
fl AS (SELECT event_id, job_id,
         CASE WHEN NOT is_frame THEN 'ignored'
              WHEN regexp_full_match(d, '[+-]?[0-9]+') AND TRY_CAST(d AS BIGINT) IS NOT NULL THEN 'frame'
              ELSE 'bad_frame' END AS outcome,
         CASE WHEN is_frame AND regexp_full_match(d, '[+-]?[0-9]+') THEN TRY_CAST(d AS BIGINT) END AS frame
       FROM fu)
"""

_PROBES_CTE = r"""
, pj AS (SELECT job_id, json_valid(doc) AS v, doc FROM probes),
px AS (SELECT job_id, v,
         CASE WHEN v THEN json_extract_string(doc, '$.format.duration') END AS ds,
         CASE WHEN v THEN coalesce(json_extract_string(doc, '$.streams.nb_read_frames'),
                                   json_extract_string(doc, '$.streams[0].nb_read_frames')) END AS fs
       FROM pj),
py AS (SELECT job_id, v,
         CASE WHEN regexp_full_match(ds, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(ds AS DOUBLE) END AS dur,
         CASE WHEN regexp_full_match(fs, '[+-]?[0-9]+') THEN TRY_CAST(fs AS BIGINT) END AS fr
       FROM px),
pr AS (SELECT job_id,
         CASE WHEN NOT v THEN 'parse ffprobe output' WHEN dur IS NULL THEN 'parse duration from ffprobe output'
              WHEN fr IS NULL THEN 'parse frames from ffprobe output' END AS error, dur, fr FROM py)
"""


@register("parse_frames", ["progress_lines"], _FRAMES_CTE + "SELECT event_id, job_id, outcome, frame FROM fl")
def parse_frames(spark, sf_dir):
    lines = Fixtures(spark, sf_dir).progress_lines.select("event_id", "job_id", "line")
    return P.parse_frame_lines(lines)


@register("probe_parse", ["probes"], _PROBES_CTE + """
SELECT job_id, error IS NULL AS ok, error,
  CASE WHEN error IS NULL THEN CAST(trunc(dur * 1e9) AS BIGINT) END AS duration_ns,
  CASE WHEN error IS NULL THEN fr END AS total_frames
FROM pr
""")
def probe_parse(spark, sf_dir):
    return P.parse_probes(Fixtures(spark, sf_dir).probes)


@register("probe_strict", ["probe_docs"], r"""
, k AS (SELECT event_id, doc, json_valid(doc) AND doc <> '' AS v FROM probe_docs),
x AS (SELECT event_id, CASE WHEN v THEN doc END AS doc FROM k),
y AS (SELECT event_id, doc, json_extract_string(doc, '$.format.duration') AS ds,
        coalesce(json_type(doc, '$.format.duration'), 'NULL') IN ('VARCHAR', 'NULL')
          AND coalesce(json_type(doc, '$.streams.nb_read_frames'), 'NULL') IN ('VARCHAR', 'NULL')
          AND coalesce(json_type(doc, '$.streams[0].nb_read_frames'), 'NULL') IN ('VARCHAR', 'NULL') AS texts,
        coalesce(json_extract_string(doc, '$.streams.nb_read_frames'),
                 json_extract_string(doc, '$.streams[0].nb_read_frames')) AS fs FROM x),
z AS (SELECT *, CASE WHEN abs(TRY_CAST(ds AS DOUBLE)) * 1e9 < 9.2e18 THEN TRY_CAST(trunc(TRY_CAST(ds AS DOUBLE) * 1e9) AS BIGINT) END AS ns,
        CASE WHEN regexp_full_match(fs, '[+-]?[0-9]+') THEN TRY_CAST(fs AS BIGINT) END AS fr FROM y),
e AS (SELECT *, CASE WHEN doc IS NULL OR NOT texts THEN 'parse ffprobe output'
                     WHEN ns IS NULL THEN 'parse duration from ffprobe output'
                     WHEN fr IS NULL THEN 'parse frames from ffprobe output' END AS error FROM z)
SELECT event_id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN ns END AS duration_ns,
  CASE WHEN error IS NULL THEN fr END AS total_frames FROM e
""")
def probe_strict(spark, sf_dir):
    return P.parse_probes(Fixtures(spark, sf_dir).probe_docs)


@register("progress_rejections", ["probes"], _PROBES_CTE + """
SELECT job_id, coalesce(error, CASE WHEN fr = 0 THEN 'total frames cannot be zero' END) AS error
FROM pr WHERE error IS NOT NULL OR fr = 0
""")
def progress_rejections(spark, sf_dir):
    return P.progress_rejections(Fixtures(spark, sf_dir).probes)


@register("percentages", ["progress_lines", "probes"], _FRAMES_CTE + _PROBES_CTE + """
SELECT f.job_id, f.event_id, f.frame AS current_frames, p.fr AS total_frames,
  least(f.frame * 100 // p.fr, 100) AS percentage
FROM fl f JOIN pr p ON p.job_id = f.job_id
WHERE f.outcome = 'frame' AND p.error IS NULL AND p.fr <> 0
""")
def percentages(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    frames = P.parse_frame_lines(fx.progress_lines.select("event_id", "job_id", "line"))
    return P.frame_percentages(frames, P.parse_probes(fx.probes))


@register("progress_events", ["progress_lines", "probes"], _FRAMES_CTE + _PROBES_CTE + """
, ok AS (SELECT job_id, fr AS total_frames FROM pr WHERE error IS NULL AND fr <> 0),
ev AS (SELECT f.job_id, f.event_id AS seq, 'continue' AS status, o.total_frames, f.frame AS current_frames,
         least(f.frame * 100 // o.total_frames, 100) AS percentage
       FROM fl f JOIN ok o ON o.job_id = f.job_id WHERE f.outcome = 'frame'),
lastev AS (SELECT job_id, arg_max(current_frames, seq) AS cf, arg_max(percentage, seq) AS pc FROM ev GROUP BY job_id),
ends AS (SELECT j.job_id, j.last_seq + 1 AS seq, 'end' AS status, o.total_frames,
           coalesce(l.cf, 0) AS current_frames, coalesce(l.pc, 0) AS percentage
         FROM (SELECT job_id, max(event_id) AS last_seq FROM progress_lines GROUP BY job_id) j
         JOIN ok o ON o.job_id = j.job_id LEFT JOIN lastev l ON l.job_id = j.job_id),
allev AS (SELECT * FROM ev UNION ALL SELECT * FROM ends)
SELECT job_id, seq, status, total_frames, current_frames, percentage, 'video:' || job_id || ':progress' AS channel,
  '{"TotalFrames":' || total_frames || ',"CurrentFrames":' || current_frames || ',"Status":"' || status
    || '","Percentage":' || percentage || '}' AS payload
FROM allev
""")
def progress_events(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return P.progress_events(fx.progress_lines.select("event_id", "job_id", "line"), fx.probes)


@register("failed_read_events", ["progress_lines", "probes", "read_failures"], _FRAMES_CTE + _PROBES_CTE + """
, ok AS (SELECT job_id, fr AS total_frames FROM pr WHERE error IS NULL AND fr <> 0),
ff AS (SELECT job_id, min(event_id) AS failed_at FROM read_failures GROUP BY job_id),
ev AS (SELECT f.job_id, f.event_id AS seq, 'continue' AS status, o.total_frames, f.frame AS current_frames,
         least(f.frame * 100 // o.total_frames, 100) AS percentage
       FROM fl f JOIN ok o ON o.job_id = f.job_id LEFT JOIN ff ON ff.job_id = f.job_id
       WHERE f.outcome = 'frame' AND (ff.failed_at IS NULL OR f.event_id < ff.failed_at)),
lastev AS (SELECT job_id, arg_max(current_frames, seq) AS cf, arg_max(percentage, seq) AS pc FROM ev GROUP BY job_id),
ends AS (SELECT j.job_id, coalesce(ff.failed_at, j.last_seq + 1) AS seq, CASE WHEN ff.job_id IS NULL THEN 'end' ELSE 'error' END AS status,
           o.total_frames, coalesce(l.cf, 0) AS current_frames, coalesce(l.pc, 0) AS percentage
         FROM (SELECT job_id, max(event_id) AS last_seq FROM progress_lines GROUP BY job_id) j
         JOIN ok o ON o.job_id = j.job_id LEFT JOIN ff ON ff.job_id = j.job_id LEFT JOIN lastev l ON l.job_id = j.job_id),
allev AS (SELECT * FROM ev UNION ALL SELECT * FROM ends)
SELECT job_id, seq, status, total_frames, current_frames, percentage, 'video:' || job_id || ':progress' AS channel,
  '{"TotalFrames":' || total_frames || ',"CurrentFrames":' || current_frames || ',"Status":"' || status
    || '","Percentage":' || percentage || '}' AS payload
FROM allev
""")
def failed_read_events(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return P.progress_events(fx.progress_lines.select("event_id", "job_id", "line"), fx.probes, failed_reads=fx.read_failures)


_MSGS_CTE = """
, g AS (SELECT event_id, channel, regexp_extract(channel, '^video:(.*):progress$', 1) AS job_id,
          coalesce(CAST(json_extract(payload, '$.TotalFrames') AS BIGINT), 0) AS total_frames,
          coalesce(CAST(json_extract(payload, '$.CurrentFrames') AS BIGINT), 0) AS current_frames,
          coalesce(json_extract_string(payload, '$.Status'), '') AS status,
          coalesce(CAST(json_extract(payload, '$.Percentage') AS INTEGER), 0) AS percentage
        FROM progress_msgs WHERE json_valid(payload)),
t AS (SELECT channel, min(CASE WHEN status IN ('end', 'error') THEN event_id END) AS stop FROM g GROUP BY channel)
"""


@register("progress_until_end", ["progress_msgs"], _MSGS_CTE + """
SELECT g.channel, g.job_id, g.event_id, g.total_frames, g.current_frames, g.status, g.percentage
FROM g JOIN t ON t.channel = g.channel WHERE t.stop IS NULL OR g.event_id <= t.stop
""")
def progress_until_end(spark, sf_dir):
    return P.until_terminal(Fixtures(spark, sf_dir).progress_msgs.select("event_id", "channel", "payload"))


@register("progress_quarantine", ["progress_msgs"], """
SELECT event_id, channel, payload, 'unmarshal progress' AS error FROM progress_msgs WHERE NOT json_valid(payload)
""")
def progress_quarantine(spark, sf_dir):
    msgs = Fixtures(spark, sf_dir).progress_msgs.select("event_id", "channel", "payload")
    return P.quarantine(P.decode_messages(msgs))


@register("progress_state", ["progress_msgs"], _MSGS_CTE + """
, j AS (SELECT g.*, t.stop IS NULL OR g.event_id <= t.stop AS applied FROM g JOIN t ON t.channel = g.channel)
SELECT channel, any_value(job_id) AS job_id,
  arg_max(status, CASE WHEN applied THEN event_id END) AS status,
  arg_max(total_frames, CASE WHEN applied THEN event_id END) AS total_frames,
  arg_max(current_frames, CASE WHEN applied THEN event_id END) AS current_frames,
  arg_max(percentage, CASE WHEN applied THEN event_id END) AS percentage,
  max(CASE WHEN applied THEN event_id END) AS last_event_id,
  count(*) AS n_messages, count(CASE WHEN applied THEN 1 END) AS n_applied,
  count(*) - count(CASE WHEN applied THEN 1 END) AS n_rejected
FROM j GROUP BY channel
""")
def progress_state(spark, sf_dir):
    return P.progress_state(Fixtures(spark, sf_dir).progress_msgs.select("event_id", "channel", "payload"))


@register("log_envelopes", ["log_records"], f"""
SELECT event_id, level, 'logs:{LG.APP_NAME}:' || level AS channel,
  '{{"category":' || to_json(category) || ',"level":' || to_json(level) || ',"message":' || to_json(message)
    || CASE WHEN coalesce(source_id, '') <> '' THEN ',"source_id":' || to_json(source_id) ELSE '' END || '}}' AS envelope
FROM log_records
WHERE category IN ('default', 'video', 'job', 'auth') AND level IN ('info', 'warn', 'error')
""")
def log_envelopes(spark, sf_dir):
    return LG.log_envelopes(Fixtures(spark, sf_dir).log_records)


@register("log_quarantine", ["log_records"], """
SELECT event_id, category, level, message,
  CASE WHEN NOT coalesce(category IN ('default', 'video', 'job', 'auth'), false) THEN 'invalid category'
       ELSE 'invalid level' END AS reason
FROM log_records
WHERE NOT coalesce(category IN ('default', 'video', 'job', 'auth') AND level IN ('info', 'warn', 'error'), false)
""")
def log_quarantine(spark, sf_dir):
    return LG.log_quarantine(Fixtures(spark, sf_dir).log_records)


@register("formatted_logs", ["log_calls"], recursive=True, oracle=f"""
, c AS (SELECT *, regexp_extract_all(template, '%.|%$|[^%]+') AS parts,
          CASE WHEN args_text = '' THEN [] ELSE string_split(args_text, ',') END AS args FROM log_calls),
r AS (
  SELECT event_id, 0 AS k, 0 AS n, '' AS out FROM c
  UNION ALL
  SELECT event_id, k, n + CASE WHEN starts_with(p, '%') AND p NOT IN ('%', '%%') AND n < len(args) THEN 1 ELSE 0 END,
    out || CASE WHEN NOT starts_with(p, '%') THEN p WHEN p = '%%' THEN '%' WHEN p = '%' THEN '%!(NOVERB)'
                WHEN n >= len(args) THEN '%!' || p[2] || '(MISSING)'
                WHEN p IN ('%s', '%v') OR (p = '%d' AND regexp_full_match(args[n + 1], '-?[0-9]+')) THEN args[n + 1]
                ELSE '%!' || p[2] || '(string=' || args[n + 1] || ')' END
  FROM (SELECT r.event_id, r.k + 1 AS k, r.n, r.out, c.args, c.parts[r.k + 1] AS p FROM r JOIN c ON c.event_id = r.event_id AND r.k < len(c.parts)) x),
m AS (SELECT c.event_id, c.level, c.category, c.source_id, r.out || CASE WHEN r.n < len(c.args) THEN '%!(EXTRA ' ||
         array_to_string(list_transform(c.args[r.n + 1:], lambda x: 'string=' || x), ', ') || ')' ELSE '' END AS message
      FROM r JOIN c ON c.event_id = r.event_id AND r.k = len(c.parts))
SELECT event_id, level, 'logs:{LG.APP_NAME}:' || level AS channel,
  '{{"category":' || to_json(category) || ',"level":' || to_json(level) || ',"message":' || to_json(message)
    || CASE WHEN coalesce(source_id, '') <> '' THEN ',"source_id":' || to_json(source_id) ELSE '' END || '}}' AS envelope
FROM m
""")
def formatted_logs(spark, sf_dir):
    calls = Fixtures(spark, sf_dir).log_calls
    none = F.array().cast("array<string>")
    return LG.formatted_envelopes(calls.withColumn("args", F.when(F.col("args_text") == "", none).otherwise(F.split("args_text", ","))))
