"""State-machine queries: replay_video, replay_job, set_duration, rename_user, archive_videos,
upload_batch, start_jobs, complete_jobs, fail_jobs, signup_batch, login_claims, replay_job_batch,
replay_video_edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import job_replay as J
from ..operators import lookup as L
from ..operators import machine as M
from ..operators import rbac as R
from ..sources.fixtures import Fixtures
from .registry import register

NOW = "2024-01-15 00:00:00"

_VIDEO_STEP_ERR = """CASE WHEN c.cmd = 'process' AND r.status NOT IN ('pending', 'failed') THEN 'video cannot be marked as processing'
               WHEN c.cmd = 'publish' AND r.status <> 'processing' THEN 'video cannot be published'
               WHEN c.cmd = 'fail' AND r.status <> 'processing' THEN 'video cannot be marked as failed'
               WHEN c.cmd = 'archive' AND r.status <> 'published' THEN 'video cannot be archived'
               WHEN c.cmd NOT IN ('process', 'publish', 'fail', 'archive', 'update') THEN 'unknown command' END"""


@register("replay_video", ["video_cmds"], recursive=True, oracle=f"""
, c AS (SELECT video_id, cmd, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM video_cmds),
r AS (
  SELECT video_id, CAST(0 AS BIGINT) AS rn, 'pending' AS status, CAST(0 AS BIGINT) AS n_acc,
         CAST(NULL AS VARCHAR) AS last_error
  FROM c WHERE rn = 1
  UNION ALL
  SELECT video_id, rn, CASE WHEN e IS NULL THEN ns ELSE status END, n_acc + CASE WHEN e IS NULL THEN 1 ELSE 0 END,
         coalesce(e, last_error)
  FROM (SELECT r.video_id, c.rn, r.status, r.n_acc, r.last_error,
          CASE c.cmd WHEN 'process' THEN 'processing' WHEN 'publish' THEN 'published' WHEN 'fail' THEN 'failed'
                     WHEN 'archive' THEN 'archived' ELSE r.status END AS ns,
          {_VIDEO_STEP_ERR} AS e
        FROM r JOIN c ON c.video_id = r.video_id AND c.rn = r.rn + 1) x)
SELECT video_id, true AS found, arg_max(status, rn) AS status, max(rn) AS n_commands, arg_max(n_acc, rn) AS n_accepted,
  max(rn) - arg_max(n_acc, rn) AS n_rejected, arg_max(last_error, rn) AS last_error
FROM r GROUP BY video_id
""")
def replay_video(spark, sf_dir):
    cmds = Fixtures(spark, sf_dir).video_cmds
    return M.VIDEO_MACHINE.replay(cmds, "video_id", "seq", "cmd", initial_state="pending")


@register("replay_job", ["job_cmds", "jobs"], recursive=True, oracle="""
, c AS (SELECT job_id, cmd, result, error_msg, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM job_cmds),
ids AS (SELECT job_id, count(*) AS n FROM c GROUP BY job_id),
r AS (
  SELECT i.job_id, CAST(0 AS BIGINT) AS rn, j.status, CAST(0 AS BIGINT) AS n_acc, CAST(NULL AS VARCHAR) AS last_error,
         j.result, j.error_msg
  FROM ids i JOIN jobs j ON j.id = i.job_id
  UNION ALL
  SELECT job_id, rn, CASE WHEN e IS NULL THEN ns ELSE status END, n_acc + CASE WHEN e IS NULL THEN 1 ELSE 0 END,
         coalesce(e, last_error),
         CASE WHEN e IS NULL AND cmd = 'complete' THEN cres ELSE result END,
         CASE WHEN e IS NULL AND cmd = 'fail' THEN cerr ELSE error_msg END
  FROM (SELECT r.job_id, c.rn, r.status, r.n_acc, r.last_error, r.result, r.error_msg, c.cmd,
               c.result AS cres, c.error_msg AS cerr,
          CASE c.cmd WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed'
                     ELSE r.status END AS ns,
          CASE WHEN c.cmd = 'start' AND r.status NOT IN ('pending', 'failed') THEN 'job cannot be started'
               WHEN c.cmd = 'complete' AND r.status <> 'running' THEN 'job cannot be completed'
               WHEN c.cmd = 'fail' AND r.status <> 'running' THEN 'job cannot be marked as failed'
               WHEN c.cmd NOT IN ('start', 'complete', 'fail') THEN 'unknown command' END AS e
        FROM r JOIN c ON c.job_id = r.job_id AND c.rn = r.rn + 1) x),
fin AS (SELECT job_id, arg_max(status, rn) AS status, arg_max(n_acc, rn) AS n_acc, arg_max(last_error, rn) AS last_error,
               arg_max(result, rn) AS result, arg_max(error_msg, rn) AS error_msg FROM r GROUP BY job_id)
SELECT i.job_id, f.job_id IS NOT NULL AS found, f.status, i.n AS n_commands, coalesce(f.n_acc, 0) AS n_accepted,
  i.n - coalesce(f.n_acc, 0) AS n_rejected,
  CASE WHEN f.job_id IS NULL THEN 'job not found' ELSE f.last_error END AS last_error, f.error_msg, f.result
FROM ids i LEFT JOIN fin f ON f.job_id = i.job_id
""")
def replay_job(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    init = fx.jobs.select(F.col("id").alias("job_id"), "status", "result", "error_msg")
    return M.JOB_MACHINE.replay(fx.job_cmds, "job_id", "seq", "cmd",
                                payload={"result": "result", "error_msg": "error_msg"}, initial=init)


@register("set_duration", ["duration_requests", "videos"], recursive=True, oracle="""
, q AS (SELECT d.*, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM duration_requests d),
r AS (
  SELECT v.id, v.id IS NOT NULL AS found, k.id AS kid, v.duration AS cur, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS err
  FROM (SELECT DISTINCT id FROM q) k LEFT JOIN videos v ON v.id = k.id
  UNION ALL
  SELECT id, found, kid, CASE WHEN e IS NULL THEN duration ELSE cur END, rn, seq, e
  FROM (SELECT r.id, r.found, r.kid, r.cur, q.rn, q.seq, q.duration,
          CASE WHEN NOT r.found THEN 'video not found' WHEN r.cur <> 0 THEN 'video duration has already been set'
               WHEN q.duration < 0 THEN 'video duration cannot be negative' END AS e
        FROM r JOIN q ON q.id = r.kid AND q.rn = r.rn + 1) x)
SELECT kid AS id, seq, err IS NULL AS accepted, err AS error, cur AS duration FROM r WHERE rn > 0
""")
def set_duration(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return M.set_duration(fx.duration_requests, fx.videos)


@register("rename_user", ["users", "user_changes"], f"""
, l AS (SELECT id, arg_max(username, seq) AS nu FROM user_changes GROUP BY id)
SELECT u.id, coalesce(l.nu, u.username) AS username,
  CASE WHEN l.nu IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE u.updated_at END AS updated_at
FROM users u LEFT JOIN l ON l.id = u.id
""")
def rename_user(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return M.rename_users(fx.users, fx.user_changes, NOW)


@register("archive_videos", ["video_keys", "videos"], """
SELECT id, err IS NULL AS accepted, err AS error, CASE WHEN err IS NULL THEN 'archived' ELSE status END AS status
FROM (SELECT k.id, v.status,
        CASE WHEN v.id IS NULL THEN 'video not found' WHEN v.status <> 'published' THEN 'video cannot be archived' END AS err
      FROM (SELECT DISTINCT id FROM video_keys) k LEFT JOIN videos v ON v.id = k.id) t
""")
def archive_videos(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return M.archive_videos(fx.video_keys, fx.videos)


@register("upload_batch", ["uploads"], f"""
SELECT upload_id, CASE WHEN ok THEN 'vid-'||upload_id END AS video_id, CASE WHEN ok THEN 'job-'||upload_id END AS job_id,
  ok AS accepted, err AS error, CASE WHEN ok THEN 'pending' END AS status, CASE WHEN ok THEN resource_id END AS resource_id,
  title, description, filename, CASE WHEN ok THEN TIMESTAMP '{NOW}' END AS created_at
FROM (SELECT *, err IS NULL AS ok FROM (
  SELECT *, CASE WHEN coalesce(upload_id, '') = '' THEN 'video id cannot be empty'
                 WHEN coalesce(filename, '') = '' THEN 'file name cannot be empty'
                 WHEN coalesce(resource_id, '') = '' THEN 'resource id cannot be empty' END AS err FROM uploads) a) b
""")
def upload_batch(spark, sf_dir):
    return M.upload_batch(Fixtures(spark, sf_dir).uploads, NOW)


def _batch_oracle(batch_sql: str, extra_cols: str, eligible: str, after_state: str, err: str, select: str,
                  job_state: str) -> str:
    return f"""
, x AS (SELECT b.*, j.video_id, j.status AS job_status, v.id IS NOT NULL AS vfound{extra_cols}
        FROM ({batch_sql}) b LEFT JOIN jobs j ON j.id = b.job_id LEFT JOIN videos v ON v.id = j.video_id),
e AS (SELECT *, {eligible} AS eligible FROM x),
w AS (SELECT video_id, seq AS wseq, job_id AS wjob, wdur FROM (
        SELECT *, {"duration" if "duration" in extra_cols else "NULL"} AS wdur,
               row_number() OVER (PARTITION BY video_id ORDER BY seq, job_id) AS rn FROM e WHERE eligible) t WHERE rn = 1),
y AS (SELECT e.*, coalesce(e.seq = w.wseq AND e.job_id = w.wjob, false) AS winner,
        coalesce(e.seq > w.wseq OR (e.seq = w.wseq AND e.job_id > w.wjob), false) AS after, w.wdur, w.wjob
      FROM e LEFT JOIN w ON e.video_id = w.video_id),
z AS (SELECT *, {after_state} FROM y),
r AS (SELECT * REPLACE (CASE WHEN after AND job_id = wjob THEN '{job_state}' ELSE job_status END AS job_status), job_status AS job_was FROM z),
r2 AS (SELECT *, {err} AS err FROM r)
SELECT seq, job_id, video_id, winner AS accepted, CASE WHEN NOT winner THEN err END AS error, {select} FROM r2
"""


@register("start_jobs", ["jobs", "videos"], _batch_oracle(
    "SELECT id AS job_id, created_at + INTERVAL (d) DAY AS seq FROM jobs, (SELECT unnest([0, 1]) AS d) t "
    "WHERE status = 'pending' AND type = 'transcode'",
    ", v.status AS video_status, v.resource_id, v.filename AS source_filename",
    "coalesce(job_status IN ('pending', 'failed'), false) AND vfound AND video_status IN ('pending', 'failed')",
    "CASE WHEN after THEN 'processing' ELSE video_status END AS vstat",
    """CASE WHEN job_status IS NULL THEN 'job not found' WHEN NOT coalesce(job_status IN ('pending', 'failed'), false)
         THEN 'job cannot be started' WHEN NOT vfound THEN 'video not found'
         WHEN NOT coalesce(vstat IN ('pending', 'failed'), false) THEN 'video cannot be marked as processing' END""",
    """CASE WHEN winner THEN 'running' ELSE job_was END AS job_status,
       CASE WHEN winner THEN 'processing' ELSE video_status END AS video_status,
       CASE WHEN winner THEN resource_id END AS resource_id, CASE WHEN winner THEN source_filename END AS source_filename""",
    "running"))
def start_jobs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    jobs = L.runnable_jobs(fx.jobs).select(F.col("id").alias("job_id"), F.col("created_at").alias("seq"))
    batch = jobs.unionByName(jobs.withColumn("seq", F.col("seq") + F.expr("INTERVAL 1 DAY")))  # each sent again a day later
    return M.start_jobs(batch, fx.jobs, fx.videos)


@register("complete_jobs", ["job_outcomes", "jobs", "videos"], _batch_oracle(
    "SELECT seq, job_id, result, duration FROM job_outcomes WHERE outcome = 'complete'",
    ", v.status AS video_status, v.duration AS video_duration",
    "coalesce(job_status = 'running', false) AND vfound AND video_duration = 0 AND duration >= 0 "
    "AND video_status = 'processing'",
    "CASE WHEN after THEN wdur ELSE video_duration END AS vdur, CASE WHEN after THEN 'published' ELSE video_status END AS vstat",
    """CASE WHEN job_status IS NULL THEN 'job not found' WHEN NOT coalesce(job_status = 'running', false)
         THEN 'job cannot be completed' WHEN NOT vfound THEN 'video not found'
         WHEN vdur <> 0 THEN 'video duration has already been set' WHEN duration < 0 THEN 'video duration cannot be negative'
         WHEN vstat <> 'processing' THEN 'video cannot be published' END""",
    """CASE WHEN winner THEN 'completed' ELSE job_was END AS job_status, CASE WHEN winner THEN result END AS job_result,
       CASE WHEN winner THEN 'published' ELSE video_status END AS video_status,
       CASE WHEN winner THEN duration ELSE video_duration END AS video_duration""", "completed"))
def complete_jobs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    batch = fx.job_outcomes.filter(F.col("outcome") == "complete")
    return M.complete_jobs(batch, fx.jobs, fx.videos)


@register("fail_jobs", ["job_outcomes", "jobs", "videos"], _batch_oracle(
    "SELECT seq, job_id, error_msg FROM job_outcomes WHERE outcome = 'fail'",
    ", v.status AS video_status",
    "coalesce(job_status = 'running', false) AND vfound AND video_status = 'processing'",
    "CASE WHEN after THEN 'failed' ELSE video_status END AS vstat",
    """CASE WHEN job_status IS NULL THEN 'job not found' WHEN NOT coalesce(job_status = 'running', false)
         THEN 'job cannot be marked as failed' WHEN NOT vfound THEN 'video not found'
         WHEN vstat <> 'processing' THEN 'video cannot be marked as failed' END""",
    """CASE WHEN winner THEN 'failed' ELSE job_was END AS job_status, CASE WHEN winner THEN error_msg END AS job_error_msg,
       CASE WHEN winner THEN 'failed' ELSE video_status END AS video_status""", "failed"))
def fail_jobs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    batch = fx.job_outcomes.filter(F.col("outcome") == "fail")
    return M.fail_jobs(batch, fx.jobs, fx.videos)


@register("signup_batch", ["signups", "users", "roles", "role_permissions", "permissions"], recursive=True, oracle=f"""
, s AS MATERIALIZED (SELECT g.*, r.name IS NOT NULL AS role_ok,
          EXISTS (SELECT 1 FROM users u WHERE u.email = g.email) AS email_taken,
          EXISTS (SELECT 1 FROM users u WHERE u.username = g.username) AS name_taken,
          row_number() OVER (ORDER BY g.user_id) AS rn
        FROM signups g LEFT JOIN roles r ON r.name = g.role_name),
rs AS (SELECT r.name AS role_name, string_agg(DISTINCT p.slug, ',' ORDER BY p.slug) AS perms
       FROM roles r JOIN role_permissions rp ON rp.role_id = r.id JOIN permissions p ON p.id = rp.permission_id
       GROUP BY r.name),
-- one signup after the other, each against the names and addresses of those accepted before
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS emails, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS VARCHAR) AS err
      UNION ALL
      SELECT rn, CASE WHEN err IS NULL THEN list_append(emails, email) ELSE emails END,
             CASE WHEN err IS NULL THEN list_append(names, username) ELSE names END, err
      FROM (SELECT s.rn, g.emails, g.names, s.email, s.username, CASE WHEN coalesce(user_id, '') = '' THEN 'user id cannot be empty'
                       WHEN coalesce(email, '') = '' THEN 'email cannot be empty'
                       WHEN coalesce(username, '') = '' THEN 'username cannot be empty'
                       WHEN coalesce(password_hash, '') = '' THEN 'password hash cannot be empty'
                       WHEN email_taken OR list_contains(g.emails, email) THEN 'email already exists'
                       WHEN name_taken OR list_contains(g.names, username) THEN 'username already exists'
                       WHEN NOT role_ok THEN 'cannot find role id' END AS err
            FROM g JOIN s ON s.rn = g.rn + 1) step),
e AS (SELECT s.*, g.err FROM s JOIN g ON g.rn = s.rn)
SELECT e.user_id, e.username, e.email, e.role_name, err IS NULL AS accepted, err AS error,
  CASE WHEN err IS NULL THEN coalesce(rs.perms, '') END AS permissions,
  CASE WHEN err IS NULL THEN TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE END AS access_expires_at,
  CASE WHEN err IS NULL THEN TIMESTAMP '{NOW}' + INTERVAL 7 DAY END AS refresh_expires_at
FROM e LEFT JOIN rs ON rs.role_name = e.role_name
""")
def signup_batch(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    slugs = R.role_slug_map(fx.roles, fx.role_permissions, fx.permissions)
    return M.signup_batch(fx.signups, fx.users, fx.roles, slugs, NOW)


@register("login_claims", ["login_keys", "users", "user_roles", "role_permissions", "permissions"], f"""
, m AS (SELECT k.key_id, min(u.id) AS user_id FROM login_keys k
        JOIN users u ON lower(u.email) = lower(k.login) OR lower(u.username) = lower(k.login) GROUP BY k.key_id),
granted AS (SELECT role_id, slug FROM (SELECT role_id, (SELECT max(slug) FROM permissions WHERE id = permission_id) AS slug
           FROM role_permissions) WHERE slug IS NOT NULL GROUP BY ALL),
up AS (SELECT user_id, slug FROM user_roles JOIN granted USING (role_id) GROUP BY ALL)
SELECT m.key_id, m.user_id, u.username,
  coalesce((SELECT string_agg(slug, ',' ORDER BY slug) FROM up WHERE up.user_id = m.user_id), '') AS permissions,
  TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE AS access_expires_at, TIMESTAMP '{NOW}' + INTERVAL 7 DAY AS refresh_expires_at
FROM m JOIN users u ON u.id = m.user_id
""")
def login_claims(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    look = R.lookup_users_by_key(fx.login_keys, fx.users)
    return M.login_claims(look, fx.users, fx.user_roles, fx.role_permissions, fx.permissions, NOW)


# one command after the other per video; ``done`` holds the status of its jobs that changed
@register("replay_job_batch", ["job_commands", "jobs", "videos"], recursive=True, oracle="""
, c AS (SELECT k.*, j.video_id, j.status AS js, v.status AS vs, v.duration AS vd,
          row_number() OVER (PARTITION BY j.video_id ORDER BY k.seq) AS rn
        FROM job_commands k LEFT JOIN jobs j ON j.id = k.job_id LEFT JOIN videos v ON v.id = j.video_id),
r AS (
  SELECT video_id, CAST(0 AS BIGINT) AS rn, vs, vd, CAST(map() AS MAP(VARCHAR, VARCHAR)) AS done,
    CAST(NULL AS VARCHAR) AS now, CAST(NULL AS VARCHAR) AS err
  FROM (SELECT DISTINCT video_id, vs, vd FROM c WHERE vs IS NOT NULL) v
  UNION ALL
  SELECT video_id, rn, CASE WHEN e IS NULL THEN CASE cmd WHEN 'start' THEN 'processing' WHEN 'fail' THEN 'failed' ELSE 'published' END ELSE vs END,
    CASE WHEN e IS NULL AND cmd = 'complete' THEN duration ELSE vd END,
    CASE WHEN e IS NULL THEN map_concat(done, MAP([job_id], [goes])) ELSE done END, CASE WHEN e IS NULL THEN goes ELSE now END, e
  FROM (SELECT *, CASE cmd WHEN 'start' THEN 'running' WHEN 'fail' THEN 'failed' ELSE 'completed' END AS goes,
          CASE WHEN cmd = 'start' THEN CASE WHEN now IN ('running', 'completed') THEN 'job cannot be started'
                                            WHEN vs IN ('processing', 'published', 'archived') THEN 'video cannot be marked as processing' END
               WHEN cmd = 'fail' THEN CASE WHEN now <> 'running' THEN 'job cannot be marked as failed'
                                           WHEN vs <> 'processing' THEN 'video cannot be marked as failed' END
               ELSE CASE WHEN now <> 'running' THEN 'job cannot be completed' WHEN vd <> 0 THEN 'video duration has already been set'
                         WHEN duration < 0 THEN 'video duration cannot be negative' WHEN vs <> 'processing' THEN 'video cannot be published' END
          END AS e
        FROM (SELECT r.video_id, c.rn, r.vs, r.vd, r.done, c.job_id, c.cmd, c.duration, coalesce(element_at(r.done, c.job_id)[1], c.js) AS now
              FROM r JOIN c ON c.video_id = r.video_id AND c.rn = r.rn + 1) x) y)
SELECT c.seq, c.job_id, c.video_id, c.cmd, r.err IS NULL AS accepted, r.err AS error, r.now AS job_status,
  CASE WHEN r.err IS NULL AND c.cmd = 'complete' THEN c.result END AS job_result,
  CASE WHEN r.err IS NULL AND c.cmd = 'fail' THEN c.error_msg END AS job_error_msg, r.vs AS video_status, r.vd AS video_duration
FROM c JOIN r ON r.video_id = c.video_id AND r.rn = c.rn
UNION ALL
SELECT seq, job_id, video_id, cmd, false, CASE WHEN js IS NULL THEN 'job not found'
    WHEN cmd = 'start' AND js IN ('running', 'completed') THEN 'job cannot be started'
    WHEN cmd = 'fail' AND js <> 'running' THEN 'job cannot be marked as failed'
    WHEN cmd = 'complete' AND js <> 'running' THEN 'job cannot be completed' ELSE 'video not found' END,
  js, NULL, NULL, NULL, NULL
FROM c WHERE vs IS NULL
""")
def replay_job_batch(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return J.replay_job_batch(fx.job_commands, fx.jobs, fx.videos)


@register("replay_video_edits", ["video_edits", "videos"], recursive=True, oracle="""
, c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM video_edits),
ids AS (SELECT c.video_id, count(*) AS n, any_value(v.id) IS NOT NULL AS found FROM c LEFT JOIN videos v ON v.id = c.video_id GROUP BY c.video_id),
r AS (
  SELECT i.video_id, CAST(0 AS BIGINT) AS rn, v.status, v.title, v.description, v.duration, CAST(0 AS BIGINT) AS n_acc, CAST(NULL AS VARCHAR) AS last_error
  FROM ids i JOIN videos v ON v.id = i.video_id
  UNION ALL
  SELECT video_id, rn, CASE WHEN e IS NULL THEN ns ELSE status END, CASE WHEN e IS NULL AND cmd = 'set_title' THEN text ELSE title END,
    CASE WHEN e IS NULL AND cmd = 'set_description' THEN text ELSE description END,
    CASE WHEN e IS NULL AND cmd = 'set_duration' THEN newdur ELSE duration END, n_acc + CASE WHEN e IS NULL THEN 1 ELSE 0 END, coalesce(e, last_error)
  FROM (SELECT r.*, c.rn AS crn, c.cmd, c.text, c.duration AS newdur,
          CASE c.cmd WHEN 'process' THEN 'processing' WHEN 'publish' THEN 'published' WHEN 'fail' THEN 'failed' WHEN 'archive' THEN 'archived' ELSE r.status END AS ns,
          CASE c.cmd WHEN 'process' THEN CASE WHEN r.status NOT IN ('pending', 'failed') THEN 'video cannot be marked as processing' END
            WHEN 'publish' THEN CASE WHEN r.status <> 'processing' THEN 'video cannot be published' END
            WHEN 'fail' THEN CASE WHEN r.status <> 'processing' THEN 'video cannot be marked as failed' END
            WHEN 'archive' THEN CASE WHEN r.status <> 'published' THEN 'video cannot be archived' END
            WHEN 'set_title' THEN CASE WHEN coalesce(c.text, '') = '' THEN 'video title cannot be empty' END
            WHEN 'set_description' THEN CASE WHEN coalesce(c.text, '') = '' THEN 'video description cannot be empty' END
            WHEN 'set_duration' THEN CASE WHEN r.duration <> 0 THEN 'video duration has already been set'
                                          WHEN c.duration < 0 THEN 'video duration cannot be negative' END
            ELSE 'unknown command' END AS e
        FROM r JOIN c ON c.video_id = r.video_id AND c.rn = r.rn + 1) x(video_id, was, status, title, description, duration, n_acc, last_error, rn, cmd, text, newdur, ns, e)),
done AS (SELECT video_id, arg_max(status, rn) AS status, arg_max(title, rn) AS title, arg_max(description, rn) AS description,
           arg_max(duration, rn) AS duration, arg_max(n_acc, rn) AS n_acc, max(last_error) FILTER (rn = n) AS last_error
         FROM r JOIN ids USING (video_id) GROUP BY video_id)
SELECT i.video_id, i.found, d.status, d.title, d.description, d.duration, i.n AS n_commands, coalesce(d.n_acc, 0) AS n_accepted,
  i.n - coalesce(d.n_acc, 0) AS n_rejected, CASE WHEN i.found THEN d.last_error ELSE 'video not found' END AS last_error
FROM ids i LEFT JOIN done d USING (video_id)
""")
def replay_video_edits(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return M.replay_video_edits(fx.video_edits, fx.videos)
