"""Derived views that map the supplied TPC-H-ish tables onto the catalog's data model.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB (the oracle).
Spark registers the base tables (``parquet.`<dir>/<table>.parquet```) and the views as temp
views whose names carry a tag of the data directory, so two scale factors can live in one
session; column pruning and filter pushdown reach the parquet scan through the views.

The only Spark-specific text is ``role_permissions``: the shared text is a filtered
CROSS JOIN, which Spark would run as a nested-loop join; the Spark form below is the
same relation written as an equi-join over an exploded key set.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = sql.strip()
    DEPS[name] = deps


_view("videos", ["customer"], """
SELECT 'vid-'||CAST(c_custkey AS VARCHAR(20)) AS id, c_name AS title, c_mktsegment AS description,
  CASE WHEN c_custkey%5 IN (2,4) THEN CAST((1+c_custkey%7200) AS BIGINT)*1000000000 ELSE CAST(0 AS BIGINT) END AS duration,
  'video_'||CAST(c_custkey AS VARCHAR(20))||'.mp4' AS filename, 'res-'||CAST(c_custkey AS VARCHAR(20)) AS resource_id,
  CASE c_custkey%5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'published' WHEN 3 THEN 'failed' ELSE 'archived' END AS status,
  TIMESTAMP '1994-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS created_at,
  TIMESTAMP '1994-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS updated_at
FROM customer WHERE c_custkey%50<>7
""")

_view("jobs", ["orders"], """
SELECT 'job-'||CAST(o_orderkey AS VARCHAR(20)) AS id, 'vid-'||CAST(o_custkey AS VARCHAR(20)) AS video_id,
  CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'thumbnail' ELSE 'transcode' END AS type,
  CASE WHEN o_orderstatus='O' THEN 'pending' WHEN o_orderstatus='P' THEN 'running' WHEN o_orderkey%2=0 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus='F' AND o_orderkey%2=0 THEN 'manifest.mpd' ELSE '' END AS result,
  CASE WHEN o_orderstatus='F' AND o_orderkey%2=1 THEN 'exit status 1' ELSE '' END AS error_msg,
  o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders WHERE o_custkey%50<>8
""")

_view("users", ["customer"], """
SELECT 'user-'||CAST(c_custkey AS VARCHAR(20)) AS id,
  CASE WHEN c_custkey%2=0 THEN upper(c_name) ELSE lower(c_name) END||'@example.com' AS email,
  CASE WHEN c_custkey%100>=90 THEN 'DUP'||CAST(c_custkey%10 AS VARCHAR(20)) ELSE c_name END AS username,
  CASE WHEN c_custkey%33=0 THEN '' ELSE 'hash' END AS password_hash,
  TIMESTAMP '1994-01-01 00:00:00' AS created_at, TIMESTAMP '1994-01-01 00:00:00' AS updated_at
FROM customer
""")

_view("roles", ["orders"], """
SELECT DISTINCT 'role-'||substring(o_orderpriority,1,1) AS id, o_orderpriority AS name FROM orders
""")

_view("permissions", ["part"], """
SELECT DISTINCT 'perm-'||substring(p_brand,7,2) AS id, 'part:'||lower(p_brand) AS slug FROM part
""")

_view("user_roles", ["orders"], """
SELECT DISTINCT 'user-'||CAST(o_custkey AS VARCHAR(20)) AS user_id, 'role-'||substring(o_orderpriority,1,1) AS role_id
FROM orders WHERE o_custkey%50<>9
""")

_view("role_permissions", ["roles", "permissions"], """
SELECT r.id AS role_id, p.id AS permission_id FROM roles r CROSS JOIN permissions p
WHERE CAST(substring(p.id,6,2) AS INT)%5=CAST(substring(r.id,6,1) AS INT)-1 OR CAST(substring(p.id,6,2) AS INT)%3=0
""")

_view("role_requests", ["orders"], """
SELECT o_orderkey AS req_id,
  CASE WHEN o_orderkey%29=0 THEN 'ghost-'||CAST(o_orderkey AS VARCHAR(20)) ELSE 'user-'||CAST(o_custkey AS VARCHAR(20)) END AS user_id,
  CASE WHEN o_orderkey%31=0 THEN 'no-such-role' ELSE o_orderpriority END AS role_name
FROM orders
""")

_view("progress_msgs", ["events"], """
SELECT event_id, ts, 'video:job-'||CAST(user_id AS VARCHAR(20))||':progress' AS channel,
  CASE WHEN event_id%97=0 THEN '{invalid-json}' ELSE '{"TotalFrames":300,"CurrentFrames":'||CAST(event_id%400 AS VARCHAR(20))||',"Status":"'
    ||CASE WHEN event_id%41=0 THEN 'end' WHEN event_id%43=0 THEN 'error' ELSE 'continue' END||'"}' END AS payload
FROM events
""")

_view("progress_lines", ["events"], """
SELECT event_id, ts, 'job-'||CAST(user_id AS VARCHAR(20)) AS job_id,
  CASE event_type WHEN 'click' THEN 'frame='||CAST(event_id%400 AS VARCHAR(20))
    WHEN 'view' THEN '  frame='||CAST(event_id%400 AS VARCHAR(20))||' '
    WHEN 'signup' THEN 'fps=25.0' WHEN 'error' THEN 'frame=abc' ELSE 'frame= 12' END AS line
FROM events
""")

_view("probes", ["events"], """
SELECT 'job-'||CAST(user_id AS VARCHAR(20)) AS job_id,
  CASE WHEN user_id%20=0 THEN '{"format":{"duration":"x"},"streams":{"nb_read_frames":"300"}}'
       WHEN user_id%20=1 THEN '{"format":{"duration":"10.5"},"streams":{"nb_read_frames":"0"}}'
       WHEN user_id%2=0 THEN '{"format":{"duration":"'||CAST(user_id AS VARCHAR(20))||'.45"},"streams":{"nb_read_frames":"300"}}'
       ELSE '{"format":{"duration":"'||CAST(user_id AS VARCHAR(20))||'.25"},"streams":[{"nb_read_frames":"250"}]}' END AS doc
FROM (SELECT DISTINCT user_id FROM events) e
""")

# probe_docs: documents as a probe must not write them (P8), and a few good ones.
_view("probe_docs", ["events"], """
SELECT event_id, CASE event_id%11
    WHEN 0 THEN '{"format":{"duration":1.5},"streams":{"nb_read_frames":"30"}}'
    WHEN 1 THEN '{"format":{"duration":"1.5"},"streams":[{"nb_read_frames":30}]}'
    WHEN 2 THEN '{"format":{"duration":"1.5"},"streams":{"nb_read_frames":"30"}} trailing'
    WHEN 3 THEN '{"format":{"duration":"1.5"},"streams":{"nb_read_frames":"30"}}{}'
    WHEN 4 THEN '{"format":{"duration":"1e300"},"streams":{"nb_read_frames":"30"}}'
    WHEN 5 THEN '{"format":{"duration":"1e400"},"streams":{"nb_read_frames":"30"}}'
    WHEN 6 THEN '{"format":{"duration":null},"streams":{"nb_read_frames":"30"}}'
    WHEN 7 THEN '{"format":{"duration":"1.5"},"streams":{"nb_read_frames":"99999999999999999999"}}'
    WHEN 8 THEN ''
    ELSE '{"format":{"duration":"'||CAST(event_id AS VARCHAR(20))||'.5"},"streams":[{"nb_read_frames":"30"}]}' END AS doc
FROM events
""")

_view("video_cmds", ["events"], """
SELECT 'vid-'||CAST(event_id-event_id%6 AS VARCHAR(20)) AS video_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'publish' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'archive' ELSE 'update' END AS cmd
FROM events
""")

_view("job_changes", ["events"], """
SELECT event_id AS seq, 'job-'||CAST(CASE WHEN event_id%7=0 THEN 90000000+event_id ELSE event_id%500 END AS VARCHAR(20)) AS id,
  'vid-'||CAST(user_id AS VARCHAR(20)) AS video_id, 'transcode' AS type,
  CASE WHEN event_type='error' THEN 'failed' WHEN event_type='purchase' THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN event_type='purchase' THEN 'manifest.mpd' ELSE '' END AS result,
  CASE WHEN event_type='error' THEN 'exit status 1' ELSE '' END AS error_msg, ts AS created_at, ts AS updated_at
FROM events
""")

_view("video_patches", ["customer"], """
SELECT 'vid-'||CAST(c_custkey AS VARCHAR(20)) AS id,
  CASE WHEN c_custkey%3=0 THEN NULL WHEN c_custkey%11=0 THEN '' ELSE 'title '||CAST(c_custkey AS VARCHAR(20)) END AS title,
  CASE WHEN c_custkey%4=0 THEN NULL ELSE 'desc '||CAST(c_custkey AS VARCHAR(20)) END AS description
FROM customer
""")

_view("log_records", ["events"], """
SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
  CASE event_type WHEN 'click' THEN 'job' WHEN 'view' THEN 'video' WHEN 'purchase' THEN 'auth' WHEN 'signup' THEN 'default' ELSE 'job %s: open file' END AS category,
  event_type||' by '||CAST(user_id AS VARCHAR(20)) AS message,
  CASE WHEN event_id%2=0 THEN '' ELSE 'src-'||CAST(event_id AS VARCHAR(20)) END AS source_id
FROM events
""")

_view("access_log", ["events"], """
SELECT event_id, CASE event_id%6 WHEN 0 THEN 'Bearer tok' WHEN 1 THEN 'bearer tok' WHEN 2 THEN 'Bearer ' WHEN 3 THEN 'Bearer a b' ELSE '' END AS auth_header,
  CASE WHEN event_id%4=0 THEN 'qtok' ELSE '' END AS query_token,
  'res-'||CAST(user_id AS VARCHAR(20)) AS resource_id,
  CASE event_id%5 WHEN 0 THEN '../../etc/passwd' WHEN 1 THEN '../x/seg1.m4s' WHEN 2 THEN './manifest.mpd' ELSE 'manifest.mpd' END AS filename
FROM events
""")

_view("claims", ["events"], """
SELECT event_id, CASE WHEN event_id%13=0 THEN '' ELSE 'user-'||CAST(user_id AS VARCHAR(20)) END AS user_id,
  ts + INTERVAL '15' MINUTE AS expires_at
FROM events
""")

# ---- views added for operators the fixture list above does not feed (same conventions)

# video_changes: one change per order: updates to existing videos (new title, status, a different
# created_at that must NOT win) plus inserts for ids the catalog lacks (custkey % 50 = 7).
_view("video_changes", ["orders"], """
SELECT o_orderkey AS seq, 'vid-'||CAST(o_custkey AS VARCHAR(20)) AS id,
  'title '||CAST(o_orderkey AS VARCHAR(20)) AS title, o_orderpriority AS description,
  CAST(o_orderkey%3 AS BIGINT)*1000000000 AS duration,
  'video_'||CAST(o_custkey AS VARCHAR(20))||'.mp4' AS filename, 'res-'||CAST(o_custkey AS VARCHAR(20)) AS resource_id,
  CASE WHEN o_orderstatus='F' THEN 'published' WHEN o_orderstatus='P' THEN 'processing' ELSE 'pending' END AS status,
  o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders
""")

# user_changes: one change per order: new e-mail / username for its customer's user, or a new user.
_view("user_changes", ["orders"], """
SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey%11=0 THEN 'user-new-'||CAST(o_orderkey AS VARCHAR(20)) ELSE 'user-'||CAST(o_custkey AS VARCHAR(20)) END AS id,
  'u'||CAST(o_orderkey AS VARCHAR(20))||'@example.com' AS email, 'name-'||CAST(o_orderkey AS VARCHAR(20)) AS username,
  'hash2' AS password_hash, o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders
""")

# job_cmds: start / complete / fail commands against jobs, several per job, ordered by seq.
_view("job_cmds", ["events"], """
SELECT 'job-'||CAST(event_id-event_id%5 AS VARCHAR(20)) AS job_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'start' ELSE 'complete' END AS cmd,
  CASE WHEN event_type IN ('view','signup') THEN 'manifest.mpd' ELSE '' END AS result,
  CASE WHEN event_type='error' THEN 'exit status 1' ELSE '' END AS error_msg
FROM events
""")

# login_keys: e-mail in the opposite case, username in upper case, and unknown keys.
_view("login_keys", ["customer"], """
SELECT c_custkey AS key_id,
  CASE c_custkey%4 WHEN 0 THEN upper(c_name)||'@EXAMPLE.COM' WHEN 1 THEN upper(c_name) WHEN 2 THEN 'DUP'||CAST(c_custkey%10 AS VARCHAR(20))
    ELSE 'nobody-'||CAST(c_custkey AS VARCHAR(20)) END AS login
FROM customer
""")

# video_keys: ids asked for by the jobs (some have no video) and some made-up ids.
_view("video_keys", ["orders"], """
SELECT DISTINCT CASE WHEN o_orderkey%13=0 THEN 'vid-missing-'||CAST(o_orderkey AS VARCHAR(20)) ELSE 'vid-'||CAST(o_custkey AS VARCHAR(20)) END AS id
FROM orders
""")

# uploads: one upload request per customer with a few blank fields (X13 rejections).
_view("uploads", ["customer"], """
SELECT 'up-'||CAST(c_custkey AS VARCHAR(20)) AS upload_id,
  c_name AS title, c_mktsegment AS description,
  CASE WHEN c_custkey%17=0 THEN '' ELSE 'upload_'||CAST(c_custkey AS VARCHAR(20))||'.mp4' END AS filename,
  CASE WHEN c_custkey%19=0 THEN '' ELSE 'res-up-'||CAST(c_custkey AS VARCHAR(20)) END AS resource_id
FROM customer
""")

# job_outcomes: a completion or failure report per job, sent twice (X15, X16); most jobs are not running,
# so most reports are rejected, as a worker's late or duplicate report would be.
_view("job_outcomes", ["orders"], """
SELECT 2*o_orderkey+again AS seq, 'job-'||CAST(o_orderkey AS VARCHAR(20)) AS job_id,
  CASE WHEN o_orderkey%3=0 THEN 'fail' ELSE 'complete' END AS outcome,
  'manifest.mpd' AS result, 'exit status 1' AS error_msg,
  CAST(60+o_orderkey%600 AS BIGINT)*1000000000 - CASE WHEN o_orderkey%37=0 THEN 1000000000000 ELSE 0 END AS duration
FROM (SELECT o_orderkey, 0 AS again FROM orders UNION ALL SELECT o_orderkey, 1 AS again FROM orders) o
""")

# signups: username, e-mail and requested role (some roles unknown, some fields blank, some names
# and addresses asked for by several).
_view("signups", ["customer"], """
SELECT 'new-'||CAST(c_custkey AS VARCHAR(20)) AS user_id,
  CASE WHEN c_custkey%23=0 THEN '' WHEN c_custkey%7=3 THEN 'team-'||CAST(c_custkey-c_custkey%50 AS VARCHAR(20))||'@signup.example'
    ELSE lower(c_name)||'@signup.example' END AS email,
  'new_'||CAST(CASE WHEN c_custkey%9=4 THEN c_custkey-1 ELSE c_custkey END AS VARCHAR(20)) AS username,
  CASE WHEN c_custkey%29=0 THEN '' ELSE 'hash' END AS password_hash,
  CASE c_custkey%6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'no-such-role' END AS role_name
FROM customer
""")

# duration_requests: durations to set on videos, three per id (X7); account balances give negative ones.
_view("duration_requests", ["customer"], """
SELECT 'vid-'||CAST(c_custkey AS VARCHAR(20)) AS id, 3*c_custkey+again AS seq,
  CASE again WHEN 0 THEN CAST(sign(c_acctbal)*floor(abs(c_acctbal)) AS BIGINT)*1000000000
             WHEN 1 THEN CAST(c_custkey%2 AS BIGINT)*7000000000 ELSE CAST(9000000000 AS BIGINT) END AS duration
FROM (SELECT c_custkey, c_acctbal, 0 AS again FROM customer UNION ALL SELECT c_custkey, c_acctbal, 1 AS again FROM customer
      UNION ALL SELECT c_custkey, c_acctbal, 2 AS again FROM customer) c
""")

# deleted_users: users removed from the catalog; their role links must cascade away (U8).
_view("deleted_users", ["customer"], """
SELECT 'user-'||CAST(c_custkey AS VARCHAR(20)) AS id FROM customer WHERE c_custkey%7=0
""")

# job_commands: start / fail / complete commands for all jobs (some unknown), those of one video's jobs
# interleaved by shipping day; parts give durations, a few of them zero or negative.
_view("job_commands", ["lineitem"], """
SELECT CAST(day AS BIGINT)*1000000000000+l_orderkey*10+l_linenumber AS seq,
  CASE WHEN l_orderkey%53=0 THEN 'job-missing-' ELSE 'job-' END||CAST(l_orderkey AS VARCHAR(20)) AS job_id,
  CASE WHEN (7*l_orderkey+3*l_linenumber)%8<4 THEN 'start' WHEN (7*l_orderkey+3*l_linenumber)%8<7 THEN 'fail' ELSE 'complete' END AS cmd,
  CAST(part%40-2 AS BIGINT)*1000000000 AS duration, 'manifest.mpd' AS result, 'exit status '||CAST(l_linenumber AS VARCHAR(20)) AS error_msg
FROM (SELECT l_orderkey, l_linenumber, min(extract(YEAR FROM l_shipdate)*372+extract(MONTH FROM l_shipdate)*31+extract(DAY FROM l_shipdate)) AS day,
        min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) l
""")

# video_edits: status moves and edits of title, description and duration for all videos (some unknown).
_view("video_edits", ["events"], """
SELECT 'vid-'||CAST(CASE WHEN event_id%61=0 THEN 90000000 ELSE 0 END+event_id%700 AS VARCHAR(20)) AS video_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN CASE WHEN event_id%2=0 THEN 'publish' ELSE 'archive' END
    WHEN 'error' THEN CASE WHEN event_id%3=0 THEN 'fail' WHEN event_id%3=1 THEN 'set_duration' ELSE 'rename' END
    WHEN 'purchase' THEN 'set_title' ELSE 'set_description' END AS cmd,
  CASE event_id%5 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS VARCHAR(20)) ELSE 'text '||CAST(event_id AS VARCHAR(20)) END AS text,
  CAST(event_id%4-1 AS BIGINT)*1000000000 AS duration
FROM events
""")

# read_failures: where reading a job's text failed (P3); some before its first line.
_view("read_failures", ["events"], """
SELECT 'job-'||CAST(user_id AS VARCHAR(20)) AS job_id, CASE WHEN user_id%12=0 THEN CAST(0 AS BIGINT) ELSE event_id END AS event_id
FROM events WHERE user_id%4=0 AND event_type='error'
""")

# log_calls: format texts with their arguments, separated by commas; some miss arguments or have too many.
_view("log_calls", ["events"], """
SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
  CASE event_type WHEN 'click' THEN 'video' WHEN 'view' THEN 'job' WHEN 'signup' THEN 'default' ELSE 'auth' END AS category,
  CASE event_type WHEN 'click' THEN 'got video %s info' WHEN 'view' THEN 'job %s: %d%% of %d frames' WHEN 'error' THEN 'parse token: %v'
    WHEN 'signup' THEN 'file path %s is %z invalid %' ELSE 'user "%s" logged in' END AS template,
  CASE WHEN event_id%7=0 THEN '' WHEN event_id%7=1 THEN 'a,b,c,d' ELSE 'id-'||CAST(event_id AS VARCHAR(20))||','||CAST(event_id%100 AS VARCHAR(20))||',300' END AS args_text,
  CASE WHEN event_id%2=0 THEN '' ELSE 'src-'||CAST(event_id AS VARCHAR(20)) END AS source_id
FROM events
""")

# permission_lists: a list of slugs for each part, separated by commas; some hold no slug between two
# commas (a null slug), some are empty, some null.
_view("permission_lists", ["part"], """
SELECT p_partkey AS req_id, CASE WHEN p_partkey%13=0 THEN CAST(NULL AS VARCHAR(80)) WHEN p_partkey%13=1 THEN ''
  WHEN p_partkey%13=2 THEN 'part:'||lower(p_brand)||',,list:'||CAST(p_partkey AS VARCHAR(20))
  ELSE 'part:'||lower(p_brand)||',list:'||CAST(p_partkey%40 AS VARCHAR(20))||','||'part:'||lower(p_brand) END AS slugs_text
FROM part
""")

# permission_requests: slug lists to sync, one list per brand, each with repeats (U4).
_view("permission_requests", ["part"], """
SELECT p_partkey AS req_id, 'part:'||lower(p_brand) AS slug FROM part
UNION ALL SELECT p_partkey AS req_id, 'video:'||lower(p_type) AS slug FROM part
""")

# Spark-side text for role_permissions: the same relation as an equi-join. A permission with
# number % 3 = 0 matches every role, so its key set is every value a role key can take:
# digit-1 for a digit ('0'..'9' -> -1..8) and -99 for a role whose id has no digit there.
_SPARK_OVERRIDES = {
    "role_permissions": """
SELECT r.id AS role_id, pk.id AS permission_id
FROM (SELECT id, explode(CASE WHEN CAST(substring(id,6,2) AS INT)%3=0 THEN array_union(sequence(-1, 8), array(-99))
                              ELSE array(CAST(substring(id,6,2) AS INT)%5) END) AS k
      FROM permissions) pk
JOIN roles r ON coalesce(CAST(substring(r.id,6,1) AS INT)-1, -99) = pk.k
""",
}


def _closure(names: list[str]) -> list[str]:
    """Dependencies of ``names`` in creation order (derived views only)."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in out:
            for d in DEPS[n]:
                visit(d)
            out.append(n)
    for n in names:
        visit(n)
    return out


def _base_deps(names: list[str]) -> list[str]:
    base: list[str] = []
    for n in _closure(names):
        for d in DEPS[n]:
            if d in BASE_TABLES and d not in base:
                base.append(d)
    return base


_SPLITS: dict[tuple[str, int], tuple[int, int]] = {}
SPREAD_MIN_BYTES = 1 << 20


def scan_splits(spark: SparkSession, path: str) -> tuple[int, int]:
    """(input splits Spark plans for a parquet path, bytes of its local files; -1 if remote).
    File listing only, no job."""
    key = (path, spark.sparkContext.defaultParallelism)
    if key not in _SPLITS:
        df = spark.read.parquet(path)
        files = df.inputFiles()
        local = all(f.startswith("file:") for f in files)
        size = sum(os.path.getsize(f[len("file:"):]) for f in files) if local else -1
        _SPLITS[key] = (df.rdd.getNumPartitions(), size)
    return _SPLITS[key]


def needs_spread(spark: SparkSession, path: str) -> bool:
    """True when a scan would yield fewer splits than the cluster has task slots (a file
    written as one row group cannot be split) and it is big enough (>= 1 MiB) for parallel
    per-row work to pay for one round-robin exchange. Inputs on a cluster have thousands of
    splits, so this never fires there."""
    if os.environ.get("REELHOUSE_SPREAD_SMALL_SCANS", "1") != "1":
        return False
    splits, size = scan_splits(spark, path)
    return splits < spark.sparkContext.defaultParallelism and size >= SPREAD_MIN_BYTES


def base_scan_sql(spark: SparkSession | None, path: str) -> str:
    """SELECT over one supplied parquet table, spread round-robin first when ``needs_spread``;
    filters and column pruning still reach the scan (Catalyst pushes them below the
    repartition)."""
    if spark is not None and needs_spread(spark, path):
        return f"SELECT /*+ REPARTITION({spark.sparkContext.defaultParallelism}) */ * FROM parquet.`{path}`"
    return f"SELECT * FROM parquet.`{path}`"


def duckdb_with(names: list[str]) -> str:
    """The WITH clause for the oracle (base tables are pre-registered views there)."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(names)) + "\n"


def _tag(spark: SparkSession, sf_dir: str) -> str:
    key = f"{os.path.abspath(sf_dir.rstrip('/'))}|{spark.sparkContext.defaultParallelism}|" \
          f"{os.environ.get('REELHOUSE_SPREAD_SMALL_SCANS', '1')}"
    return hashlib.sha1(key.encode()).hexdigest()[:10]


def _rename(sql: str, names: dict[str, str]) -> str:
    """Point table references at the session's uniquely named temp views."""
    for n in sorted(names, key=len, reverse=True):
        sql = re.sub(rf"(?<![\w'.]){re.escape(n)}(?![\w'])", names[n], sql)
    return sql


def register(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Register ``name`` (and what it depends on) as temp views named per data directory, so
    two scale factors can live in one session. Returns the view's session name.

    Views are registered from analyzed DataFrames, so a reference does not list files or
    read parquet footers again, and plans stay free of CTE nodes, so a persisted
    fixture-derived frame is matched by the cache when it is reused inside a larger plan."""
    uname = f"{name}__{_tag(spark, sf_dir)}"
    if uname in _REGISTERED.get(id(spark), set()) and spark.catalog.tableExists(uname):
        return uname
    if name in BASE_TABLES:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        df = spark.read.parquet(path)
        if needs_spread(spark, path):
            df = df.repartition(spark.sparkContext.defaultParallelism)
    else:
        deps = {d: register(spark, sf_dir, d) for d in DEPS[name]}
        df = spark.sql(_rename(_SPARK_OVERRIDES.get(name, VIEWS[name]), deps))
    df.createOrReplaceTempView(uname)
    _REGISTERED.setdefault(id(spark), set()).add(uname)
    return uname


_REGISTERED: dict[int, set[str]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame over the parquet files in ``sf_dir``."""
    return spark.table(register(spark, sf_dir, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied base table (S1): the parquet scan; Catalyst prunes columns and pushes filters."""
    return spark.table(register(spark, sf_dir, name))


class Fixtures:
    """Lazy accessor: ``fx.videos`` etc. for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # timestamp literals in the views are read in the session zone; every rule assumes UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        if name in BASE_TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
