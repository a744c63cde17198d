"""Write-side and integrity queries: upsert_videos / upsert_jobs / upsert_users,
patch_videos, orphan_jobs, referential_report, cascade_delete, duplicate_keys,
null_checks, validate_records, auth_requests, claims_audit, path_audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..operators import integrity as I
from ..operators import upsert as U
from ..sources.fixtures import Fixtures
from .registry import register

NOW = "2024-01-15 00:00:00"
STORAGE_BASE = "/srv/storage"


def _upsert_oracle(target: str, changes: str, cols: list[str], immutable: list[str], mutable: list[str]) -> str:
    first = ", ".join(f"arg_min({c}, seq) AS {c}" for c in immutable)
    last = ", ".join(f"arg_max({c}, seq) AS {c}" for c in mutable)
    sel = []
    for c in cols:
        if c == "id":
            sel.append("coalesce(t.id, c.id) AS id")
        elif c in immutable:
            sel.append(f"CASE WHEN t.id IS NOT NULL THEN t.{c} ELSE c.{c} END AS {c}")
        else:
            sel.append(f"CASE WHEN c.id IS NOT NULL THEN c.{c} ELSE t.{c} END AS {c}")
    return f"""
, c AS (SELECT id, {first}, {last} FROM {changes} GROUP BY id)
SELECT {", ".join(sel)},
  CASE WHEN t.id IS NULL THEN 'insert' WHEN c.id IS NOT NULL THEN 'update' ELSE 'keep' END AS action,
  CASE WHEN t.id IS NOT NULL AND c.id IS NULL THEN 0 ELSE 1 END AS rows_affected
FROM {target} t FULL OUTER JOIN c ON t.id = c.id
"""


VIDEO_COLS = ["id", "title", "description", "duration", "filename", "resource_id", "status", "created_at", "updated_at"]
JOB_COLS = ["id", "video_id", "type", "status", "result", "error_msg", "created_at", "updated_at"]
USER_COLS = ["id", "email", "username", "password_hash", "created_at", "updated_at"]


@register("upsert_videos", ["videos", "video_changes"],
          _upsert_oracle("videos", "video_changes", VIDEO_COLS, U.VIDEO_IMMUTABLE, U.VIDEO_MUTABLE))
def upsert_videos(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return U.upsert_videos(fx.videos, fx.video_changes)


@register("upsert_jobs", ["jobs", "job_changes"],
          _upsert_oracle("jobs", "job_changes", JOB_COLS, U.JOB_IMMUTABLE, U.JOB_MUTABLE))
def upsert_jobs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return U.upsert_jobs(fx.jobs, fx.job_changes)


@register("upsert_users", ["users", "user_changes"],
          _upsert_oracle("users", "user_changes", USER_COLS, U.USER_IMMUTABLE, U.USER_MUTABLE))
def upsert_users(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return U.upsert_users(fx.users, fx.user_changes)


@register("patch_videos", ["video_patches", "videos"], """
, j AS (SELECT p.id, p.title AS nt, p.description AS nd, v.id AS vid, v.title AS ot, v.description AS od,
          CASE WHEN v.id IS NULL THEN 'video not found' WHEN p.title = '' THEN 'video title cannot be empty'
               WHEN p.description = '' THEN 'video description cannot be empty' END AS error
        FROM video_patches p LEFT JOIN videos v ON p.id = v.id)
SELECT id, CASE WHEN error IS NULL THEN 'updated' ELSE 'rejected' END AS outcome, error,
  CASE WHEN error IS NULL THEN coalesce(nt, ot) ELSE ot END AS title,
  CASE WHEN error IS NULL THEN coalesce(nd, od) ELSE od END AS description,
  error IS NULL AND (nt IS NOT NULL OR nd IS NOT NULL) AS touched
FROM j
""")
def patch_videos(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return U.patch_videos(fx.videos, fx.video_patches)


@register("orphan_jobs", ["jobs", "videos"], """
SELECT id, video_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM videos v WHERE v.id = j.video_id)
""")
def orphan_jobs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.orphans(fx.jobs, fx.videos, ["video_id"], ["id"]).select("id", "video_id")


@register("referential_report", ["jobs", "videos", "users", "roles", "permissions", "user_roles", "role_permissions"], """
SELECT 'jobs.video_id' AS relation, video_id AS key_value, count(*) AS n_rows FROM jobs c
  WHERE NOT EXISTS (SELECT 1 FROM videos p WHERE p.id = c.video_id) GROUP BY video_id
UNION ALL SELECT 'user_roles.user_id', user_id, count(*) FROM user_roles c
  WHERE NOT EXISTS (SELECT 1 FROM users p WHERE p.id = c.user_id) GROUP BY user_id
UNION ALL SELECT 'user_roles.role_id', role_id, count(*) FROM user_roles c
  WHERE NOT EXISTS (SELECT 1 FROM roles p WHERE p.id = c.role_id) GROUP BY role_id
UNION ALL SELECT 'role_permissions.role_id', role_id, count(*) FROM role_permissions c
  WHERE NOT EXISTS (SELECT 1 FROM roles p WHERE p.id = c.role_id) GROUP BY role_id
UNION ALL SELECT 'role_permissions.permission_id', permission_id, count(*) FROM role_permissions c
  WHERE NOT EXISTS (SELECT 1 FROM permissions p WHERE p.id = c.permission_id) GROUP BY permission_id
""")
def referential_report(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    rels = [("jobs.video_id", fx.jobs, fx.videos, "video_id"),
            ("user_roles.user_id", fx.user_roles, fx.users, "user_id"),
            ("user_roles.role_id", fx.user_roles, fx.roles, "role_id"),
            ("role_permissions.role_id", fx.role_permissions, fx.roles, "role_id"),
            ("role_permissions.permission_id", fx.role_permissions, fx.permissions, "permission_id")]
    parts = [I.orphans(c, p, [k], ["id"]).groupBy(F.col(k).alias("key_value"))
             .agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "key_value", "n_rows")
             for name, c, p, k in rels]
    return I.union_all(parts)


@register("cascade_delete", ["user_roles", "deleted_users"], """
SELECT user_id, role_id FROM user_roles ur WHERE NOT EXISTS (SELECT 1 FROM deleted_users d WHERE d.id = ur.user_id)
""")
def cascade_delete(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.cascade_delete(fx.user_roles, fx.deleted_users, "user_id").select("user_id", "role_id")


# every PRIMARY KEY and UNIQUE constraint of the catalog (schemas.PRIMARY_KEYS / UNIQUE_KEYS)
_DUPS = [(t, k) for t, k in SC.PRIMARY_KEYS.items()] + [(t, k) for t, ks in SC.UNIQUE_KEYS.items() for k in ks]


@register("duplicate_keys", ["videos", "jobs", "users", "roles", "permissions", "user_roles", "role_permissions"],
          "\nUNION ALL\n".join(
              f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_name, concat_ws('|', {', '.join(k)}) AS key_value, "
              f"count(*) AS n_rows FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1" for t, k in _DUPS))
def duplicate_keys(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.union_all([I.duplicate_keys(getattr(fx, t), t, k) for t, k in _DUPS])


_NN = [(t, [f.name for f in s.fields]) for t, s in SC.TABLES.items()]


@register("null_checks", list(SC.TABLES), "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null FROM {t}"
    for t, cols in _NN for c in cols))
def null_checks(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.union_all([I.null_counts(getattr(fx, t), t, cols) for t, cols in _NN])


@register("validate_records", ["videos", "jobs", "users", "uploads"], """
SELECT 'video' AS kind, id AS record_id,
  CASE WHEN coalesce(id,'') = '' THEN 'video id cannot be empty' WHEN coalesce(filename,'') = '' THEN 'file name cannot be empty'
       WHEN coalesce(resource_id,'') = '' THEN 'resource id cannot be empty' END AS error FROM videos
UNION ALL
SELECT 'upload', upload_id,
  CASE WHEN coalesce(upload_id,'') = '' THEN 'video id cannot be empty' WHEN coalesce(filename,'') = '' THEN 'file name cannot be empty'
       WHEN coalesce(resource_id,'') = '' THEN 'resource id cannot be empty' END FROM uploads
UNION ALL
SELECT 'job', id,
  CASE WHEN coalesce(id,'') = '' THEN 'job id cannot be empty' WHEN coalesce(video_id,'') = '' THEN 'video id cannot be empty'
       WHEN coalesce(type IN ('transcode'), false) = false THEN 'job type is invalid' END FROM jobs
UNION ALL
SELECT 'user', id,
  CASE WHEN coalesce(id,'') = '' THEN 'user id cannot be empty' WHEN coalesce(email,'') = '' THEN 'email cannot be empty'
       WHEN coalesce(username,'') = '' THEN 'username cannot be empty'
       WHEN coalesce(password_hash,'') = '' THEN 'password hash cannot be empty' END FROM users
""")
def validate_records(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    up = fx.uploads.select(F.col("upload_id").alias("id"), "filename", "resource_id")
    return I.union_all([I.validate(fx.videos, "video"), I.validate(up, "video").withColumn("kind", F.lit("upload")),
                        I.validate(fx.jobs, "job"), I.validate(fx.users, "user")])


@register("auth_requests", ["access_log"], """
, a AS (SELECT *, coalesce(auth_header, '') AS h, string_split(coalesce(auth_header, ''), ' ') AS parts,
               coalesce(query_token, '') AS q FROM access_log),
b AS (SELECT *, h <> '' AND (len(parts) <> 2 OR parts[1] <> 'Bearer') AS bad FROM a),
c AS (SELECT *, CASE WHEN h <> '' AND NOT bad THEN parts[2] ELSE '' END AS ht FROM b),
d AS (SELECT *, CASE WHEN ht <> '' THEN ht ELSE q END AS tok,
             CASE WHEN ht <> '' THEN 'header' WHEN q <> '' THEN 'query' END AS src FROM c)
SELECT event_id, auth_header, query_token, resource_id, filename,
  CASE WHEN bad THEN 'invalid token format' WHEN tok = '' THEN 'unauthorized' ELSE 'candidate' END AS outcome,
  CASE WHEN NOT bad AND tok <> '' THEN tok END AS token,
  CASE WHEN NOT bad AND tok <> '' THEN src END AS token_source
FROM d
""")
def auth_requests(spark, sf_dir):
    return I.classify_auth(Fixtures(spark, sf_dir).access_log)


@register("claims_audit", ["claims"], f"""
, c AS (SELECT *, expires_at IS NOT NULL AND expires_at <= TIMESTAMP '{NOW}' AS expired,
               coalesce(user_id, '') = '' AS missing FROM claims)
SELECT event_id, user_id, expires_at, NOT expired AND NOT missing AS valid,
  nullif(concat_ws('; ', CASE WHEN expired THEN 'token is expired' END, CASE WHEN missing THEN 'missing user id' END), '') AS error
FROM c
""")
def claims_audit(spark, sf_dir):
    return I.claims_audit(Fixtures(spark, sf_dir).claims, NOW)


@register("path_audit", ["access_log"], f"""
, c AS (SELECT event_id, resource_id, filename,
          '/' || array_to_string(list_reduce(string_split(concat_ws('/', '{STORAGE_BASE}', resource_id, filename), '/'),
            lambda acc, x: CASE WHEN x = '' OR x = '.' THEN acc
                                WHEN x = '..' THEN (CASE WHEN len(acc) = 0 OR acc[-1] = '..' THEN acc ELSE acc[1:len(acc) - 1] END)
                                ELSE list_append(acc, x) END, []::VARCHAR[]), '/') AS clean_path
        FROM access_log)
SELECT *, starts_with(clean_path, '{STORAGE_BASE}/') AS allowed,
  CASE WHEN NOT starts_with(clean_path, '{STORAGE_BASE}/') THEN 'invalid path' END AS error
FROM c
""")
def path_audit(spark, sf_dir):
    """F10 over the access log (absolute base; also checked against posixpath.normpath in tests)."""
    return I.path_audit(Fixtures(spark, sf_dir).access_log.select("event_id", "resource_id", "filename"),
                        STORAGE_BASE)
