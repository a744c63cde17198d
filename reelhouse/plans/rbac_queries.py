"""RBAC queries: role_permissions, user_permissions, user_permission_list, permission_check,
user_lookup, sync_permissions, sync_permission_lists, permission_list_outcomes, assign_roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rbac as R
from ..sources.fixtures import Fixtures
from .registry import register

RBAC = ["user_roles", "role_permissions", "permissions"]
USER_SLUGS = """
, granted AS (SELECT role_id, slug FROM (SELECT role_id, (SELECT max(slug) FROM permissions WHERE id = permission_id) AS slug
           FROM role_permissions) WHERE slug IS NOT NULL GROUP BY ALL),
  up AS (SELECT user_id, slug FROM user_roles JOIN granted USING (role_id) GROUP BY ALL)
"""
PROBE_SLUGS = ["part:brand#13", "part:brand#45", "video:upload", ""]


@register("role_permissions", ["roles", "role_permissions", "permissions"], """
, granted AS (SELECT role_id, slug FROM (SELECT role_id, (SELECT max(slug) FROM permissions WHERE id = permission_id) AS slug
           FROM role_permissions) WHERE slug IS NOT NULL GROUP BY ALL)
SELECT name AS role_name, slug FROM roles JOIN granted ON granted.role_id = roles.id GROUP BY ALL
""")
def role_permissions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.permissions_by_role(fx.roles, fx.role_permissions, fx.permissions)


@register("user_permissions", RBAC, """
, granted AS (SELECT role_id, slug FROM (SELECT role_id, (SELECT max(slug) FROM permissions WHERE id = permission_id) AS slug
           FROM role_permissions) WHERE slug IS NOT NULL GROUP BY ALL)
SELECT user_id, slug FROM user_roles JOIN granted USING (role_id) GROUP BY ALL
""")
def user_permissions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.permissions_by_user(fx.user_roles, fx.role_permissions, fx.permissions)


@register("user_permission_list", ["users"] + RBAC, USER_SLUGS + """
SELECT u.id AS user_id, u.username,
  coalesce((SELECT string_agg(slug, ',' ORDER BY slug) FROM up WHERE up.user_id = u.id), '') AS permissions,
  (SELECT count(*) FROM up WHERE up.user_id = u.id) AS n_permissions
FROM users u
""")
def user_permission_list(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    lists = R.permission_lists(fx.users, R.permissions_by_user(fx.user_roles, fx.role_permissions, fx.permissions))
    return lists.select("user_id", "username", F.array_join("permissions", ",").alias("permissions"),
                        F.size("permissions").cast("bigint").alias("n_permissions"))


@register("permission_check", ["users"] + RBAC, USER_SLUGS + """
SELECT u.id AS user_id, s.slug,
  EXISTS (SELECT 1 FROM up WHERE up.user_id = u.id AND up.slug = s.slug) AS allowed
FROM users u CROSS JOIN (VALUES ('part:brand#13'), ('part:brand#45'), ('video:upload'), ('')) s(slug)
""")
def permission_check(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    lists = R.permission_lists(fx.users, R.permissions_by_user(fx.user_roles, fx.role_permissions, fx.permissions))
    return R.permission_checks(lists, PROBE_SLUGS)


@register("user_lookup", ["login_keys", "users"], """
SELECT k.key_id, k.login, count(u.id) > 0 AS found, min(u.id) AS user_id, count(u.id) AS n_matches,
  count(u.id) > 1 AS ambiguous
FROM login_keys k LEFT JOIN users u ON lower(u.email) = lower(k.login) OR lower(u.username) = lower(k.login)
GROUP BY k.key_id, k.login
""")
def user_lookup(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.lookup_users_by_key(fx.login_keys, fx.users)


@register("sync_permissions", ["permissions", "permission_requests"], """
SELECT slug, false AS inserted FROM permissions
UNION ALL
SELECT DISTINCT slug, true AS inserted FROM permission_requests r
WHERE slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM permissions p WHERE p.slug = r.slug)
""")
def sync_permissions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.sync_permissions(fx.permissions, fx.permission_requests).select("slug", "inserted")


def _permission_lists(fx):
    """The lists as arrays: an empty text is an empty list, an empty place a null slug."""
    none = F.array().cast("array<string>")
    slugs = F.transform(F.split("slugs_text", ","), lambda x: F.nullif(x, F.lit("")))
    return fx.permission_lists.select("req_id", F.when(F.col("slugs_text") == "", none).otherwise(slugs).alias("slugs"))


@register("sync_permission_lists", ["permissions", "permission_lists"], """
, u AS (SELECT req_id, nullif(unnest(string_split(slugs_text, ',')), '') AS slug FROM permission_lists WHERE slugs_text <> ''),
fine AS (SELECT req_id FROM u GROUP BY req_id HAVING count(*) = count(slug))
SELECT slug, false AS inserted FROM permissions
UNION ALL
SELECT DISTINCT slug, true AS inserted FROM u SEMI JOIN fine ON u.req_id = fine.req_id WHERE slug NOT IN (SELECT slug FROM permissions)
""")
def sync_permission_lists(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.sync_permission_lists(fx.permissions, _permission_lists(fx))[0].select("slug", "inserted")


@register("permission_list_outcomes", ["permissions", "permission_lists"], """
, u AS (SELECT req_id, nullif(unnest(string_split(slugs_text, ',')), '') AS slug FROM permission_lists WHERE slugs_text <> ''),
n AS (SELECT req_id, count(*) > count(slug) AS bad, CAST(count(DISTINCT slug) AS INTEGER) AS n FROM u GROUP BY req_id)
SELECT l.req_id, NOT coalesce(bad, false) AS accepted, CASE WHEN bad THEN 'slug cannot be null' END AS error, coalesce(n, 0) AS n_slugs
FROM permission_lists l LEFT JOIN n ON n.req_id = l.req_id
""")
def permission_list_outcomes(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.sync_permission_lists(fx.permissions, _permission_lists(fx))[1]


@register("assign_roles", ["role_requests", "users", "roles", "user_roles"], """
, q AS (
  SELECT rq.req_id, rq.user_id, rq.role_name, r.id AS role_id,
    EXISTS (SELECT 1 FROM users u WHERE u.id = rq.user_id) AS user_ok,
    EXISTS (SELECT 1 FROM user_roles ur WHERE ur.user_id = rq.user_id AND ur.role_id = r.id) AS pair_exists
  FROM role_requests rq LEFT JOIN roles r ON r.name = rq.role_name),
f AS (SELECT user_id, role_id, min(req_id) AS first_req FROM q
      WHERE role_id IS NOT NULL AND user_ok AND NOT pair_exists GROUP BY user_id, role_id)
SELECT q.req_id, q.user_id, q.role_name, q.role_id,
  CASE WHEN q.role_id IS NULL THEN 'no_role' WHEN NOT q.user_ok THEN 'no_user'
       WHEN q.pair_exists OR f.first_req <> q.req_id THEN 'exists' ELSE 'inserted' END AS outcome,
  CASE WHEN q.role_id IS NOT NULL AND q.user_ok AND NOT q.pair_exists AND f.first_req = q.req_id THEN 1 ELSE 0 END AS rows_affected
FROM q LEFT JOIN f ON q.user_id = f.user_id AND q.role_id = f.role_id
""")
def assign_roles(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return R.assign_roles(fx.role_requests, fx.users, fx.roles, fx.user_roles)
