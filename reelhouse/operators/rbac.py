"""Role-based access: permissions of roles (J1) and users (J2), DISTINCT slugs (A1), the
permission list per user (A2), membership checks (F6), login-key lookup (F4), permission
sync (U4) and role assignment with outcomes (J6, U5, A3).

Scale notes
- roles / permissions / role_permissions are dimension tables; the role -> slug map is
  broadcast only if its measured size allows it (``bounded_broadcast``), else the
  join is shuffled. user_roles is the fact side and is never broadcast.
- DISTINCT (user, slug) is an aggregate with map-side combine.
- The case-insensitive "email OR username" lookup is rewritten as an equi-join on
  exploded lower-cased keys; an OR join condition would be a nested-loop join.
- Per-key counts (ambiguous logins, first request of a pair) are aggregates joined back,
  not windows, so a hot key is combined map-side and AQE can split the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import has_permission
from .. import schemas as S
from ..session import bounded_broadcast
from .joins import request_left_join, with_exists_flag

DIM_LIMIT = 1_000_000


def role_slug_map(roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(role_id, role_name, slug) for every role-permission link (inner joins)."""
    p = bounded_broadcast(permissions.select(F.col("id").alias("permission_id"), "slug"), DIM_LIMIT)
    r = bounded_broadcast(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name")), DIM_LIMIT)
    return role_permissions.select("role_id", "permission_id").join(p, "permission_id").join(r, "role_id") \
        .select("role_id", "role_name", "slug")


def permissions_by_role(roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """J1 + A1, batch form: the DISTINCT slugs of every role, by role name."""
    return role_slug_map(roles, role_permissions, permissions).select("role_name", "slug").distinct()


def permissions_by_user(user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """J2 + A1, batch form: DISTINCT (user_id, slug). Users with no role have no rows."""
    p = permissions.select(F.col("id").alias("permission_id"), "slug")
    rs = bounded_broadcast(role_permissions.select("role_id", "permission_id").join(p, "permission_id")
                           .select("role_id", "slug").distinct(), DIM_LIMIT)
    return user_roles.select("user_id", "role_id").join(rs, "role_id").select("user_id", "slug").distinct()


def permission_lists(users: DataFrame, user_slugs: DataFrame) -> DataFrame:
    """A2: every user with the sorted list of its permission slugs (empty when none).
    A list is bounded by the number of distinct slugs, not by the user's row count."""
    lists = user_slugs.groupBy("user_id").agg(F.sort_array(F.collect_set("slug")).alias("permissions"))
    u = users.select(F.col("id").alias("user_id"), "username")
    return (u.join(lists, "user_id", "left")
             .select("user_id", "username",
                     F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions")))


def permission_checks(lists: DataFrame, slugs: list[str]) -> DataFrame:
    """F6 over a table: for every user and every probe slug, may the user do it?
    The probe list is a projection (explode), not a join."""
    probe = F.explode(F.array(*[F.lit(s) for s in slugs])).alias("slug")
    return (lists.select("user_id", "permissions", probe)
                 .select("user_id", "slug", has_permission("permissions", F.col("slug")).alias("allowed")))


def lookup_users_by_key(keys: DataFrame, users: DataFrame, key_id: str = "key_id",
                        login: str = "login") -> DataFrame:
    """F4 batch form: each login key matched case-insensitively against e-mail OR username.
    One row per key: found flag, number of matching users, the smallest matching id (the
    service takes whichever row the database returns first) and an ambiguous flag."""
    # one row per (user, distinct lower-cased key); deduped inside the row, no shuffle
    cand = users.select(F.col("id").alias("user_id"),
                        F.explode(F.array_distinct(F.array(F.lower("email"), F.lower("username")))).alias("lkey"))
    k = keys.select(F.col(key_id).alias("key_id"), F.col(login).alias("login"),
                    F.lower(F.col(login)).alias("lkey"))
    # users are counted once per distinct key, so a popular key never meets every one of its rows
    per_key = (request_left_join(k.select("lkey").distinct(), cand, "lkey").groupBy("lkey")
               .agg(F.count("user_id").alias("n_matches"), F.min("user_id").alias("user_id")))
    n = F.coalesce("n_matches", F.lit(0))
    return (k.join(per_key, "lkey", "left")
             .select("key_id", "login", (n > 0).alias("found"), "user_id", n.alias("n_matches"), (n > 1).alias("ambiguous")))


def sync_permission_lists(permissions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4 with whole lists (req_id, slugs array): (the new permissions table, an outcome per request).

    A list is one statement: a null slug in it rejects it whole (the column is NOT NULL), so none of its
    slugs is inserted for its sake. Null and empty lists are accepted and insert nothing."""
    bad = F.coalesce(F.exists("slugs", lambda x: x.isNull()), F.lit(False))
    judged = requests.select("req_id", (~bad).alias("accepted"), F.when(bad, F.lit(S.ERR_SLUG_NULL)).alias("error"),
                             F.coalesce(F.size(F.array_distinct(F.filter("slugs", lambda x: x.isNotNull()))), F.lit(0)).alias("n_slugs"), "slugs")
    rows = judged.filter("accepted").select(F.explode("slugs").alias("slug"))
    return sync_permissions(permissions, rows), judged.drop("slugs").withColumn("n_slugs", F.greatest("n_slugs", F.lit(0)))


def sync_permissions(permissions: DataFrame, requested: DataFrame, slug: str = "slug",
                     id_expr: Column | None = None) -> DataFrame:
    """U4: insert every requested slug not yet present; keep existing rows; never delete.
    Returns the new table with an ``inserted`` flag. New ids come from ``id_expr`` (default:
    a name-based id derived from the slug, so reruns are repeatable)."""
    new = (requested.select(F.col(slug).alias("slug")).filter(F.col("slug").isNotNull()).distinct()
           .join(permissions.select("slug"), "slug", "left_anti"))
    ide = id_expr if id_expr is not None else F.concat(F.lit("perm-"), F.substring(F.sha2("slug", 256), 1, 16))
    new = new.select(ide.alias("id"), "slug", F.lit(True).alias("inserted"))
    return permissions.select("id", "slug", F.lit(False).alias("inserted")).unionByName(new)


def assign_roles(requests: DataFrame, users: DataFrame, roles: DataFrame, user_roles: DataFrame,
                 req_id: str = "req_id") -> DataFrame:
    """J6 + U5 + A3: apply role requests (user_id, role_name) in req_id order.

    outcome: no_role (name unknown, checked first as the INSERT ... SELECT finds no row),
    no_user (role found but the user is missing: the foreign key rejects it), exists (the
    pair is already there, or an earlier request in the batch inserted it), inserted.
    rows_affected is 1 only for inserted.
    """
    r = bounded_broadcast(roles.select(F.col("name").alias("role_name"), F.col("id").alias("role_id")), DIM_LIMIT)
    q = requests.select(F.col(req_id).alias("req_id"), "user_id", "role_name").join(r, "role_name", "left")
    q = with_exists_flag(q, users.select(F.col("id").alias("user_id")), "user_id", "_user_ok")
    q = with_exists_flag(q, user_roles, ["user_id", "role_id"], "_pair_exists")
    cand = q.filter(F.col("role_id").isNotNull() & F.col("_user_ok") & F.col("_pair_exists").isNull())
    first = cand.groupBy("user_id", "role_id").agg(F.min("req_id").alias("req_id")) \
        .select("req_id", F.lit(True).alias("_first"))
    q = q.join(first, "req_id", "left")
    outcome = (F.when(F.col("role_id").isNull(), "no_role")
                .when(F.col("_user_ok").isNull(), "no_user")
                .when(F.col("_pair_exists") | F.col("_first").isNull(), "exists")
                .otherwise("inserted"))
    return q.select("req_id", "user_id", "role_name", "role_id", outcome.alias("outcome"),
                    F.when(outcome == "inserted", 1).otherwise(0).alias("rows_affected"))


def apply_role_assignments(user_roles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The user_roles table after the inserted pairs of ``assign_roles``."""
    new = outcomes.filter(F.col("outcome") == "inserted").select("user_id", "role_id")
    return user_roles.select("user_id", "role_id").unionByName(new)
