"""Integrity and audit operators: referential checks and cascades (U8), uniqueness and
NOT NULL checks (U9), record validation (F9), asset-path containment (F10), request auth
classification (F11) and claims checks (F12).

All are anti-joins, aggregates or per-row expressions; the anti-joins shuffle both sides on
the key once (AQE may broadcast a side that turns out small at runtime).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import blank, clean_path, first_error


def orphans(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """U8: child rows whose parent key is missing (an anti join never duplicates rows, so
    the parent keys need no DISTINCT)."""
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_key, child_key)])
    return child.join(p, child_key, "left_anti")


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """U8 ON DELETE CASCADE: the child table after removing rows of deleted parents."""
    d = deleted_parents.select(F.col(parent_key).alias(child_key))
    return child.join(d, child_key, "left_anti")


def duplicate_keys(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Key values held by more than one row (PK / UNIQUE violations), with counts."""
    kv = F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key_value")
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1)
              .select(F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("key_name"),
                      kv, "n_rows"))


def null_counts(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """U9 NOT NULL: per column, the number of NULLs (one pass, one row per column)."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols]))
    return agg.select(stack.alias("s")).select(F.lit(table).alias("table_name"), "s.column_name",
                                              F.coalesce("s.n_null", F.lit(0)).alias("n_null"))


# ---------------------------------------------------------------- F9 record validation
def video_error(id_col="id", filename="filename", resource_id="resource_id") -> Column:
    return first_error((blank(id_col), S.ERR_VIDEO_ID_EMPTY), (blank(filename), S.ERR_FILENAME_EMPTY),
                       (blank(resource_id), S.ERR_RESOURCE_ID_EMPTY))


def job_error(id_col="id", video_id="video_id", job_type="type") -> Column:
    return first_error((blank(id_col), S.ERR_JOB_ID_EMPTY), (blank(video_id), S.ERR_JOB_VIDEO_ID_EMPTY),
                       (~F.coalesce(F.col(job_type).isin(*S.JOB_TYPES), F.lit(False)), S.ERR_JOB_TYPE_INVALID))


def user_error(id_col="id", email="email", username="username", password_hash="password_hash") -> Column:
    return first_error((blank(id_col), S.ERR_USER_ID_EMPTY), (blank(email), S.ERR_EMAIL_EMPTY),
                       (blank(username), S.ERR_USERNAME_EMPTY), (blank(password_hash), S.ERR_PWD_HASH_EMPTY))


def progress_error(total="total_frames") -> Column:
    return first_error((F.col(total) == 0, S.ERR_TOTAL_FRAMES_ZERO))


def validate(df: DataFrame, kind: str, id_col: str = "id") -> DataFrame:
    """F9 over a table: one row per record with the first failing rule (NULL = accepted)."""
    err = {"video": video_error, "job": job_error, "user": user_error}[kind]()
    return df.select(F.lit(kind).alias("kind"), F.col(id_col).alias("record_id"), err.alias("error"))


# ---------------------------------------------------------------- F10 / F11 / F12 audits
def path_audit(requests: DataFrame, base: str, resource_id: str = "resource_id",
               filename: str = "filename") -> DataFrame:
    """join base / resource / file, clean it, and allow it only inside base. The base is
    cleaned too and compared with a trailing '/', so '/base-evil' is not inside '/base'."""
    full = F.concat_ws("/", F.lit(base), F.col(resource_id), F.col(filename))
    cleaned = clean_path(full)
    base_clean = clean_path(F.lit(base))
    inside = cleaned.startswith(F.concat(base_clean, F.lit("/")))
    return requests.select("*", cleaned.alias("clean_path"), inside.alias("allowed"),
                           F.when(~inside, F.lit(S.ERR_INVALID_PATH)).alias("error"))


def classify_auth(requests: DataFrame, header: str = "auth_header", query_token: str = "query_token") -> DataFrame:
    """Authorization header 'Bearer <t>' else the 'token' query parameter else reject.
    A header that is not exactly two space-separated parts with 'Bearer' first is an invalid
    format; 'Bearer ' (empty token) falls through to the query parameter."""
    h = F.coalesce(F.col(header), F.lit(""))
    parts = F.split(h, " ")
    bad_format = (h != "") & ((F.size(parts) != 2) | (F.element_at(parts, 1) != "Bearer"))
    header_tok = F.when((h != "") & ~bad_format, F.element_at(parts, 2)).otherwise(F.lit(""))
    q = F.coalesce(F.col(query_token), F.lit(""))
    token = F.when(header_tok != "", header_tok).otherwise(q)
    source = F.when(header_tok != "", "header").when(q != "", "query")
    outcome = (F.when(bad_format, S.ERR_INVALID_TOKEN_FORMAT)
                .when(token == "", S.ERR_UNAUTHORIZED)
                .otherwise("candidate"))
    return requests.select("*", outcome.alias("outcome"),
                           F.when(outcome == "candidate", token).alias("token"),
                           F.when(outcome == "candidate", source).alias("token_source"))


def claims_audit(claims: DataFrame, now, user_id: str = "user_id", expires_at: str = "expires_at") -> DataFrame:
    """a claim is valid when its user id is non-empty and it is not expired at ``now``
    (a missing expiry passes). Both failures are reported, expiry first (the token library
    checks registered claims before calling the custom validation)."""
    expired = F.col(expires_at).isNotNull() & (F.col(expires_at) <= F.lit(now).cast("timestamp"))
    missing = blank(user_id)
    errors = F.concat_ws("; ", F.when(expired, F.lit(S.ERR_TOKEN_EXPIRED)), F.when(missing, F.lit(S.ERR_MISSING_USER_ID)))
    return claims.select("*", (~expired & ~missing).alias("valid"),
                         F.when(errors != "", errors).alias("error"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
