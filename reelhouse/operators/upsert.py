"""Keyed upserts (U1-U3), partial updates (U6) and the write's affected-row count (A3).

Parquet tables have no MERGE, so an upsert produces the next version of the table:

    changes --(collapse per key: immutable from the first change, mutable from the last)-->
    full-outer-join target on key --> per column: immutable = target-if-present else change,
                                       mutable   = change-if-present else target

Saving one key several times in one batch equals saving the changes one after another:
the first save inserts every column, later saves only overwrite the mutable ones.

Scale notes
- The collapse is an aggregate (min_by / max_by on seq) with map-side combine, so a key
  changed a billion times shrinks to one row per task before the shuffle.
- A change set proven small is broadcast: the target is only scanned (a left join for
  updates / kept rows, a key-only semi join to find which change keys exist), never
  shuffled. A large change set falls back to one full outer join shuffling both sides on
  the key (a target bucketed by the key skips its side of that shuffle; AQE splits skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import first_error
from ..session import measured_side
from .joins import join_back

# Column roles of each table on conflict (from the service's ON CONFLICT clauses).
VIDEO_IMMUTABLE = ["created_at"]
VIDEO_MUTABLE = ["title", "description", "duration", "filename", "resource_id", "status", "updated_at"]
JOB_IMMUTABLE = ["video_id", "type", "created_at"]
JOB_MUTABLE = ["status", "result", "error_msg", "updated_at"]
USER_IMMUTABLE = ["created_at"]
USER_MUTABLE = ["email", "username", "password_hash", "updated_at"]


def collapse_changes(changes: DataFrame, key: list[str], immutable: list[str], mutable: list[str],
                     seq: str = "seq") -> DataFrame:
    """One row per key: immutable columns from the first change, mutable from the last."""
    agg = changes.groupBy(*key).agg(
        F.min_by(F.struct(*immutable), seq).alias("_first") if immutable else F.lit(None).alias("_first"),
        F.max_by(F.struct(*mutable), seq).alias("_last"),
        F.count(F.lit(1)).alias("_n_changes"))
    cols = [F.col(k) for k in key] + [F.col(f"_first.{c}").alias(c) for c in immutable] + \
           [F.col(f"_last.{c}").alias(c) for c in mutable] + [F.col("_n_changes")]
    return agg.select(*cols)


def keyed_upsert(target: DataFrame, changes: DataFrame, key: list[str], immutable: list[str],
                 mutable: list[str], seq: str = "seq", max_broadcast_rows: int = 200_000) -> DataFrame:
    """The next version of ``target`` after applying ``changes``, with an ``action`` column
    (insert / update / keep) and ``rows_affected`` (A3: 1 for insert or update).

    When the collapsed change set is proven small (at most ``max_broadcast_rows`` keys) the
    target is never shuffled: it is left-joined to the broadcast changes (updates and kept
    rows), the change keys already present are found by a key-only scan of the target
    (broadcast semi join), and the remaining changes are appended as inserts. Otherwise both
    sides are shuffled once for a full outer join."""
    cols = key + immutable + mutable
    c = collapse_changes(changes, key, immutable, mutable, seq)
    c = c.select(*key, *[F.col(x).alias(f"_c_{x}") for x in immutable + mutable], F.lit(True).alias("_in_c"))
    c, proven_small = measured_side(c, max_broadcast_rows)
    t = target.select(*key, *[F.col(x).alias(f"_t_{x}") for x in immutable + mutable],
                      F.lit(True).alias("_in_t"))
    if proven_small:
        cb = F.broadcast(c)
        present = target.select(*key).join(cb.select(*key), key, "left_semi").distinct()  # key-only scan; only matches move
        inserts = cb.join(F.broadcast(present), key, "left_anti")  # present has at most |changes| keys
        j = t.join(cb, key, "left").unionByName(inserts.select("*", F.lit(None).cast("boolean").alias("_in_t")),
                                               allowMissingColumns=True)
    else:
        j = t.join(c, key, "full_outer")
    in_t = F.coalesce(F.col("_in_t"), F.lit(False))
    in_c = F.coalesce(F.col("_in_c"), F.lit(False))
    out = [F.col(k) for k in key]
    out += [F.when(in_t, F.col(f"_t_{x}")).otherwise(F.col(f"_c_{x}")).alias(x) for x in immutable]
    out += [F.when(in_c, F.col(f"_c_{x}")).otherwise(F.col(f"_t_{x}")).alias(x) for x in mutable]
    action = F.when(~in_t, "insert").when(in_c, "update").otherwise("keep")
    res = j.select(*out, action.alias("action"))
    return res.select(*[c for c in target.columns if c in cols], "action",
                      F.when(F.col("action") == "keep", 0).otherwise(1).alias("rows_affected"))


def upsert_videos(videos: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """All columns change on conflict except created_at."""
    return keyed_upsert(videos, changes, ["id"], VIDEO_IMMUTABLE, VIDEO_MUTABLE, seq)


def upsert_jobs(jobs: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Only status, result, error_msg, updated_at change (video_id, type, created_at kept)."""
    return keyed_upsert(jobs, changes, ["id"], JOB_IMMUTABLE, JOB_MUTABLE, seq)


def upsert_users(users: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Email, username, password_hash, updated_at change on conflict."""
    return keyed_upsert(users, changes, ["id"], USER_IMMUTABLE, USER_MUTABLE, seq)


def patch_videos(videos: DataFrame, patches: DataFrame, now=None) -> DataFrame:
    """U6 + X6: partial update. NULL = leave unchanged; '' is rejected (title checked
    before description); a patch for an unknown id is 'video not found'. One row per patch
    with the outcome and the resulting title / description. Where an id may come twice, give
    ``patches`` a ``seq``: it is kept with the accepted texts, for ``apply_patches``."""
    v = videos.select("id", F.col("title").alias("_old_title"), F.col("description").alias("_old_desc"),
                      F.lit(True).alias("_found"))
    from .joins import request_left_join
    seq = [c for c in ("seq",) if c in patches.columns]
    p = patches.select("id", *seq, F.col("title").alias("_new_title"), F.col("description").alias("_new_desc"))
    j = request_left_join(p, v, "id")
    err = first_error(
        (F.col("_found").isNull(), S.ERR_VIDEO_NOT_FOUND),
        (F.col("_new_title") == "", S.ERR_TITLE_EMPTY),
        (F.col("_new_desc") == "", S.ERR_DESCRIPTION_EMPTY),
    )
    ok = err.isNull()
    changed = F.col("_new_title").isNotNull() | F.col("_new_desc").isNotNull()
    return j.select(
        "id",
        F.when(ok, "updated").otherwise("rejected").alias("outcome"),
        err.alias("error"),
        F.when(ok, F.coalesce("_new_title", "_old_title")).otherwise(F.col("_old_title")).alias("title"),
        F.when(ok, F.coalesce("_new_desc", "_old_desc")).otherwise(F.col("_old_desc")).alias("description"),
        (ok & changed).alias("touched"),
        *[c for s in seq for c in (F.col(s), F.when(ok, F.col("_new_title")).alias("new_title"),
                                   F.when(ok, F.col("_new_desc")).alias("new_description"))])


def apply_patches(videos: DataFrame, patched: DataFrame, now) -> DataFrame:
    """The videos table after the accepted patches (updated_at = now where touched). Patches of
    one id apply in ``seq`` order, so of each text the last one given stays; without ``seq`` an
    id is patched once."""
    acc = patched.filter(F.col("outcome") == "updated")
    if "seq" in patched.columns:
        def last(c):
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
        acc = acc.groupBy("id").agg(last("new_title").alias("_pt"), last("new_description").alias("_pd"),
                                    F.bool_or("touched").alias("_touched"))
    else:
        acc = acc.select("id", F.col("title").alias("_pt"), F.col("description").alias("_pd"),
                         F.col("touched").alias("_touched"))
    j = join_back(videos, acc, "id", "left")  # accepted patches: broadcast when proven small
    out = []
    for c in videos.columns:
        if c == "title":
            out.append(F.coalesce("_pt", "title").alias(c))
        elif c == "description":
            out.append(F.coalesce("_pd", "description").alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_touched"), F.lit(now).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def apply_updates(target: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite the columns present in ``updates`` (one row per key) on matching rows of
    ``target``; other rows and columns are kept. A left join on the key (one shuffle)."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = join_back(target, u, key, "left")  # a small update set is broadcast; the target is scanned
    return j.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in target.columns])
