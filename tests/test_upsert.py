"""Keyed upserts and partial updates."""

import datetime as dt

from reelhouse import schemas as S
from reelhouse.operators import upsert as U

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 1, 2)


def test_job_upsert_keeps_immutable(spark):
    target = spark.createDataFrame([("job-1", "vid-1", "transcode", "pending", "", "", T0, T0)], S.JOBS)
    changes = spark.createDataFrame(
        [(1, "job-1", "vid-OTHER", "thumbnail", "running", "", "boom", T1, T1)],
        "seq long, id string, video_id string, type string, status string, result string, error_msg string, "
        "created_at timestamp, updated_at timestamp")
    out = U.upsert_jobs(target, changes).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.status, r.error_msg, r.updated_at) == ("running", "boom", T1)
    assert (r.video_id, r.type, r.created_at) == ("vid-1", "transcode", T0)
    assert r.action == "update" and r.rows_affected == 1


def test_new_key_several_changes(spark):
    target = spark.createDataFrame([], S.JOBS)
    changes = spark.createDataFrame(
        [(1, "job-9", "vid-1", "transcode", "pending", "", "", T0, T0),
         (2, "job-9", "vid-2", "transcode", "running", "", "", T1, T1)],
        "seq long, id string, video_id string, type string, status string, result string, error_msg string, "
        "created_at timestamp, updated_at timestamp")
    r = U.upsert_jobs(target, changes).collect()[0]
    # first save inserts everything, the second only changes the mutable columns
    assert (r.video_id, r.created_at, r.status, r.updated_at, r.action) == ("vid-1", T0, "running", T1, "insert")


def test_upsert_twice_equals_once(spark):
    target = spark.createDataFrame([("vid-1", "Old", "d", 0, "f", "r", "pending", T0, T0)], S.VIDEOS)
    changes = spark.createDataFrame(
        [(1, "vid-1", "New", "d", 0, "f", "r", "published", T1, T1)],
        "seq long, id string, title string, description string, duration long, filename string, "
        "resource_id string, status string, created_at timestamp, updated_at timestamp")
    once = U.upsert_videos(target, changes).drop("action", "rows_affected")
    twice = U.upsert_videos(once, changes).drop("action", "rows_affected")
    assert sorted(once.collect()) == sorted(twice.collect())
    r = once.collect()[0]
    assert (r.title, r.status, r.created_at) == ("New", "published", T0)


def test_partial_update(spark):
    videos = spark.createDataFrame([("vid-1", "Old Title", "Old Desc", 0, "f", "r", "pending", T0, T0),
                                    ("vid-2", "A", "B", 0, "f", "r", "pending", T0, T0)], S.VIDEOS)
    patches = spark.createDataFrame([("vid-1", "New Title", None), ("vid-2", "", "x"), ("vid-3", "t", None)],
                                    "id string, title string, description string")
    got = {r.id: r for r in U.patch_videos(videos, patches).collect()}
    assert (got["vid-1"].outcome, got["vid-1"].title, got["vid-1"].description) == ("updated", "New Title", "Old Desc")
    assert got["vid-2"].error == S.ERR_TITLE_EMPTY and got["vid-2"].title == "A"
    assert got["vid-3"].error == S.ERR_VIDEO_NOT_FOUND
    applied = {r.id: r for r in U.apply_patches(videos, U.patch_videos(videos, patches), T1).collect()}
    assert applied["vid-1"].title == "New Title" and applied["vid-1"].updated_at == T1
    assert applied["vid-2"].updated_at == T0


def test_broadcast_and_shuffle_paths_agree(spark):
    target = spark.range(200).selectExpr(
        "concat('job-', id) AS id", "'v' AS video_id", "'transcode' AS type", "'pending' AS status",
        "'' AS result", "'' AS error_msg", "TIMESTAMP '2024-01-01 00:00:00' AS created_at",
        "TIMESTAMP '2024-01-01 00:00:00' AS updated_at")
    changes = spark.range(300).selectExpr(
        "id AS seq", "concat('job-', id % 250) AS id", "'v2' AS video_id", "'transcode' AS type",
        "CASE WHEN id % 2 = 0 THEN 'running' ELSE 'failed' END AS status", "'' AS result", "'x' AS error_msg",
        "TIMESTAMP '2024-02-01 00:00:00' AS created_at", "TIMESTAMP '2024-02-01 00:00:00' AS updated_at")
    small = U.keyed_upsert(target, changes, ["id"], U.JOB_IMMUTABLE, U.JOB_MUTABLE)
    big = U.keyed_upsert(target, changes, ["id"], U.JOB_IMMUTABLE, U.JOB_MUTABLE, max_broadcast_rows=10)
    assert sorted(small.collect()) == sorted(big.collect())
    assert small.count() == 250 and small.filter("action = 'insert'").count() == 50
    plan = small._jdf.queryExecution().executedPlan().toString()
    # the only shuffles collapse the change set; the target side is joined by broadcast
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString() or \
        "ShuffledHashJoin" in big._jdf.queryExecution().executedPlan().toString()


def test_patches_of_one_video_apply_in_order(spark):
    videos = spark.createDataFrame([("v", "Old", "D", 0, "f", "r", "pending", T0, T0)], S.VIDEOS)
    patches = spark.createDataFrame([(1, "v", "A", None), (2, "v", "Old", "E"), (3, "v", None, ""), (4, "v", None, None)],
                                    "seq long, id string, title string, description string")
    rows = U.apply_patches(videos, U.patch_videos(videos, patches), T1).collect()
    assert [(r.title, r.description, r.updated_at) for r in rows] == [("Old", "E", T1)]
