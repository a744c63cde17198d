"""Catalog reads: the service's own repository cases."""

import datetime as dt

import pytest

from reelhouse import schemas as S
from reelhouse.operators import lookup as L

NOW = dt.datetime(2024, 1, 15, 12, 0, 0)


def jobs_df(spark, rows):
    full = [(i, v, t, s, "", "", c, c) for i, v, t, s, c in rows]
    return spark.createDataFrame(full, S.JOBS)


def videos_df(spark, rows):
    full = [(i, "t", "d", dur, "f.mp4", "res-" + i, st, c, c) for i, st, dur, c in rows]
    return spark.createDataFrame(full, S.VIDEOS)


def test_oldest_pending_transcode(spark):
    jobs = jobs_df(spark, [
        ("job-1", "v", "transcode", "running", NOW - dt.timedelta(hours=1)),
        ("job-2-oldest", "v", "transcode", "pending", NOW - dt.timedelta(minutes=30)),
        ("job-3-newer", "v", "transcode", "pending", NOW),
        ("job-4-thumbnail", "v", "thumbnail", "pending", NOW - dt.timedelta(hours=1)),
    ])
    out = L.next_pending_jobs(jobs, free_slots=1).collect()
    assert [r.id for r in out] == ["job-2-oldest"]
    # T4: two free slots take the two oldest runnable jobs
    assert [r.id for r in L.next_pending_jobs(jobs, free_slots=2).collect()] == ["job-2-oldest", "job-3-newer"]


def test_no_pending_job(spark):
    jobs = jobs_df(spark, [("job-1", "v", "transcode", "running", NOW)])
    assert L.next_pending_jobs(jobs, 1).count() == 0


def test_latest_job_ties_break_on_id(spark):
    jobs = jobs_df(spark, [("job-a", "v1", "transcode", "completed", NOW),
                           ("job-b", "v1", "transcode", "failed", NOW),
                           ("job-c", "v1", "transcode", "pending", NOW - dt.timedelta(days=1)),
                           ("job-d", "v2", "transcode", "pending", NOW)])
    got = {r.video_id: r.id for r in L.latest_job_per_video(jobs).collect()}
    assert got == {"v1": "job-b", "v2": "job-d"}
    got_w = {r.video_id: r.id for r in L.latest_job_per_video_agg(jobs).collect()}
    assert got_w == got


def test_video_lookup_found_and_missing(spark):
    videos = videos_df(spark, [("vid-1", "pending", 0, NOW)])
    keys = spark.createDataFrame([("vid-1",), ("non-existent-id",)], "id string")
    got = {r.id: r.found for r in L.lookup_videos(keys, videos).collect()}
    assert got == {"vid-1": True, "non-existent-id": False}


def test_info_projection(spark):
    videos = videos_df(spark, [("vid-1", "published", 120 * 10**9, NOW)])
    jobs = spark.createDataFrame([("job-1", "vid-1", "transcode", "completed", "manifest.mpd", "", NOW, NOW)], S.JOBS)
    r = L.video_info(videos, jobs).collect()[0]
    assert r.duration_seconds == 120.0 and r.manifest_path == "manifest.mpd" and r.error_message == ""
    assert r.source_filename == "f.mp4"


def test_page_rules(spark):
    videos = videos_df(spark, [(f"vid-{i:02d}", "published" if i % 2 else "pending", 0, NOW + dt.timedelta(minutes=i))
                               for i in range(30)])
    p1 = [r.id for r in L.published_page(videos, 1).collect()]
    p2 = [r.id for r in L.published_page(videos, 2).collect()]
    assert len(p1) == 10 and len(p2) == 5 and not set(p1) & set(p2)
    with pytest.raises(ValueError):
        L.published_page(videos, 0)


def test_request_left_join_paths(spark):
    from reelhouse.operators.joins import request_left_join
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v long")
    req = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "w"), ("z", "u")], "k string, r string")
    plain = sorted(req.join(table, "k", "left").select("k", "r", "v").collect())
    small = request_left_join(req, table, "k")
    assert sorted(small.select("k", "r", "v").collect()) == plain
    assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()
    big = request_left_join(req, table, "k", max_rows=1)
    assert sorted(big.select("k", "r", "v").collect()) == plain


def test_keyset_pages_equal_offset_pages(spark):
    videos = videos_df(spark, [(f"vid-{i:02d}", "published" if i % 3 else "pending", 0,
                                NOW + dt.timedelta(minutes=i // 2)) for i in range(60)])
    after = None
    for page in range(1, 6):
        by_offset = [r.id for r in L.published_page(videos, page).collect()]
        rows = L.published_page_after(videos, after).collect()
        assert [r.id for r in rows] == by_offset
        if rows:
            after = (rows[-1].created_at, rows[-1].id)


def test_exists_flag_and_join_back_paths(spark):
    from reelhouse.operators.joins import join_back, with_exists_flag
    table = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    req = spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "k string, n long")
    for limit in (200_000, 0):
        got = sorted((r.n, r.hit) for r in with_exists_flag(req, table, "k", "hit", max_rows=limit).collect())
        assert got == [(1, True), (2, None), (3, None)]
    summary = spark.createDataFrame([("a", 10)], "k string, s long")
    for limit in (200_000, 0):
        got = sorted((r.n, r.s) for r in join_back(req, summary, "k", "left", max_rows=limit).collect())
        assert got == [(1, 10), (2, None), (3, None)]
