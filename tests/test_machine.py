"""State machines: every legal / illegal single transition, replay against a sequential
brute force (including a tiny branching factor so the tree fold uses several levels), and
the composite job use cases."""

import datetime as dt
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from reelhouse import schemas as S
from reelhouse.operators import machine as M

VIDEO_CMDS = ["process", "publish", "fail", "archive", "update", "bogus"]


def brute(machine, start, cmds):
    state, acc, last_err = start, 0, None
    for c in cmds:
        mv = machine.moves.get(c)
        if mv is not None and state in mv:
            state, acc = mv[state], acc + 1
        else:
            last_err = machine.errors[c] if mv is not None else machine.unknown_error
    return state, acc, last_err


def test_single_transitions(spark):
    rows = []
    for i, s in enumerate(S.VIDEO_STATUSES):
        for j, c in enumerate(VIDEO_CMDS):
            rows.append((f"{s}|{c}", s, c))
    init = spark.createDataFrame([(k, s) for k, s, _ in rows], "video_id string, status string")
    cmds = spark.createDataFrame([(k, 1, c) for k, _, c in rows], "video_id string, seq long, cmd string")
    got = {r.video_id: r for r in M.VIDEO_MACHINE.replay(cmds, "video_id", "seq", "cmd", initial=init).collect()}
    for k, s, c in rows:
        exp = brute(M.VIDEO_MACHINE, s, [c])
        r = got[k]
        assert (r.status, r.n_accepted, r.last_error) == exp, (k, r)


def _replay_vs_brute(spark, seqs, branching):
    data = []
    for e, cmds in enumerate(seqs):
        for i, c in enumerate(cmds):
            data.append((f"v{e}", i * 7 + e, c))
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "video_id string, seq long, cmd string")
    got = {r.video_id: r for r in M.VIDEO_MACHINE.replay(df, "video_id", "seq", "cmd", initial_state="pending",
                                                          branching=branching).collect()}
    for e, cmds in enumerate(seqs):
        if not cmds:
            continue
        exp = brute(M.VIDEO_MACHINE, "pending", cmds)
        r = got[f"v{e}"]
        assert (r.status, r.n_accepted, r.last_error, r.n_commands) == exp + (len(cmds),)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(VIDEO_CMDS), max_size=40), min_size=1, max_size=6))
def test_replay_matches_sequential(spark, seqs):
    _replay_vs_brute(spark, seqs, branching=2)


def test_hot_entity_many_levels(spark):
    rnd = random.Random(7)
    seqs = [[rnd.choice(VIDEO_CMDS) for _ in range(3000)], ["process", "publish"], []]
    _replay_vs_brute(spark, seqs, branching=4)


def test_job_replay_registers(spark):
    init = spark.createDataFrame([("j1", "pending", "", "")], "job_id string, status string, result string, error_msg string")
    cmds = spark.createDataFrame([("j1", 1, "start", "", ""), ("j1", 2, "fail", "", "oops"), ("j1", 3, "start", "", ""),
                                  ("j1", 4, "complete", "m.mpd", ""), ("j1", 5, "fail", "", "late"),
                                  ("jX", 1, "start", "", "")],
                                 "job_id string, seq long, cmd string, result string, error_msg string")
    got = {r.job_id: r for r in M.JOB_MACHINE.replay(cmds, "job_id", "seq", "cmd",
                                                      payload={"result": "result", "error_msg": "error_msg"},
                                                      initial=init).collect()}
    j1 = got["j1"]
    assert (j1.status, j1.result, j1.error_msg, j1.n_accepted, j1.last_error) == \
        ("completed", "m.mpd", "oops", 4, S.ERR_JOB_CANNOT_FAIL)
    assert not got["jX"].found and got["jX"].last_error == S.ERR_JOB_NOT_FOUND


NOW = dt.datetime(2024, 1, 15)


def _catalog(spark, video_status, job_status="running", duration=0):
    videos = spark.createDataFrame([("vid-1", "t", "d", duration, "f.mp4", "res-1", video_status, NOW, NOW)], S.VIDEOS)
    jobs = spark.createDataFrame([("job-1", "vid-1", "transcode", job_status, "", "", NOW, NOW),
                                  ("job-2", "vid-1", "transcode", job_status, "", "", NOW, NOW)], S.JOBS)
    return videos, jobs


def test_complete_job(spark):
    videos, jobs = _catalog(spark, "processing")
    batch = spark.createDataFrame([(1, "job-1", "manifest.mpd", 120 * 10**9), (2, "job-2", "m2", 5)],
                                  "seq long, job_id string, result string, duration long")
    got = {r.job_id: r for r in M.complete_jobs(batch, jobs, videos).collect()}
    r = got["job-1"]
    assert r.accepted and r.job_status == "completed" and r.video_status == "published"
    assert r.video_duration == 120 * 10**9 and r.job_result == "manifest.mpd"
    # the second completion sees the video the first one left behind
    assert not got["job-2"].accepted and got["job-2"].error == S.ERR_DURATION_SET


def test_complete_wrong_video_state(spark):
    videos, jobs = _catalog(spark, "pending")
    batch = spark.createDataFrame([(1, "job-1", "m", 5)], "seq long, job_id string, result string, duration long")
    r = M.complete_jobs(batch, jobs, videos).collect()[0]
    assert not r.accepted and r.error == S.ERR_VIDEO_CANNOT_PUBLISH and r.job_status == "running"


def test_start_jobs_job_rule_first(spark):
    videos, jobs = _catalog(spark, "pending", job_status="completed")
    batch = spark.createDataFrame([("job-1", 1)], "job_id string, seq long")
    r = M.start_jobs(batch, jobs, videos).collect()[0]
    assert r.error == S.ERR_JOB_CANNOT_START
    videos, jobs = _catalog(spark, "failed", job_status="pending")
    batch = spark.createDataFrame([("job-1", 1), ("job-2", 2), ("job-9", 3)], "job_id string, seq long")
    got = {r.job_id: r for r in M.start_jobs(batch, jobs, videos).collect()}
    assert got["job-1"].accepted and got["job-1"].resource_id == "res-1"
    assert got["job-2"].error == S.ERR_VIDEO_CANNOT_PROCESS
    assert got["job-9"].error == S.ERR_JOB_NOT_FOUND


def test_fail_and_archive(spark):
    videos, jobs = _catalog(spark, "processing")
    batch = spark.createDataFrame([(1, "job-1", "exit 1")], "seq long, job_id string, error_msg string")
    r = M.fail_jobs(batch, jobs, videos).collect()[0]
    assert r.accepted and r.video_status == "failed" and r.job_error_msg == "exit 1"
    pub = spark.createDataFrame([("vid-1", "t", "d", 0, "f", "r", "published", NOW, NOW)], S.VIDEOS)
    req = spark.createDataFrame([("vid-1",), ("vid-x",)], "id string")
    got = {r.id: r for r in M.archive_videos(req, pub).collect()}
    assert got["vid-1"].status == "archived" and got["vid-x"].error == S.ERR_VIDEO_NOT_FOUND


def test_duration_rules(spark):
    videos = spark.createDataFrame([("a", "t", "d", 0, "f", "r", "pending", NOW, NOW),
                                    ("b", "t", "d", 5, "f", "r", "pending", NOW, NOW)], S.VIDEOS)
    req = spark.createDataFrame([("a", -1), ("b", -1)], "id string, duration long")
    got = {r.id: r.error for r in M.set_duration(req, videos).collect()}
    assert got == {"a": S.ERR_DURATION_NEGATIVE, "b": S.ERR_DURATION_SET}  # set is checked before negative


def test_signup_conflicts_follow_the_accepted(spark):
    """Rivals of a rejected signup are judged as if it had not been there."""
    rows = [("a", "m@x", "n1", "", "r"), ("b", "m@x", "n2", "h", "r"), ("c", "m@x", "n3", "h", "r"),
            ("d", "p@x", "n3", "h", "r"), ("e", "q@x", "n3", "h", "r"), ("f", "q@x", "n4", "h", "r")]
    s = spark.createDataFrame(rows, "user_id string, email string, username string, password_hash string, role_name string")
    users = spark.createDataFrame([], S.USERS)
    roles = spark.createDataFrame([("1", "r")], "id string, name string")
    slugs = spark.createDataFrame([("r", "video:upload")], "role_name string, slug string")
    got = {r.user_id: r.error for r in M.signup_batch(s, users, roles, slugs, "2024-01-01 00:00:00").collect()}
    assert got == {"a": S.ERR_PWD_HASH_EMPTY, "b": None, "c": S.ERR_EMAIL_EXISTS, "d": None,
                   "e": S.ERR_USERNAME_EXISTS, "f": None}


def _edit_one_by_one(edits, videos):
    state = {v[0]: list(v[1:]) for v in videos}  # status, title, description, duration
    out = {}
    for vid, seq, cmd, text, duration in sorted(edits, key=lambda e: e[1]):
        n = out.setdefault(vid, [0, 0, None])
        n[0] += 1
        v = state.get(vid)
        if v is None:
            n[2] = "video not found"
            continue
        moves = {"process": (("pending", "failed"), "processing", "video cannot be marked as processing"),
                 "publish": (("processing",), "published", "video cannot be published"),
                 "fail": (("processing",), "failed", "video cannot be marked as failed"),
                 "archive": (("published",), "archived", "video cannot be archived")}
        if cmd in moves:
            starts, to, err = moves[cmd]
            if v[0] in starts:
                v[0], err = to, None
        elif cmd in ("set_title", "set_description"):
            err = None if text else f"video {cmd[4:]} cannot be empty"
            if not err:
                v[1 if cmd == "set_title" else 2] = text
        elif cmd == "set_duration":
            err = "video duration has already been set" if v[3] else "video duration cannot be negative" if (duration or 0) < 0 else None
            if not err:
                v[3] = duration or 0
        else:
            err = "unknown command"
        n[1] += err is None
        n[2] = err or n[2]
    return {vid: (vid in state, *(state.get(vid) or [None] * 4), *n) for vid, n in out.items()}


@pytest.mark.parametrize("branching", [2, 1024])
def test_guarded_edits_one_by_one(spark, branching):
    """Payload rules and the duration's flag survive composition, whatever the fan-in."""
    import random
    rng = random.Random(9)
    videos = [(f"v{i}", rng.choice(["pending", "processing", "published", "failed", "archived"]), f"t{i}", f"d{i}", rng.choice([0, 0, 9]))
              for i in range(15)]
    cmds = ["process", "publish", "fail", "archive", "set_title", "set_description", "set_duration", "set_duration", "other"]
    edits = [(f"v{rng.randrange(17)}", s, rng.choice(cmds), rng.choice([None, "", f"x{s}"]), rng.choice([-1, 0, None, s]))
             for s in rng.sample(range(1, 3000), 400)]
    e = spark.createDataFrame(edits, "video_id string, seq long, cmd string, text string, duration long")
    v = spark.createDataFrame(videos, "id string, status string, title string, description string, duration long")
    got = {r.video_id: (r.found, r.status, r.title, r.description, r.duration, r.n_commands, r.n_accepted, r.last_error)
           for r in M.replay_video_edits(e, v, branching=branching).collect()}
    assert got == _edit_one_by_one(edits, videos)


def test_repeated_archive_requests_are_rejected(spark):
    v = spark.createDataFrame([("a", "published"), ("b", "archived"), ("c", "published")], "id string, status string")
    r = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("b",), ("c",), ("x",)], "id string")
    got = sorted((r.id, r.accepted, r.error, r.status) for r in M.archive_videos(r, v).collect())
    no = "video cannot be archived"
    assert got == [("a", False, no, "archived")] * 2 + [("a", True, None, "archived")] + [("b", False, no, "archived")] * 2 + \
        [("c", True, None, "archived"), ("x", False, "video not found", None)]
