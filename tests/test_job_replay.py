"""Coupled replay of job commands against one-by-one processing."""

import datetime as dt
import random

import pytest

from reelhouse.operators import job_replay as J

TS = dt.datetime(2024, 1, 1)
CMDS = "seq long, job_id string, cmd string, duration long, result string, error_msg string"
JOBS = "id string, video_id string, type string, status string, result string, error_msg string, created_at timestamp, updated_at timestamp"
VIDEOS = "id string, title string, description string, duration long, filename string, resource_id string, status string, " \
         "created_at timestamp, updated_at timestamp"


def _job(i, v, status):
    return (i, v, "transcode", status, "", "", TS, TS)


def _video(i, status, duration=0):
    return (i, "t", "d", duration, "f", "r", status, TS, TS)


def _one_by_one(cmds, jobs, videos):
    """The service's use cases, a command at a time."""
    js, vs, out = {j[0]: [j[1], j[3]] for j in jobs}, {v[0]: [v[6], v[3]] for v in videos}, {}
    for seq, job, cmd, duration, result, msg in sorted(cmds):
        duration = duration or 0

        def step():
            if cmd not in ("start", "complete", "fail"):
                return "unknown command"
            if job not in js:
                return "job not found"
            if cmd == "start" and js[job][1] not in ("pending", "failed"):
                return "job cannot be started"
            if cmd == "complete" and js[job][1] != "running":
                return "job cannot be completed"
            if cmd == "fail" and js[job][1] != "running":
                return "job cannot be marked as failed"
            v = vs.get(js[job][0])
            if v is None:
                return "video not found"
            if cmd == "start":
                if v[0] not in ("pending", "failed"):
                    return "video cannot be marked as processing"
                js[job][1], v[0] = "running", "processing"
            elif cmd == "complete":
                if v[1] != 0:
                    return "video duration has already been set"
                if duration < 0:
                    return "video duration cannot be negative"
                if v[0] != "processing":
                    return "video cannot be published"
                js[job][1], v[0], v[1] = "completed", "published", duration
            else:
                if v[0] != "processing":
                    return "video cannot be marked as failed"
                js[job][1], v[0] = "failed", "failed"

        err = step()
        v = vs.get(js[job][0]) if job in js else None
        out[seq] = (err is None, err, js[job][1] if job in js else None, v and v[0], v and v[1],
                    result if err is None and cmd == "complete" else None, msg if err is None and cmd == "fail" else None)
    return out, js, vs


def _check(spark, cmds, jobs, videos):
    tables = [spark.createDataFrame(r, s) for r, s in ((cmds, CMDS), (jobs, JOBS), (videos, VIDEOS))]
    out = J.replay_job_batch(*tables)
    want, js, vs = _one_by_one(cmds, jobs, videos)
    rows = out.collect()
    assert {r.seq: (r.accepted, r.error, r.job_status, r.video_status, r.video_duration, r.job_result, r.job_error_msg)
            for r in rows} == want and len(rows) == len(cmds)
    after_j, after_v = J.replayed_states(out, *tables[1:], TS)
    assert {r.id: [r.video_id, r.status] for r in after_j.collect()} == js
    assert {r.id: [r.status, r.duration] for r in after_v.collect()} == vs
    return want


def test_random_interleavings(spark):
    rng = random.Random(7)
    videos = [_video(f"v{i}", rng.choice(["pending", "pending", "failed", "processing", "published", "archived"]),
                     rng.choice([0, 0, 0, 5])) for i in range(12)]
    jobs = [_job(f"j{i}", f"v{i % 14}", rng.choice(["pending", "running", "failed", "completed"])) for i in range(40)]  # v12, v13: none
    cmds = [(s, f"j{rng.randrange(42)}", rng.choice(["start", "start", "complete", "fail", "fail", "other"]),
             rng.choice([-1, 0, 0, 7, None]), f"r{s}", f"e{s}") for s in rng.sample(range(5000), 700)]
    want = _check(spark, cmds, jobs, videos)
    assert len({e for _, e, *_ in want.values()}) == 12  # accepted, and every rule


def test_start_then_complete_with_a_rival_between(spark):
    """A second job's start is rejected while the first runs, its complete never finds it running."""
    jobs = [_job("a", "v", "pending"), _job("b", "v", "pending")]
    cmds = [(1, "a", "start", None, "", ""), (2, "b", "start", None, "", ""), (3, "b", "complete", 9, "m", ""),
            (4, "a", "complete", 120, "m.mpd", ""), (5, "b", "start", None, "", ""), (6, "a", "complete", 1, "x", "")]
    want = _check(spark, cmds, jobs, [_video("v", "pending")])
    assert [want[s][0] for s in range(1, 7)] == [True, False, False, True, False, False]
    assert want[4][3:6] == ("published", 120, "m.mpd")


def test_hot_video_takes_rounds_by_accepted_commands_only(spark, monkeypatch):
    """4,000 commands of one video, six of them accepted: seven rounds."""
    rounds = []
    cut = J.checkpoint_cut
    monkeypatch.setattr(J, "checkpoint_cut", lambda df: rounds.append(1) or cut(df))
    jobs = [_job(f"j{i}", "hot", "pending") for i in range(50)] + [_job("k", "cold", "pending")]
    cmds = [(s, f"j{s % 50}", "complete", -1, "", "") for s in range(4000)]
    for s, (job, cmd) in zip((10, 500, 1200, 1500, 3000, 3900), (("j1", "start"), ("j1", "fail"), ("j7", "start"), ("j7", "fail"),
                                                                ("j1", "start"), ("j1", "complete"))):
        cmds[s] = (s, job, cmd, 60, "m", "e")
    cmds.append((9999, "k", "start", None, "", ""))
    want = _check(spark, cmds, jobs, [_video("hot", "pending"), _video("cold", "pending")])
    assert sum(w[0] for w in want.values()) == 7 and len(rounds) == 1 + 7


def test_repeated_seq_is_refused_and_no_commands(spark):
    jobs, videos = [_job("a", "v", "pending"), _job("b", "v", "pending")], [_video("v", "pending")]
    cmds = [(1, "a", "start", None, "", ""), (1, "b", "start", None, "", ""), (2, "a", "fail", None, "", "")]
    tables = [spark.createDataFrame(r, s) for r, s in ((cmds, CMDS), (jobs, JOBS), (videos, VIDEOS))]
    with pytest.raises(ValueError):
        J.replay_job_batch(*tables)
    assert J.replay_job_batch(tables[0].limit(0), *tables[1:]).count() == 0


def test_videos_with_few_commands_take_no_rounds(spark, monkeypatch):
    """30 accepted commands in each of 40 videos' chains are folded, without a round; two at one place go in rounds."""
    cuts = []
    cut = J.checkpoint_cut
    monkeypatch.setattr(J, "checkpoint_cut", lambda df: cuts.append(1) or cut(df))
    videos = [_video(f"v{i}", "pending") for i in range(40)]
    jobs = [_job(f"j{i}", f"v{i % 40}", "pending") for i in range(80)]
    cmds = [(100 * s + i, f"j{i + 40 * (s // 2 % 2)}", "fail" if s % 2 else "start", None, "r", f"e{s}") for s in range(30) for i in range(40)]
    want = _check(spark, cmds, jobs, videos)
    assert all(w[0] for w in want.values()) and len(cuts) == 1
    twice = [(1, "j0", "start", None, "r", "e"), (1, "j0", "start", None, "r", "e"), (2, "j0", "fail", None, "r", "e"), (3, "j1", "start", None, "r", "e")]
    out = J.replay_job_batch(*[spark.createDataFrame(r, s) for r, s in ((twice, CMDS), (jobs, JOBS), (videos, VIDEOS))])
    assert out.filter("accepted").count() == out.count() == 4 and len(cuts) == 1 + 1 + 2
