"""Path containment, auth header classification, claims, logs and integrity checks."""

import datetime as dt
import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st

from reelhouse import schemas as S
from reelhouse.functions.exprs import clean_path
from reelhouse.operators import integrity as I
from reelhouse.operators import logs as LG

PARTS = st.sampled_from(["a", "b", "..", ".", "", "x.ts", "etc"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=8).map(lambda p: ("/" if p and p[0] == "a" else "") + "/".join(p)),
                min_size=1, max_size=30))
def test_clean_path_matches_normpath(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(clean_path("p")).collect()]
    exp = []
    for p in paths:
        n = posixpath.normpath(p) if p else "."
        exp.append("/" + n.lstrip("/") if n.startswith("//") else n)
    assert got == exp


def test_path_audit(spark):
    req = spark.createDataFrame([("res-1", "manifest.mpd"), ("res-1", "../../etc/passwd"), ("res-1", "../x/seg.ts"),
                                 ("..", "storage-evil/x")], "resource_id string, filename string")
    got = [(r.clean_path, r.allowed) for r in I.path_audit(req, "/srv/storage").collect()]
    assert got == [("/srv/storage/res-1/manifest.mpd", True), ("/srv/etc/passwd", False),
                   ("/srv/storage/x/seg.ts", True), ("/srv/storage-evil/x", False)]


def test_auth_header_cases(spark):
    req = spark.createDataFrame([("Bearer tok", ""), ("bearer tok", ""), ("Bearer ", "q"), ("Bearer ", ""),
                                 ("Bearer a b", "q"), ("", "q"), ("", "")], "auth_header string, query_token string")
    got = [(r.outcome, r.token, r.token_source) for r in I.classify_auth(req).collect()]
    assert got == [("candidate", "tok", "header"), (S.ERR_INVALID_TOKEN_FORMAT, None, None),
                   ("candidate", "q", "query"), (S.ERR_UNAUTHORIZED, None, None),
                   (S.ERR_INVALID_TOKEN_FORMAT, None, None), ("candidate", "q", "query"),
                   (S.ERR_UNAUTHORIZED, None, None)]


def test_claims(spark):
    now = dt.datetime(2024, 1, 15)
    c = spark.createDataFrame([("", now + dt.timedelta(minutes=5)), ("u", now - dt.timedelta(minutes=1)),
                               ("u", None), ("u", now + dt.timedelta(days=1))], "user_id string, expires_at timestamp")
    got = [(r.valid, r.error) for r in I.claims_audit(c, now).collect()]
    assert got == [(False, S.ERR_MISSING_USER_ID), (False, S.ERR_TOKEN_EXPIRED), (True, None), (True, None)]


def test_blank_user_fields_each_rule(spark):
    u = spark.createDataFrame([("", "e", "n", "h"), ("i", "", "n", "h"), ("i", "e", "", "h"), ("i", "e", "n", "")],
                              "id string, email string, username string, password_hash string")
    got = [r.error for r in I.validate(u, "user").collect()]
    assert got == [S.ERR_USER_ID_EMPTY, S.ERR_EMAIL_EMPTY, S.ERR_USERNAME_EMPTY, S.ERR_PWD_HASH_EMPTY]


def test_log_envelope_and_quarantine(spark):
    rec = spark.createDataFrame([(1, "error", "job", "boom", ""), (2, "info", "video", "ok", "src-2"),
                                 (3, "info", "job %s: open file", "m", "")],
                                "event_id long, level string, category string, message string, source_id string")
    env = {r.event_id: (r.channel, r.envelope) for r in LG.log_envelopes(rec).collect()}
    assert env[1] == ("logs:media-api:error", '{"category":"job","level":"error","message":"boom"}')
    assert env[2][1] == '{"category":"video","level":"info","message":"ok","source_id":"src-2"}'
    assert [r.event_id for r in LG.log_quarantine(rec).collect()] == [3]


def test_integrity(spark):
    jobs = spark.createDataFrame([("j1", "v1"), ("j2", "v9")], "id string, video_id string")
    videos = spark.createDataFrame([("v1",)], "id string")
    assert [r.id for r in I.orphans(jobs, videos, ["video_id"], ["id"]).collect()] == ["j2"]
    users = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b")], "id string, username string")
    d = I.duplicate_keys(users, "users", ["username"]).collect()
    assert [(r.key_value, r.n_rows) for r in d] == [("a", 2)]
    ur = spark.createDataFrame([("u1", "r"), ("u2", "r")], "user_id string, role_id string")
    gone = spark.createDataFrame([("u1",)], "id string")
    assert [r.user_id for r in I.cascade_delete(ur, gone, "user_id").collect()] == ["u2"]


def test_bounded_broadcast_falls_back(spark):
    from reelhouse.session import bounded_broadcast
    small = spark.range(10)
    big = spark.range(1000)
    j_small = spark.range(100).join(bounded_broadcast(small, max_rows=100), "id")
    j_big = spark.range(100).join(bounded_broadcast(big, max_rows=100), "id")
    assert "BroadcastExchange" in j_small._jdf.queryExecution().executedPlan().toString()
    assert j_small.count() == 10 and j_big.count() == 100
    # beyond the bound no broadcast hint is attached to the big side
    assert "broadcast" not in j_big._jdf.queryExecution().analyzed().toString().lower()


def test_format_text_marks_what_does_not_fit(spark):
    from reelhouse.functions.exprs import format_text
    cases = [("find video %s: %v", ["v1", "not found"], "find video v1: not found"), ("100%% of %d", ["7"], "100% of 7"),
             ("%s", [], "%!s(MISSING)"), ("%d", ["x"], "%!d(string=x)"), ("%z!", ["x"], "%!z(string=x)!"), ("end %", [], "end %!(NOVERB)"),
             ("plain", ["a", None], "plain%!(EXTRA string=a, <nil>)"), ("%v %s", [None, None], "<nil> %!s(<nil>)"), ("", [], ""),
             ("%s %s", ["a"], "a %!s(MISSING)"), ("%s\n%d", ["%s", "-3"], "%s\n-3"), ("x", None, "x"), (None, ["a"], None)]
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, t string, a array<string>")
    got = {r.i: r.m for r in df.select("i", format_text("t", "a").alias("m")).collect()}
    assert got == {i: m for i, (_, _, m) in enumerate(cases)}
