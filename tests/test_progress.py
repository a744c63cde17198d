"""Progress text, probes, messages and delivery: the service's transcoder / streamer cases."""

from pyspark.sql import functions as F

from reelhouse.operators import progress as P


def _lines(spark, job, text):
    return spark.createDataFrame([(i, job, ln) for i, ln in enumerate(text.split("\n")) if ln != ""],
                                 "event_id long, job_id string, line string")


def _probes(spark, job, doc):
    return spark.createDataFrame([(job, doc)], "job_id string, doc string")


OBJ = '{"format":{"duration":"123.45"},"streams":{"nb_read_frames":"%s"}}'


def test_frames_then_end(spark):
    ev = P.progress_events(_lines(spark, "j", "frame=100\nframe=200\nframe=300\n"), _probes(spark, "j", OBJ % "300"))
    got = [(r.status, r.current_frames, r.percentage) for r in ev.orderBy("seq").collect()]
    assert got == [("continue", 100, 33), ("continue", 200, 66), ("continue", 300, 100), ("end", 300, 100)]
    assert ev.orderBy("seq").first().payload == \
        '{"TotalFrames":300,"CurrentFrames":100,"Status":"continue","Percentage":33}'
    assert ev.first().channel == "video:j:progress"


def test_read_error_ends_with_error(spark):
    failed = spark.createDataFrame([("j",)], "job_id string")
    ev = P.progress_events(_lines(spark, "j", "frame=100\n"), _probes(spark, "j", OBJ % "300"), failed_reads=failed)
    got = [(r.status, r.current_frames, r.percentage) for r in ev.orderBy("seq").collect()]
    assert got == [("continue", 100, 33), ("error", 100, 33)]


def test_bad_frame_is_skipped(spark):
    lines = _lines(spark, "j", "frame=abc\nframe=100\n  frame=7 \nframe= 12\nfps=25\n")
    parsed = {r.event_id: (r.outcome, r.frame) for r in P.parse_frame_lines(lines).collect()}
    assert parsed == {0: ("bad_frame", None), 1: ("frame", 100), 2: ("frame", 7), 3: ("bad_frame", None),
                      4: ("ignored", None)}
    ev = P.progress_events(_lines(spark, "j", "frame=abc\nframe=100\n"), _probes(spark, "j", OBJ % "100"))
    assert [(r.status, r.current_frames) for r in ev.orderBy("seq").collect()] == [("continue", 100), ("end", 100)]


def test_zero_total_gives_no_events(spark):
    ev = P.progress_events(_lines(spark, "j", "frame=1\n"), _probes(spark, "j", OBJ % "0"))
    assert ev.count() == 0


def test_probe_parse_shapes(spark):
    docs = spark.createDataFrame([
        ("a", '{"format":{"duration":"123.45"}, "streams":{"nb_read_frames":"2962"}}'),
        ("b", '{"format":{"duration":"10.25"},"streams":[{"nb_read_frames":"250"}]}'),
        ("c", '{"format":{"duration":"x"},"streams":{"nb_read_frames":"1"}}'),
        ("d", "{broken"),
    ], "job_id string, doc string")
    got = {r.job_id: (r.ok, r.duration_ns, r.total_frames, r.error) for r in P.parse_probes(docs).collect()}
    assert got["a"] == (True, 123450000000, 2962, None)
    assert got["b"] == (True, 10250000000, 250, None)
    assert not got["c"][0] and got["c"][3].startswith("parse duration")
    assert not got["d"][0] and got["d"][3] == "parse ffprobe output"


def test_percentage_no_lower_bound_and_cap(spark):
    from pyspark.sql import functions as F
    from reelhouse.functions.exprs import percentage
    df = spark.createDataFrame([(-7, 2), (500, 100), (9223372036854775807, 1)], "c long, t long")
    got = [r[0] for r in df.select(percentage("c", "t")).collect()]
    assert got == [-350, 100, None]  # truncation toward zero, cap 100, overflow -> NULL
    assert df.select(F.lit(1)).count() == 3


def _msgs(spark, rows):
    return spark.createDataFrame(rows, "event_id long, channel string, payload string")


def msg(cur, status, total=100):
    return '{"TotalFrames":%d,"CurrentFrames":%d,"Status":"%s"}' % (total, cur, status)


def test_bad_json_quarantined_and_stream_goes_on(spark):
    m = _msgs(spark, [(1, "video:A:progress", "{invalid-json}"), (2, "video:A:progress", msg(50, "continue"))])
    d = P.decode_messages(m)
    assert P.quarantine(d).count() == 1
    out = P.until_terminal(m).collect()
    assert [(r.current_frames, r.percentage, r.job_id) for r in out] == [(50, 0, "A")]


def test_until_terminal_and_isolation(spark):
    m = _msgs(spark, [(1, "video:A:progress", msg(50, "continue")), (2, "video:A:progress", msg(100, "end")),
                      (3, "video:A:progress", msg(100, "continue")), (4, "video:B:progress", msg(42, "continue"))])
    got = sorted((r.job_id, r.event_id) for r in P.until_terminal(m).collect())
    assert got == [("A", 1), ("A", 2), ("B", 4)]
    st = {r.job_id: r for r in P.progress_state(m).collect()}
    assert st["A"].status == "end" and st["A"].n_rejected == 1 and st["A"].last_event_id == 2
    assert st["B"].status == "continue" and st["B"].current_frames == 42


def test_progress_order_percentages(spark):
    ev = P.progress_events(_lines(spark, "j", "frame=25\nframe=50\nframe=75\nframe=100\n"),
                           _probes(spark, "j", OBJ % "100"))
    got = [r.percentage for r in ev.filter("status = 'continue'").orderBy("seq").collect()]
    assert got == [25, 50, 75, 100]
    # published payloads decode back to the same progress (S3 -> S2 round trip)
    msgs = ev.select(F.col("seq").alias("event_id"), "channel", "payload")
    back = [(r.current_frames, r.status) for r in P.until_terminal(msgs).orderBy("event_id").collect()]
    assert back == [(25, "continue"), (50, "continue"), (75, "continue"), (100, "continue"), (100, "end")]


def test_messages_are_one_json_object(spark):
    good = msg(5, "continue")
    rows = [(1, "video:A:progress", good + " junk"), (2, "video:A:progress", "null"), (3, "video:A:progress", good + "{}"),
            (4, "video:A:progress", "[" + good + "]"), (5, "video:A:progress", good + "],[{}"), (6, "video:A:progress", good),
            (7, "video:A:progress", None), (8, "video:A:progress", ""), (9, "video:A:progress", '{"Status":"a]"}')]
    bad = {r.event_id for r in P.decode_messages(_msgs(spark, rows)).filter("malformed").collect()}
    assert bad == {1, 3, 4, 5, 7, 8}


def test_failed_reads_close_with_error_where_they_failed(spark):
    lines = spark.createDataFrame([(1, "a", "frame=10"), (2, "a", "frame=20"), (3, "a", "frame=30"), (1, "b", "frame=5"), (9, "c", "frame=7")],
                                  "event_id long, job_id string, line string")
    doc = '{"format":{"duration":"1"},"streams":{"nb_read_frames":"100"}}'
    probes = spark.createDataFrame([(j, doc) for j in "abcd"], "job_id string, doc string")
    fails = spark.createDataFrame([("a", 3), ("a", 7), ("c", 4), ("d", 2), ("x", 1)], "job_id string, event_id long")
    got = sorted((r.job_id, r.seq, r.status, r.current_frames) for r in P.progress_events(lines, probes, failed_reads=fails).collect())
    assert got == [("a", 1, "continue", 10), ("a", 2, "continue", 20), ("a", 3, "error", 20), ("b", 1, "continue", 5), ("b", 2, "end", 5),
                   ("c", 4, "error", 0), ("d", 2, "error", 0)]


def test_probes_are_parsed_before_they_are_filtered(spark, monkeypatch):
    """The filter on a probe's outcome does not parse its document for every row that the probes were told from."""
    plans, kept = [], type(spark.range(1)).checkpoint

    def checkpoint(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, *args, **kw)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", checkpoint)
    rows = spark.createDataFrame([(i, f"j{i % 3}", f"frame={i}") for i in range(30)], "event_id long, job_id string, line string")
    probes = rows.select("job_id").distinct().select("job_id", F.concat(F.lit('{"format":{"duration":"1.5"},"streams":{"nb_read_frames":"'),
                                                                      F.substring("job_id", 2, 1), F.lit('0"}}')).alias("doc"))
    assert P.frame_percentages(P.parse_frame_lines(rows), P.parse_probes(probes)).count() == 20
    assert P.progress_events(rows, probes).count() == 22
    assert P.progress_rejections(probes).count() == 1
    filters = [x for plan in plans for x in plan.split("\n") if "Filter" in x]
    assert plans and not [x for x in filters if "get_json_object" in x]


def test_last_frame_without_percentage_is_not_kept(spark):
    """An overflowing frame has no event and is not the last one, as is a line that is no frame."""
    ev = P.progress_events(_lines(spark, "j", "frame=150\nframe=9223372036854775807\nfps=1\n"), _probes(spark, "j", OBJ % "300"))
    assert sorted((r.seq, r.status, r.current_frames, r.percentage) for r in ev.collect()) == [(0, "continue", 150, 50), (3, "end", 150, 50)]
