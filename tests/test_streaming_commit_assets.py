"""Streams vs their batch form, the two-table commit, and the asset tree."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from reelhouse import schemas as S
from reelhouse.operators import assets as A
from reelhouse.operators import progress as P
from reelhouse.plans.commit import commit_both, commit_job_batch, commit_upload_batch, committed
from reelhouse.sources.files import (asset_catalog, read_probe_docs, read_progress_text, write_assets, write_probe_docs,
                                     write_text_logs)
from reelhouse.streaming.progress_stream import run_progress_stream


def msg(cur, status):
    return '{"TotalFrames":100,"CurrentFrames":%d,"Status":"%s"}' % (cur, status)


def test_stream_state_survives_batches(spark, tmpdir_fresh):
    """A channel closed in one micro-batch drops later messages in the next one."""
    inp, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    first = [(1, "video:A:progress", msg(50, "continue")), (2, "video:A:progress", msg(100, "end")),
             (3, "video:B:progress", "{invalid-json}"), (4, "video:B:progress", msg(42, "continue"))]
    second = [(5, "video:A:progress", msg(100, "continue")), (6, "video:B:progress", msg(60, "error")),
              (7, "video:B:progress", msg(70, "continue"))]
    schema = "event_id long, channel string, payload string"
    spark.createDataFrame(first, schema).coalesce(1).write.json(f"{inp}/b1")
    run_progress_stream(spark, f"{inp}/*", f"{out}/d", f"{out}/q", f"{out}/ck")
    spark.createDataFrame(second, schema).coalesce(1).write.json(f"{inp}/b2")
    run_progress_stream(spark, f"{inp}/*", f"{out}/d", f"{out}/q", f"{out}/ck")
    got = sorted((r.job_id, r.event_id, r.status) for r in spark.read.parquet(f"{out}/d").collect())
    assert got == [("A", 1, "continue"), ("A", 2, "end"), ("B", 4, "continue"), ("B", 6, "error")]
    assert spark.read.parquet(f"{out}/q").count() == 1
    # and it equals the batch rule on the same rows (arrival order = event order here)
    batch = P.until_terminal(spark.createDataFrame(first + second, schema))
    assert sorted((r.job_id, r.event_id, r.status) for r in batch.collect()) == got


def _empty(spark):
    return spark.createDataFrame([], S.VIDEOS), spark.createDataFrame([], S.JOBS)


def test_two_table_commit_and_failure(spark, tmpdir_fresh):
    now = dt.datetime(2024, 1, 15)
    ups = spark.createDataFrame([("up-1", "T", "D", "a.mp4", "res-a"), ("up-2", "T", "D", "", "res-b")],
                                "upload_id string, title string, description string, filename string, resource_id string")
    one, two = f"{tmpdir_fresh}/one", f"{tmpdir_fresh}/two"
    assert committed(spark, one) is None
    commit_upload_batch(*_empty(spark), ups, now, one)
    videos, jobs = committed(spark, one)
    assert videos.schema == S.VIDEOS and jobs.schema == S.JOBS
    assert [r.id for r in videos.collect()] == ["vid-up-1"]
    assert [(r.id, r.status) for r in jobs.collect()] == [("job-up-1", "pending")]
    # a write that fails in one table commits neither; what was committed before stays
    broken = jobs.withColumn("result", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commit_both(videos, broken, two)
    assert committed(spark, two) is None and committed(spark, one)[0].count() == 1


def test_empty_tables_commit(spark, tmpdir_fresh):
    commit_both(*_empty(spark), f"{tmpdir_fresh}/none")
    assert [df.count() for df in committed(spark, f"{tmpdir_fresh}/none")] == [0, 0]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_asset_tree(spark, tmpdir_fresh):
    base = f"{tmpdir_fresh}/storage"
    _write(f"{base}/test-resource-123/videos/original.mp4", "x")
    _write(f"{base}/res-1/manifest.m3u8", "m")
    _write(f"{base}/res-1/seg1.ts", "s")
    _write(f"{base}/res-2/seg1.ts", "s")
    cat = {(r.resource_id, r.asset_path) for r in asset_catalog(spark, base).collect()}
    assert cat == {("test-resource-123", "videos/original.mp4"), ("res-1", "manifest.m3u8"),
                   ("res-1", "seg1.ts"), ("res-2", "seg1.ts")}
    videos = spark.createDataFrame([("res-1",), ("res-2",)], "resource_id string")
    orphans = [r.resource_id for r in A.orphan_asset_folders(asset_catalog(spark, base), videos).collect()]
    assert orphans == ["test-resource-123"]
    info = spark.createDataFrame([("v1", "res-1", "published", "manifest.m3u8"), ("v2", "res-2", "published", "manifest.m3u8")],
                                 "id string, resource_id string, status string, manifest_path string")
    assert [r.id for r in A.missing_manifests(info, asset_catalog(spark, base)).collect()] == ["v2"]


def test_asset_writer_and_text_sources(spark, tmpdir_fresh):
    files = spark.createDataFrame([("r1", "a/b.txt", "hello"), ("r 2", "c=+1.txt", "x"), ("r 2", "c=+1.txt", "yz")],
                                  "resource_id string, asset_path string, content string")
    write_assets(files, f"{tmpdir_fresh}/tree")
    got = {(r.resource_id, r.asset_path, r["size"]) for r in asset_catalog(spark, f"{tmpdir_fresh}/tree").collect()}
    assert got == {("r1", "a/b.txt", 6), ("r 2", "c=+1.txt", 5)}
    _write(f"{tmpdir_fresh}/logs/job-7.log", "frame=1\nframe=2\n")
    _write(f"{tmpdir_fresh}/probes/job-7.json", '{"format":{"duration":"1.5"},"streams":{"nb_read_frames":"2"}}')
    lines = read_progress_text(spark, f"{tmpdir_fresh}/logs")
    assert sorted((r.job_id, r.line_no, r.line) for r in lines.collect()) == [("job-7", 1, "frame=1"), ("job-7", 2, "frame=2")]
    stream = read_progress_text(spark, f"{tmpdir_fresh}/logs", streaming=True)
    q = stream.writeStream.format("memory").queryName("text_lines").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("text_lines").collect())) == [("job-7", "frame=1"), ("job-7", "frame=2")]
    probes = read_probe_docs(spark, f"{tmpdir_fresh}/probes")
    p = P.parse_probes(probes).collect()[0]
    assert (p.job_id, p.duration_ns, p.total_frames) == ("job-7", 1500000000, 2)


def test_text_order_over_splits_and_files(spark, tmpdir_fresh):
    """A hot job's text lies in several files, each read in several splits; order and numbers hold."""
    rows = [(i, "hot" if i % 3 else f"job a/{i % 5}", f"line {i} " + "x" * (i % 40)) for i in range(2000)] + [(2000, "one", "")]
    src = spark.createDataFrame(rows, "event_id long, job_id string, line string").repartition(7)
    write_text_logs(src, f"{tmpdir_fresh}/text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_progress_text(spark, f"{tmpdir_fresh}/text")
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, n = set(), {}
    for i, job, line in rows:
        n[job] = n.get(job, 0) + 1
        want.add((job, n[job], line))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_text_stream_end_carries_state(spark, tmpdir_fresh):
    """Frames in one micro-batch, the progress=end line in the next: the end event carries
    the last frames / percentage kept in state; lines after the end are ignored."""
    from reelhouse.streaming.progress_stream import run_events_stream
    inp, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    schema = "event_id long, job_id string, line string"
    totals = spark.createDataFrame([("j", 300)], "job_id string, total_frames long")
    spark.createDataFrame([(1, "j", "frame=100"), (2, "j", "frame=abc"), (3, "j", "  frame=200 ")],
                          schema).coalesce(1).write.json(f"{inp}/b1")
    run_events_stream(spark, f"{inp}/*", totals, f"{out}/e", f"{out}/ck")
    spark.createDataFrame([(4, "j", "progress=end"), (5, "j", "frame=300"), (6, "nototal", "frame=1")],
                          schema).coalesce(1).write.json(f"{inp}/b2")
    run_events_stream(spark, f"{inp}/*", totals, f"{out}/e", f"{out}/ck")
    got = [(r.seq, r.status, r.current_frames, r.percentage) for r in spark.read.parquet(f"{out}/e").orderBy("seq").collect()]
    assert got == [(1, "continue", 100, 33), (3, "continue", 200, 66), (4, "end", 200, 66)]


def test_job_lifecycle_commits_both_tables(spark, tmpdir_fresh):
    t0, t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    now = [spark.createDataFrame([(f"v{i}", "t", "d", 0, "f.mp4", f"res-{i}", "pending", t0, t0) for i in range(3)], S.VIDEOS),
           spark.createDataFrame([(f"j{i}", f"v{i}", "transcode", "pending", "", "", t0, t0) for i in range(3)], S.JOBS)]

    def batch(kind, rows, schema, at):
        folder = f"{tmpdir_fresh}/{kind}"
        out = commit_job_batch(*now, kind, spark.createDataFrame(rows, schema), at, folder).collect()
        now[:] = committed(spark, folder)
        videos, jobs = ({r.id: r for r in df.collect()} for df in now)
        assert len(videos) == len(jobs) == 3 and (videos["v2"].status, jobs["j2"].status) == ("pending", "pending")
        return out, videos["v1"], jobs["j1"]

    out, v, j = batch("start", [("j1", 1)], "job_id string, seq long", t1)
    assert out[0].accepted and (j.status, v.status) == ("running", "processing")
    out, v, j = batch("complete", [(1, "j1", "manifest.mpd", 120 * 10**9)], "seq long, job_id string, result string, duration long", t2)
    assert (j.status, j.result, j.updated_at) == ("completed", "manifest.mpd", t2)
    assert (v.status, v.duration, v.created_at) == ("published", 120 * 10**9, t0)
    # a batch of which nothing is accepted is committed too, and changes nothing
    out, v, j = batch("fail", [(1, "j1", "x")], "seq long, job_id string, error_msg string", t2)
    assert not out[0].accepted and j.status == "completed"


def test_stream_equals_batch_files_landed_one_by_one(spark, tmpdir_fresh):
    """progress_msgs at sf0.001 written as five event-ordered slices, one file per
    micro-batch (maxFilesPerTrigger=1): the stream delivers exactly the batch result."""
    from pyspark.sql import functions as F

    from reelhouse.sources.fixtures import Fixtures
    from .conftest import SF_SMALL
    msgs = Fixtures(spark, SF_SMALL).progress_msgs.select("event_id", "channel", "payload")
    bounds = msgs.agg(F.min("event_id"), F.max("event_id")).first()
    lo, hi = int(bounds[0]), int(bounds[1])
    step = (hi - lo) // 5 + 1
    inp, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    for i in range(5):
        part = msgs.filter((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step))
        part.coalesce(1).write.json(f"{inp}/slice={i}")
        os.utime(f"{inp}/slice={i}", None)
    paths = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(inp) for f in fs if f.endswith(".json"))
    flat = f"{tmpdir_fresh}/flat"
    os.makedirs(flat)
    for i, pth in enumerate(paths):  # land the files one at a time, in event order
        os.link(pth, f"{flat}/part-{i}.json")
        os.utime(f"{flat}/part-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    run_progress_stream(spark, flat, f"{out}/d", f"{out}/q", f"{out}/ck", max_files_per_trigger=1)
    got = sorted((r.channel, r.event_id) for r in spark.read.parquet(f"{out}/d").collect())
    batch = sorted((r.channel, r.event_id) for r in P.until_terminal(msgs).collect())
    assert got == batch and len(batch) == 410


def test_worker_output_files(spark, tmpdir_fresh):
    """manifest.m3u8 and seg1.ts saved under res-1: both catalogued; the job result is the
    manifest's base name."""
    from reelhouse.functions.exprs import basename, relative_to
    base = f"{tmpdir_fresh}/storage"
    _write(f"{base}/res-1/manifest.m3u8", "m")
    _write(f"{base}/res-1/seg1.ts", "s")
    assert sorted(r.asset_path for r in asset_catalog(spark, base).collect()) == ["manifest.m3u8", "seg1.ts"]
    out = spark.createDataFrame([("/tmp/out-123/manifest.m3u8",)], "manifest_path string")
    r = out.select(basename("manifest_path").alias("b"), relative_to("manifest_path", "/tmp/out-123").alias("rel")).first()
    assert (r.b, r.rel) == ("manifest.m3u8", "manifest.m3u8")
    assert out.select(relative_to("manifest_path", "/elsewhere")).first()[0] is None


def test_state_tables_survive_snapshots(spark, tmpdir_fresh):
    """A key closed in the first of 40 batches is still known after the snapshot batch, and a
    batch that runs again sees what it saw the first time."""
    from reelhouse.streaming.batch_state import SNAPSHOT_EVERY, BatchState
    from reelhouse.streaming.progress_stream import CLOSED
    st = BatchState(spark, f"{tmpdir_fresh}/state", CLOSED, "channel")
    for b in range(SNAPSHOT_EVERY + 3):
        st.write(b, spark.createDataFrame([(f"c{b}",)], CLOSED))
    got = sorted(r.channel for r in st.before(SNAPSHOT_EVERY + 3).collect())
    assert got == sorted(f"c{b}" for b in range(SNAPSHOT_EVERY + 3))
    assert sorted(r.channel for r in st.before(2).collect()) == ["c0", "c1"]


def test_text_stream_read_error(spark, tmpdir_fresh):
    """A failed read closes the job's text with an 'error' event that keeps the last frames."""
    from reelhouse.streaming.progress_stream import run_events_stream
    inp, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    totals = spark.createDataFrame([("j", 300)], "job_id string, total_frames long")
    spark.createDataFrame([(1, "j", "frame=150"), (2, "j", "progress=error"), (3, "j", "frame=300")],
                          "event_id long, job_id string, line string").coalesce(1).write.json(f"{inp}/b1")
    run_events_stream(spark, f"{inp}/*", totals, f"{out}/e", f"{out}/ck")
    got = [(r.seq, r.status, r.current_frames) for r in spark.read.parquet(f"{out}/e").orderBy("seq").collect()]
    assert got == [(1, "continue", 150), (2, "error", 150)]


def _files_below(path):
    return [f for _, _, fs in os.walk(path) for f in fs if f.startswith("part-")]


def test_many_assets_share_files(spark, tmpdir_fresh):
    """500 assets take a few files; loose files and folders beside the bundle are listed with it."""
    base = f"{tmpdir_fresh}/tree"
    rows = [(f"r/{i % 250}" if i % 7 else f"r{i % 250}", f"d {i // 250}/a+=%.bin", "é" * (i % 5)) for i in range(500)]
    write_assets(spark.createDataFrame(rows, "resource_id string, asset_path string, content string").repartition(3), base)
    write_assets(spark.createDataFrame([("r1", "d 0/a+=%.bin", None), (None, None, "x")], "resource_id string, asset_path string, content string"), base)
    assert len(_files_below(base)) <= 8
    _write(f"{base}/loose/seg1.m4s", "abc")
    _write(f"{base}/asset=r9%2Fone.txt/part-0.txt", "12\n")
    want = {}
    for r, p, c in [*rows, ("r1", "d 0/a+=%.bin", "")]:
        first, rest = f"{r}/{p}".split("/", 1)
        want[first, rest] = want.get((first, rest), 0) + len((c or "").encode()) + 1
    want |= {("", ""): 2, ("loose", "seg1.m4s"): 3, ("r9", "one.txt"): 3}
    got = asset_catalog(spark, base).collect()
    assert {(r.resource_id, r.asset_path): r["size"] for r in got} == want and len(got) == len(want)
    assert all(r.modified is not None for r in got)


def test_many_probe_documents_share_files(spark, tmpdir_fresh):
    """300 jobs' documents take a few files; a job with several has them as one text, a loose file is read too."""
    path = f"{tmpdir_fresh}/probes"
    rows = [(f"job {i}+/%", f'{{"n":"{i}\t+\r\n%"}}') for i in range(300)] + [("two", "a"), ("two", "a"), ("none", None), (None, "x\n"), ("", "x")]
    write_probe_docs(spark.createDataFrame(rows[:-1], "job_id string, doc string").repartition(3), path)
    assert len(_files_below(path)) <= 10
    _write(f"{path}/job-7.json", "{}\n")
    got = {r.job_id: r.doc for r in read_probe_docs(spark, path).collect()}
    want = dict(rows[:300]) | {"two": "a\na", "none": "", "__HIVE_DEFAULT_PARTITION__": "x", "job-7": "{}"}
    assert got == want


def test_many_texts_share_files(spark, tmpdir_fresh):
    """300 jobs' lines take a few files; keys and lines come back as they were, also beside loose files and as a stream."""
    path = f"{tmpdir_fresh}/text"
    rows = [(i, f"job\t{i % 300}%+/é", f"\tline {i}\t%41") for i in range(900)] + [(900, "odd", None), (901, "odd", "a\r\nb\rc\nd\r"), (902, None, "x")]
    write_text_logs(spark.createDataFrame(rows, "event_id long, job_id string, line string").repartition(5), path)
    assert len(_files_below(path)) <= 10
    _write(f"{path}/job-7.log", "one\ntwo\n")
    want = [(j, i // 300 + 1, ln) for i, j, ln in rows[:900]] + [("odd", n + 1, x) for n, x in enumerate(["", "a", "b", "c", "d"])]
    want += [("__HIVE_DEFAULT_PARTITION__", 1, "x"), ("job-7", 1, "one"), ("job-7", 2, "two")]
    assert sorted(map(tuple, read_progress_text(spark, path).collect())) == sorted(want)
    q = read_progress_text(spark, path, streaming=True).writeStream.format("memory").queryName("many_texts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("many_texts").collect())) == sorted((j, ln) for j, _, ln in want)
