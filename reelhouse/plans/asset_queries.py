"""Asset-tree queries over files that Spark writes from the catalog tables:
asset_orphans (S7, X20), missing_manifests (S7, X21, J3), ordered_text and file_frames (S4, P1),
probe_files (S5, P8), export_json, export_list_json, export_upload_json (S8).

Tree written per run (one fresh folder under the shared checkpoint directory):
  seg1.m4s and the manifest  for published videos with a manifest, except that the manifest is left
                             out when md5(id) starts with '0' (the missing ones);
  original.mp4               for every upload (none became a video).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import lookup as L
from ..operators import machine as M
from ..operators import progress as P
from ..session import scratch_path
from ..sources.files import (asset_catalog, read_json_lines, read_probe_docs, read_progress_text, upload_json, video_info_json,
                             video_list_json, write_assets, write_json_lines, write_probe_docs, write_text_logs)
from ..sources.fixtures import Fixtures
from .machine_queries import NOW
from .progress_queries import _FRAMES_CTE
from .registry import register


def _build_tree(spark, sf_dir) -> tuple[str, object, object]:
    fx = Fixtures(spark, sf_dir)
    info = L.video_info(fx.videos, fx.jobs)
    pub = info.filter((F.col("status") == "published") & (F.col("manifest_path") != ""))
    segs = pub.select("resource_id", F.lit("seg1.m4s").alias("asset_path"), F.lit("segment").alias("content"))
    mans = (pub.filter(F.substring(F.md5("id"), 1, 1) != "0")
               .select("resource_id", F.col("manifest_path").alias("asset_path"), F.lit("manifest").alias("content")))
    ups = (fx.uploads.filter(F.col("resource_id") != "")
              .select("resource_id", F.lit("original.mp4").alias("asset_path"), F.lit("dat").alias("content")))
    base = scratch_path(spark, "assets")  # a file ends with a line end: an original has 4 bytes
    write_assets(segs.unionByName(mans).unionByName(ups), base)
    return base, info, fx


@register("asset_orphans", ["uploads", "videos"], """
SELECT resource_id, CAST(1 AS BIGINT) AS n_files, CAST(4 AS BIGINT) AS bytes FROM uploads u
WHERE resource_id <> ''
  AND NOT EXISTS (SELECT 1 FROM videos v WHERE v.resource_id = u.resource_id)
""")
def asset_orphans(spark, sf_dir):
    base, info, fx = _build_tree(spark, sf_dir)
    return A.orphan_asset_folders(asset_catalog(spark, base), fx.videos)


@register("missing_manifests", ["videos", "jobs"], """
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn
                            FROM jobs) t WHERE rn = 1)
SELECT v.id, v.resource_id, l.result AS manifest_path FROM videos v JOIN latest l ON l.video_id = v.id
WHERE v.status = 'published' AND l.result <> '' AND substring(md5(v.id), 1, 1) = '0'
""")
def missing_manifests(spark, sf_dir):
    base, info, fx = _build_tree(spark, sf_dir)
    return A.missing_manifests(info, asset_catalog(spark, base))


@register("export_json", ["videos", "jobs"], """
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn
                            FROM jobs) t WHERE rn = 1)
SELECT '{"id":' || to_json(v.id) || ',"title":' || to_json(v.title) || ',"description":' || to_json(v.description)
  || ',"source_filename":' || to_json(v.filename) || ',"resource_id":' || to_json(v.resource_id)
  || ',"status":' || to_json(v.status) || ',"duration_seconds":' || to_json(CAST(v.duration AS DOUBLE) / 1e9)
  || CASE WHEN l.result <> '' THEN ',"manifest_path":' || to_json(l.result) ELSE '' END
  || CASE WHEN l.error_msg <> '' THEN ',"error_message":' || to_json(l.error_msg) ELSE '' END
  || ',"created_at":' || to_json(strftime(v.created_at, '%Y-%m-%dT%H:%M:%S.%fZ'))
  || ',"updated_at":' || to_json(strftime(v.updated_at, '%Y-%m-%dT%H:%M:%S.%fZ')) || '}' AS value
FROM videos v JOIN latest l ON l.video_id = v.id
""")
def export_json(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return _through_files(spark, video_info_json(L.video_info(fx.videos, fx.jobs)))


def _through_files(spark, df):
    path = scratch_path(spark, "json")
    write_json_lines(df, path)
    return read_json_lines(spark, path)


@register("export_list_json", ["videos"], """
SELECT '{"ID":' || to_json(id) || coalesce(',"Title":' || to_json(title), '') || coalesce(',"Description":' || to_json(description), '')
  || coalesce(',"Duration":' || CAST(duration AS VARCHAR), '') || coalesce(',"Filename":' || to_json(filename), '')
  || coalesce(',"ResourceID":' || to_json(resource_id), '') || ',"Status":' || to_json(status)
  || ',"CreatedAt":' || to_json(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ'))
  || ',"UpdatedAt":' || to_json(strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%fZ')) || '}' AS value
FROM videos WHERE status = 'published'
""")
def export_list_json(spark, sf_dir):
    return _through_files(spark, video_list_json(L.published(Fixtures(spark, sf_dir).videos)))


@register("export_upload_json", ["uploads"], """
SELECT '{"video_id":"vid-' || upload_id || '","job_id":"job-' || upload_id || '","status":"pending","resource_id":' || to_json(resource_id) || '}' AS value
FROM uploads WHERE coalesce(upload_id, '') <> '' AND coalesce(filename, '') <> '' AND coalesce(resource_id, '') <> ''
""")
def export_upload_json(spark, sf_dir):
    return _through_files(spark, upload_json(M.upload_batch(Fixtures(spark, sf_dir).uploads, NOW)))


def _text_files(spark, sf_dir):
    path = scratch_path(spark, "text")
    write_text_logs(Fixtures(spark, sf_dir).progress_lines, path)
    return read_progress_text(spark, path)


@register("ordered_text", ["progress_lines"], """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS line_no, line FROM progress_lines
""")
def ordered_text(spark, sf_dir):
    return _text_files(spark, sf_dir)


@register("file_frames", ["progress_lines"], _FRAMES_CTE + """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS line_no, outcome, frame FROM fl
""")
def file_frames(spark, sf_dir):
    return P.parse_frame_lines(_text_files(spark, sf_dir))


@register("probe_files", same_as="probe_parse")
def probe_files(spark, sf_dir):
    path = scratch_path(spark, "probes")
    write_probe_docs(Fixtures(spark, sf_dir).probes, path)
    return P.parse_probes(read_probe_docs(spark, path))
