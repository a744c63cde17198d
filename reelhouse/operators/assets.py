"""Asset-tree checks against the catalog: upload leftovers (X20) and published videos whose
manifest file is missing (X21). Both are anti-joins over the S7 listing; the listing is
distributed by the binaryFile source and file contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_asset_folders(assets: DataFrame, videos: DataFrame) -> DataFrame:
    """Resource folders with files but no catalog row (to be removed; reported only)."""
    folders = assets.groupBy("resource_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    return folders.join(videos.select("resource_id").distinct(), "resource_id", "left_anti")


def missing_manifests(info: DataFrame, assets: DataFrame) -> DataFrame:
    """Published videos whose latest job names a manifest that the asset tree lacks."""
    pub = info.filter((F.col("status") == "published") & (F.coalesce(F.col("manifest_path"), F.lit("")) != ""))
    have = assets.select("resource_id", F.col("asset_path").alias("manifest_path"))
    return pub.select("id", "resource_id", "manifest_path").join(have, ["resource_id", "manifest_path"], "left_anti")
