"""Sharding by sampled splitters: shards of nearly equal bytes.

A record's key is the hash of its text, so equal texts (a group) lie side by side. A
size-weighted sample of the keys (a record is drawn with a chance in proportion to its size,
decided by a hash of its own, so a rerun draws the same) gives the splitters: quantiles that
cut the keys into ``FINE`` ranges per shard. The exact bytes of every range are then
aggregated. A range above the part ``OVERFULL`` of a shard is subdivided by the record's own
hash, as only that still divides a group of copies that fills a range; other ranges, and so
other groups, stay whole. Shards are runs of (sub)ranges cut where the exact running bytes pass
each shard's share.

The law that holds is ``bytes``. A shard misses its share by one (sub)range at most: usually
1 / ``FINE`` of a shard, never more than ``OVERFULL`` (or one record, if that is larger).

Slots number a shard's records without gaps: the rank inside a (sub)range plus the rows of the
ranges before it. Ranges are also subdivided to about ``SUB_BYTES``, so no task ranks more
than that, however much data there is.

What reaches the driver is the sample, ``SAMPLE`` keys on average whatever the input's size.

Defined cases: null text has size 1 and the checksum of nothing; empty text likewise; equal
rows are separate records; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SHARDS = 8
FINE, OVERFULL, SAMPLE, SUB_BYTES = 1024, 0.005, 65_536, 64 << 20


def shard_by_bytes(records: DataFrame, key: str, size: str, own: str, shards: int = SHARDS) -> DataFrame:
    """``records`` (a narrow frame: it is ranked and joined) with ``shard`` and ``slot``.

    ``key``: long that orders the records and is equal in a group; ``size``: long above 0;
    ``own``: long hash of the record itself, which subdivides overfull ranges."""
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    base = records.checkpoint()  # read four times below; the texts only once
    total = base.agg(F.sum(size)).first()[0] or 0
    rate = SAMPLE / total if total else 1.0
    chance = (F.pmod(F.xxhash64(own, F.lit(1)), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    drawn = base.filter(chance < F.col(size) * F.lit(rate)).select(
        F.col(key).alias("k"), F.greatest(F.lit(1.0), F.col(size) * F.lit(rate)).alias("w")).toPandas()
    keys, weight = drawn["k"].to_numpy(np.int64), drawn["w"].to_numpy()
    order = np.argsort(keys, kind="stable")
    at = np.cumsum(weight[order])
    n = shards * FINE
    cuts = np.unique(keys[order][np.searchsorted(at, at[-1] * np.arange(1, n) / n)]) if len(keys) else keys
    splitters = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters.value, k.to_numpy(np.int64), side="right").astype(np.int32))

    ranged = base.withColumn("_range", range_of(F.col(key)))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("b"))
    over = total / shards * OVERFULL
    fine = F.when(F.col("b") > over, F.ceil(F.col("b") / over * 2)).otherwise(F.lit(1))
    parts = sums.select("_range", F.greatest(fine, F.ceil(F.col("b") / SUB_BYTES)).cast("long").alias("_parts"))
    cut = ranged.join(F.broadcast(parts), "_range").withColumn("_sub", F.pmod(F.xxhash64(own), F.col("_parts"))).drop("_parts")

    # exact bytes and rows of each subrange, in key order; running sums pick the shards
    subs = cut.groupBy("_range", "_sub").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    by_range = subs.groupBy("_range").agg(F.sum("b").alias("rb"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select("_range", "rb", F.coalesce(F.sum("rb").over(upto), F.lit(0)).alias("rb0"))
    inside = Window.partitionBy("_range").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = subs.join(F.broadcast(by_range), "_range").select(
        "_range", "_sub", "n", F.when(F.col("rb") > over, F.col("rb0") + F.coalesce(F.sum("b").over(inside), F.lit(0)) + F.col("b") / 2)
        .otherwise(F.col("rb0") + F.col("rb") / 2).alias("mid"))  # a range that isn't overfull goes as a whole
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("mid") * shards / F.lit(float(max(total, 1))))).cast("int"))
    before = Window.partitionBy("shard").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("_range", "_sub", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    rank = Window.partitionBy("_range", "_sub").orderBy(own)
    return (cut.withColumn("_rank", F.row_number().over(rank) - 1).join(placed, ["_range", "_sub"])
            .withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long")).drop("_range", "_sub", "_first", "_rank"))


def op8_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rec = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      F.xxhash64(text).alias("_key"), F.xxhash64("doc_id", F.lit(7)).alias("_own"))
    out = shard_by_bytes(rec, "_key", "size", "_own")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sampled_shards": op8_sampled_shards}
ORACLES: dict[str, str] = {}
