"""Session construction and a few plan-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "reelhouse", driver_memory: str | None = None) -> SparkSession:
    """A session tuned for the operators in this package.

    On a cluster, leave ``master`` unset and let spark-submit decide; the settings
    below only switch on runtime re-planning (AQE: partition coalescing, skew-join
    splitting) and pin the session zone to UTC, which every timestamp rule assumes.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if driver_memory:  # only effective before the JVM starts (local mode: the only heap)
        b = b.config("spark.driver.memory", driver_memory)
    cores = os.cpu_count() or 8
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * cores))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          # no Python call-site capture on every Column call: driver-side only, saves a
          # session lookup per DataFrame / Column operation while building plans
          .config("spark.python.sql.dataFrameDebugging.enabled",
                  os.environ.get("REELHOUSE_DATAFRAME_DEBUGGING", "false")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when nothing is configured *and* Spark runs in local mode (tests) do we pick a
    private temporary folder; on a cluster a machine-local folder would be wrong, so we
    refuse instead.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="reelhouse-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (for written tables, stream
    checkpoints and generated files). Never machine-local on a cluster."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/reelhouse/{name}-{uuid.uuid4().hex[:12]}"


#: Largest side that is broadcast.
BROADCAST_BYTES = 64 << 20


def measured_side(df: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """``df`` computed once, in parallel, into a reliable checkpoint, and whether it may be
    broadcast: at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes (its columns as text),
    counted on the checkpoint by an aggregate.

    Whatever the answer, the join reads the checkpoint, so nothing is computed twice. A static
    estimate is not trusted here because a small dimension derived from a large table (e.g.
    DISTINCT roles of all orders) is estimated at the large table's size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns])))
    n, held = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return kept, n <= max_rows and held <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The ``measured_side``, hinted for broadcast if it may be; else unhinted, and the planner
    shuffles (AQE may still broadcast at runtime from measured sizes)."""
    kept, small = measured_side(df, max_rows)
    return F.broadcast(kept) if small else kept


def checkpoint_cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared checkpoint folder and cut
    its lineage (used for the static side of stream-static joins, which would otherwise be
    recomputed in every micro-batch). Reliable, not local, so a lost executor does not lose
    the materialised data."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
