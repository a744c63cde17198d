"""Keyed state of a ``foreachBatch`` sink, kept as a table of changes per micro-batch.

    <root>/batch=<id>/part-*.parquet   rows whose state the batch changed (one per key)

A batch reads what the batches before it left and overwrites its own folder, so a batch that
is run again after a failure finds and leaves the same rows. Every ``SNAPSHOT_EVERY``-th batch
writes the whole state, so a reader opens at most that many folders however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_EVERY = 32


class BatchState:
    """State rows of ``schema`` under ``root``, one per ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _folder(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """The state when batch ``batch_id`` begins: the latest row of each key."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        first = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
        rows = (self.spark.read.option("basePath", self.root)
                .schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())]))
                .parquet(*[self._folder(b) for b in range(first, batch_id)]))
        names = self.schema.fieldNames()
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("_s"))
        return latest.select(*[F.col(f"_s.{n}").alias(n) for n in names])

    def write(self, batch_id: int, changed: DataFrame) -> None:
        """Keep the rows that batch ``batch_id`` changed."""
        changed = changed.select(*self.schema.fieldNames())
        if batch_id and batch_id % SNAPSHOT_EVERY == 0:
            kept = self.before(batch_id).join(changed.select(self.key), self.key, "left_anti")
            changed = kept.select(*self.schema.fieldNames()).unionByName(changed)
        changed.write.mode("overwrite").parquet(self._folder(batch_id))
