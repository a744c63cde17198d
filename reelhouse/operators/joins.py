"""Joining a batch of requests to a large catalog table.

``requests LEFT JOIN table`` normally shuffles both sides on the key. When the request batch
is proven small (bounded count), the table only needs to be scanned:

    matched   = table JOIN broadcast(requests)            -- scan, no shuffle of the table
    unmatched = requests LEFT ANTI broadcast(matched keys) -- at most |requests| keys

and their union is the left join. Beyond the bound the plain shuffled left join is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, measured_side

REQUEST_LIMIT = 200_000


def request_left_join(requests: DataFrame, table: DataFrame, on: list[str] | str,
                      max_rows: int = REQUEST_LIMIT) -> DataFrame:
    """``requests.join(table, on, "left")`` without shuffling ``table`` for small batches.
    Output columns: the join keys, then the requests' columns, then the table's columns."""
    keys = [on] if isinstance(on, str) else list(on)
    rb, small = measured_side(requests, max_rows)
    if not small:
        return rb.join(table, keys, "left")
    rb = F.broadcast(rb)
    matched = table.join(rb, keys, "inner")
    hit = F.broadcast(matched.select(*keys).distinct())  # at most the batch's distinct keys
    missing = rb.join(hit, keys, "left_anti")
    return matched.select(*keys, *[c for c in requests.columns if c not in keys],
                          *[c for c in table.columns if c not in keys]) \
        .unionByName(missing, allowMissingColumns=True)


def with_exists_flag(requests: DataFrame, table: DataFrame, keys: list[str] | str, flag: str,
                     max_rows: int = REQUEST_LIMIT) -> DataFrame:
    """``requests`` plus ``flag`` = true when ``table`` holds the key (NULL otherwise), as a
    left join would give. A small batch's keys are broadcast and the table is only scanned
    (semi join); otherwise the table's distinct keys are shuffled once."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    req_keys = requests.select(*keys).distinct()
    rk, small = measured_side(req_keys, max_rows)
    if small:
        hit = F.broadcast(table.select(*keys).join(F.broadcast(rk), keys, "left_semi").distinct()
                          .withColumn(flag, F.lit(True)))  # at most the batch's distinct keys
    else:
        hit = table.select(*keys).distinct().withColumn(flag, F.lit(True))
    return requests.join(hit, keys, "left")


SUMMARY_LIMIT = 200_000  # ~10 MB of (key, value) rows: the size Spark broadcasts by default


def join_back(rows: DataFrame, summary: DataFrame, keys: list[str] | str, how: str = "left",
              max_rows: int = SUMMARY_LIMIT) -> DataFrame:
    """Attach a per-key summary (one row per key, e.g. a channel's first terminal position)
    to the rows it was computed from. A summary proven small is broadcast, so the rows are
    not shuffled; otherwise both sides are shuffled on the key (AQE splits a hot key's
    partition)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return rows.join(bounded_broadcast(summary, max_rows), keys, how)
