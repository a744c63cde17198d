"""Ordered fold of an associative operation per key, without ever gathering a key's whole
history in one task.

The commands of one entity must be applied in sequence order, but composing state
transitions is associative. So the fold runs as a tree with bounded fan-in:

    level 1: group by (key, pos div B)      -> fold <= B consecutive elements
    level 2: group by (key, pos div B^2)    -> fold <= B partial results
    ...
    last:    group by key                   -> fold <= B partial results

where pos = seq - min(seq). Every group holds at most B elements (B = ``branching``), so a
key owning a third of all rows is spread over many tasks at the lower levels, and order is
kept because each group covers a contiguous range of sequence numbers and is sorted by
its smallest position before folding. The number of levels is ceil(log_B(span)); the span
is one tiny global aggregate. The fold itself is Catalyst's ``aggregate`` higher-order
function over the sorted group (no UDF).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ComposeSQL = Callable[[str, str], str]


def _fold_sorted_sql(items: str, identity: str, compose: ComposeSQL) -> str:
    """Sort one group's (pos, value) items by pos and fold them with ``compose``."""
    ordered = (f"array_sort({items}, (l, r) -> CASE WHEN l._pos < r._pos THEN -1 "
               f"WHEN l._pos > r._pos THEN 1 ELSE 0 END)")
    return f"aggregate({ordered}, {identity}, (acc, x) -> {compose('acc', 'x._v')})"


def ordered_fold(df: DataFrame, key: list[str], seq: str, value: str, compose: ComposeSQL,
                 identity: str, branching: int = 1024) -> DataFrame:
    """Fold ``value`` per ``key`` in ``seq`` order with the associative ``compose`` (a function
    building the SQL expression of "a then b" from two SQL expressions; ``identity`` is the SQL
    of its neutral element). Returns (key..., value, n) with n the number of folded elements."""
    if branching < 2:
        raise ValueError("branching must be >= 2")
    bounds = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return df.select(*key, F.col(value), F.lit(0).cast("long").alias("n")).limit(0)
    lo, span = int(bounds["lo"]), int(bounds["hi"]) - int(bounds["lo"])
    fold_items = F.expr(_fold_sorted_sql("_items", identity, compose))
    cur = df.select(*key, (F.col(seq) - F.lit(lo)).cast("long").alias("_pos"), F.col(value).alias("_v"),
                    F.lit(1).cast("long").alias("_n"))
    width = 1
    while width * branching <= span:
        width *= branching
        cur = (cur.groupBy(*key, F.floor(F.col("_pos") / F.lit(width)).alias("_bucket"))
                  .agg(F.min("_pos").alias("_pos"), F.sum("_n").alias("_n"),
                       F.collect_list(F.struct("_pos", "_v")).alias("_items"))
                  .select(*key, "_pos", "_n", fold_items.alias("_v")))
    return (cur.groupBy(*key)
               .agg(F.sum("_n").alias("n"), F.collect_list(F.struct("_pos", "_v")).alias("_items"))
               .select(*key, fold_items.alias(value), "n"))
