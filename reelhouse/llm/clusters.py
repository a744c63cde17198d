"""Clusters from candidate buckets, with DataFrame operations only.

``link_buckets`` finds the components that verified links make among the members of shared
buckets (inverted lists, bands), without emitting all pairs of a bucket. First each member
meets only its bucket's centres: the members that share most buckets, as a group's least
altered copies do. Verified links merge, and buckets whose members are all in one component
are done. What is left is compared in full, but only across components and under the cheap
condition (a sharper one, if the caller has it: its columns are joined for these members alone), so no link is lost, a large
group of near copies costs a few pairs per member, and of the pairs across components only those that nearly link are made.

``components`` is distributed union-find by alternating large-star and small-star steps: every
step is an aggregation and a join on node ids, the labels never leave Spark. What a step leaves is a
written table, and the table before it is deleted: a chain of steps holds two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Centres that a bucket's members meet first.
CENTRES = 4


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the table that it is written to: lineage ends there, and lost executors take nothing with them."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of ``edges`` (a, b): comp is the smallest id reachable."""
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), path)
    mark = None
    while True:
        # large star: a node's larger neighbours move to its smallest neighbour (or itself)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node's smaller neighbours and the node itself move to the smallest one
        least = e.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = e.join(least, e["hi"] == least["u"])
        e = moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        before, path = path, scratch_path(spark, "edges")
        e = written(e, path)
        forget(spark, before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("comp")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("comp")).union(roots)


def link_buckets(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], extras: tuple[str, ...] = (),
                 may_link: Callable[[str, str], Column] | None = None, late: DataFrame | None = None,
                 may_link_late: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(id, comp) of the entries that have a verified link.

    ``entries``: (bucket, id, *extras), and ``weight`` if it is known how many copies a member
    stands for: half of the centres are then the heaviest members. ``verify`` takes distinct pairs (a, b) and returns
    those that are linked. ``may_link(x, y)``: a cheap necessary condition on the extras, whose
    names are prefixed with ``x`` and ``y``; it is part of the joins that make the pairs. ``late``:
    (id, bands, ...) for the full comparison, where ``bands`` is the fixed number of buckets that each member may share, in one
    order (a pair is made in the first bucket that its members share, and only there), and other columns serve
    ``may_link_late``, a sharper necessary condition."""
    spark = entries.sparkSession
    ensure_checkpoint_dir(spark)
    may_link = may_link or (lambda x, y: F.lit(True))
    cols = ("id", *extras)
    paths = [scratch_path(spark, name) for name in ("bucket-members", "open-buckets")]
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    live = entries.join(shared, "bucket")
    degree = live.groupBy("id").agg(F.count("*").alias("degree"))
    live = written(live.join(degree, "id"), paths[0])

    def side(df, prefix):
        return df.select("bucket", *[F.col(c).alias(f"{prefix}{c}") for c in cols])

    def distinct_pairs(met):
        return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()

    weight = F.col("weight") if "weight" in entries.columns else F.col("degree")
    picks = [F.min(F.struct((-(weight if r % 2 else F.col("degree"))).alias("d"), F.xxhash64("id", F.lit(r)).alias("h"), *cols)).alias(f"c{r}") for r in range(CENTRES)]
    centres = live.groupBy("bucket").agg(*picks).select("bucket", F.explode(F.array(*[f"c{r}" for r in range(CENTRES)])).alias("c"))
    centres = centres.select("bucket", "c.*").select("bucket", *cols).distinct()
    x, y = side(live, "x_"), side(centres, "y_")
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x_id") != F.col("y_id")) & may_link("x_", "y_"))
    links = verify(distinct_pairs(met)).select("a", "b").checkpoint()
    comps = components(links)

    live = live.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    live = written(live.join(mixed, "bucket").select("bucket", "comp", *cols), paths[1])
    forget(spark, paths[0])
    cols, first = (*cols, "comp"), F.lit(True)
    if late is not None:
        live, cols = live.join(late, "id"), (*cols, *[c for c in late.columns if c != "id"])
    x, y = side(live, "x_"), side(live, "y_")
    if late is not None:
        first = F.get(F.array_compact(F.zip_with("x_bands", "y_bands", lambda a, b: F.when(a == b, a))), F.lit(0)) == x["bucket"]
    near = (may_link_late or may_link)("x_", "y_")
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x_comp") < F.col("y_comp")) & near & first)
    more = verify(distinct_pairs(met)).select("a", "b").checkpoint()
    forget(spark, paths[1])
    return comps if more.isEmpty() else components(links.union(more))
