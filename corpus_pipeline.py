"""The corpus pipeline: stages that each apply one training-data operator to what the stage
before kept. Each stage's result is written as Parquet and read again for the next.

All but the last stage return the columns of ``documents`` as they came; where a stage cuts
text, ``n_chars`` (if there) follows. Rows with null ids or texts pass unless a rule says
otherwise; extra columns pass, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.llm import bench_join, best_fit, fuzzy_lines, language_mix, ngram_join
from reelhouse.session import ensure_checkpoint_dir

#: A document goes if no language explains more than this share of it.
MAX_NOISE = 0.8
#: Near copies: words of a shingle, and the similarity of the sets.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which some learned language explains enough.

    Learned from all labelled documents of the input. Goes: text that is null, has no letter,
    or is noise for more than MAX_NOISE (nothing learned: nothing can be told, all go)."""
    langs, model = language_mix.learn(docs)
    names = [c for c in docs.columns]
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])  # names can't clash with the operator's
    text = f"_{names.index('text')}"
    judged = language_mix.predict(plain, langs, model, text=text, keep=tuple(plain.columns))
    kept = judged.filter((F.col("lang_pred") != language_mix.UNDETERMINED) & (F.col("noise") <= MAX_NOISE))
    return kept.select(*plain.columns).toDF(*names)


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text under names that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without lines that (nearly) repeat an earlier one. Goes: a document that had
    words and lost all of them, as each of its lines stands in an earlier one."""
    plain = _plain(docs)
    left = fuzzy_lines.drop_surplus_lines(plain, into="__left")
    lost = F.col("text").rlike(r"\S") & ~F.col("__left").rlike(r"\S")
    left = left.filter(~F.coalesce(lost, F.lit(False))).withColumn("text", F.col("__left"))
    left = left.select(*plain.columns).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (shingles of five words, similarity 0.8 or
    more): the one of the smallest id.

    Documents without words or without an id link with nothing and stay; rows that repeat the
    id and all columns of a kept document are copies of it and go."""
    plain = _plain(docs)
    comps = ngram_join.jaccard_components(plain, shingle=NEAR_WORDS, percent=NEAR_PERCENT)
    goes = comps.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    twice = comps.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__rows")).filter("__rows > 1")
    kept = plain.join(goes, "doc_id", "left_anti").select(*plain.columns)
    if not twice.isEmpty():
        kept = kept.join(twice, "doc_id", "left")
        once = kept.filter(F.col("__rows").isNull())
        kept = once.union(kept.filter(F.col("__rows").isNotNull()).dropDuplicates()).select(*plain.columns)
    return kept.toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a ``benchmark`` item occurs. Each row is judged by its own
    text, whatever its id: hits are kept under a 64-bit hash of the text, so rows without an id or of one
    id don't share them, and copies do. Null and empty texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    plain = _plain(docs).withColumn("__text", F.xxhash64("text"))
    found = bench_join.contained_windows(plain.select("__text", "text"), items, doc_id="__text")
    hit = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("__text")).distinct()
    return plain.join(hit, "__text", "left_anti").drop("__text").select(*_plain(docs).columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of at most 1024 tokens."""
    return best_fit.pack(best_fit.token_pieces(docs))


STAGES = [("language ID", language), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: Mixture inference, MinHash and packing have no SQL form; tests hold line dedup, near copies and
#: decontamination against brute force on small documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the ``documents`` of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for no, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{no}")
            docs = spark.read.parquet(f"{folder}/{no}")
    return docs
