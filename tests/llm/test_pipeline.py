"""The corpus pipeline: columns, order of the stages, and what each one decides."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from reelhouse.llm import ngram_join

from ..conftest import SF_SMALL


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("score", F.lit(1)).withColumn("_h", F.lit("x"))
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10_000).cast("long"))
    docs = docs.union(odd)
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        docs = out.checkpoint()
        n[name] = docs.count()
    # only rows of the input, fewer from stage to stage; the odd row has no letter, so it goes first
    assert 100 < n["benchmark decontamination"] <= n["n-gram Jaccard join"] <= n["line dedup"] <= n["language ID"] == 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == n["benchmark decontamination"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join",
                                                      "benchmark decontamination", "best-fit packing"]


def _near(x, y, shingle=5, percent=80):
    a, b = ({tuple(t[i:i + shingle]) for i in range(max(1, len(t) - shingle + 1))} for t in (x.split(), y.split()))
    return 100 * len(a & b) >= percent * len(a | b)


def _edited(words, n):
    words = list(words)
    for k in range(n):
        words[(2 * k + 1) * len(words) // (2 * n)] = f"edit{k}"
    return " ".join(words)


def test_near_copies_of_five_words_and_four_fifths(spark):
    """The documents that stay are those that all pairs leave."""
    rng, texts = np.random.default_rng(11), []
    for n, edits in [(100, 2), (200, 4), (400, 8), (100, 4), (60, 3)] + [(int(n), 1) for n in rng.integers(5, 60, 40)]:
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        texts += [" ".join(words), _edited(words, edits), " ".join([*words, "end"])]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and _near(texts[i], texts[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF_SMALL).collect()}
    assert kept == set(comp) and {1, 4, 7}.isdisjoint(kept) and 10 in kept


def test_light_sets_stay_small_at_any_percent():
    for percent in (50, 80, 90, 99, 100):
        n = ngram_join._largest(percent) * 100 // percent
        assert ngram_join._missing(n, percent) <= 2 and n <= 52
    assert ngram_join._largest(90) == 26 and ngram_join._largest(80) == 11


def test_one_document_of_each_copy_group_is_left(spark):
    rng = np.random.default_rng(12)
    texts = ["\n".join(" ".join(f"w{i}" for i in rng.integers(0, 5000, 15)) for _ in range(3)) for _ in range(4)]
    rows = [(10 * g + k, t, len(t)) for g, t in enumerate(texts) for k in range(5)] + [(100, None, 0), (101, "", 0), (102, " \n", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    left = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert left == {**{10 * g: (t, len(t)) for g, t in enumerate(texts)}, 100: (None, None), 101: ("", 0), 102: (" \n", 2)}


CLASHES = ("__doc", "__th", "__gone", "__left", "__rows", "__text", "_h", "c0", "hits")


def test_rows_without_or_with_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Decontamination judges each row by its text; no stage stumbles over columns' names."""
    rng = np.random.default_rng(13)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    item, clean, other = words(30), words(40), words(40)
    bad = f"{words(8)} {item} {words(8)}"
    rows = [(None, bad), (None, clean), (None, None), (1, clean + " x"), (1, bad), (2, ""), (3, other), (3, bad + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((repr(r.doc_id), repr(r.text)) for r in out.collect())
    assert got == sorted((repr(i), repr(t)) for i, t in rows if item not in (t or ""))
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_copies):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
