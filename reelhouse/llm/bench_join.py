"""Benchmark decontamination as a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (the whole item if it is shorter). A
window lies in a document only if all its shingles do, so its rarest shingle is a sufficient
prefix. Shingles (``SHINGLE`` consecutive words, fewer in shorter windows) are ordered by how
often the documents hold them, and each window is indexed under its rarest one only. The
join brings the document positions of those shingles to the windows; the length bound and the
positional bound (the shingle's place in the window must leave room for the words before and
after it within the document) drop pairs, and the words themselves are compared.

The documents are read twice (counts, then candidates) and never shuffled: a task looks its
shingles up in a bit table of fixed size made from the items, so only positions that can
matter leave it. The table's size doesn't depend on how many items or documents there are; its
false hits end in the join. A passage that sits in a third of all documents yields one
candidate per occurrence of a prefix shingle.

Defined cases: null or empty texts have no words; an item without words has no window; equal
items are separate items; repeated documents of one id are judged together; empty tables give
no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .words import WORDISH, Words, pieces, split_words, utf8, windows_hash, within

WINDOW, SHINGLE = 10, 3
#: Entries of the table of item shingles (one byte each where a task holds it).
TABLE_BITS = 1 << 23


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the shingles that lie in one document."""
    at = within(w.doc, size)
    return at, windows_hash(w.h[0], size)[at]


def _item_windows(window: int, shingle: int):
    """Windows of items: (item_id, words, offset and hash of each shingle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            rows = []
            for x, y in pieces(texts):
                w = split_words(texts[x:y], WORDISH, lower=True, hashes=1)
                for d in range(y - x):
                    a, e = w.first[d], w.first[d + 1]
                    n = min(window, e - a)
                    if n:
                        size = min(shingle, n)
                        h = windows_hash(w.h[0][a:e], size).view(np.int64)
                        words = [w.word(i).decode() for i in range(a, e)]
                        rows += [(ids[x + d], words[i:i + n], size, h[i:i + n - size + 1].tolist()) for i in range(e - a - n + 1)]
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "words", "size", "hashes"])
    return run


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in column ``h`` as an array of TABLE_BITS / 64 words."""
    bit = F.pmod("h", F.lit(TABLE_BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {TABLE_BITS}) & 63 as int)))").alias("bits")).toPandas()
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h & np.uint64(TABLE_BITS - 1)).astype(np.int64)]


def _counter(sizes: list[int], sent):
    """How often a task's documents hold each item shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = utf8(b.column(0)), []
            for x, y in pieces(texts):
                w = split_words(texts[x:y], WORDISH, lower=True, hashes=1)
                for size in sizes:
                    _, h = _shingles(w, size)
                    found.append(h[_in_table(sent.value, h)])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
    return run


def _candidates(sizes: list[int], reach: int, sent):
    """Per document: its word count, and where prefix shingles may lie, with the words around."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for x, y in pieces(texts):
                w = split_words(texts[x:y], WORDISH, lower=True, hashes=1)
                count = np.diff(w.first)
                rows = [(ids[x + d], int(count[d]), None, None, None, None) for d in range(y - x)]
                for size in sizes:
                    at, h = _shingles(w, size)
                    hit = np.flatnonzero(_in_table(sent.value, h))
                    for i, v in zip(at[hit].tolist(), h[hit].view(np.int64).tolist()):
                        d = w.doc[i]
                        a, e = max(w.first[d], i - reach), min(w.first[d + 1], i + reach)
                        around = [w.word(j).decode() for j in range(a, e)]
                        rows.append((ids[x + d], None, v, int(i - w.first[d]), int(i - a), around))
                cols = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["doc_id", "n_words", "h", "pos", "lead", "around"])
    return run


def prefix_windows(docs: DataFrame, items: DataFrame, text: str, item_text: str,
                   window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """Windows of the items under their rarest shingle (item_id, words, h, offset), and the
    shingle sizes in use."""
    sc = docs.sparkSession.sparkContext
    ensure_checkpoint_dir(docs.sparkSession)
    wins = (items.select(F.col("item_id").cast("string"), item_text)
            .mapInArrow(_item_windows(window, shingle), "item_id string, words array<string>, size int, hashes array<long>").checkpoint())
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # at most ``shingle`` values
    each = wins.select("item_id", "words", F.posexplode("hashes").alias("offset", "h"))
    table = _bit_table(each.select("h").distinct())
    counts = docs.select(text).mapInArrow(_counter(sizes, sc.broadcast(table)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    known = each.select("h").distinct().join(counts, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = Window.partitionBy("item_id", "words").orderBy("n", "h", "offset")
    # a window whose rarest shingle no document holds can't lie in any
    return (each.distinct().join(known, "h").withColumn("r", F.row_number().over(rarest)).filter("r = 1 AND n > 0")
            .select("item_id", "words", "h", "offset").checkpoint(), sizes)


def contained_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, and ``hits``: the occurrences of item windows
    (start word, end word exclusive, item_id), empty if none."""
    wins, sizes = prefix_windows(docs, items, text, item_text, window, shingle)
    sc = docs.sparkSession.sparkContext
    seen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        _candidates(sizes, window, sc.broadcast(_bit_table(wins.select("h").distinct()))),
        "doc_id long, n_words long, h long, pos long, lead int, around array<string>")
    seen = seen.checkpoint()  # word counts and candidates come from one reading
    n = F.size("words")
    first = F.col("lead") - F.col("offset")   # of the window, among the words around
    met = (seen.filter("h IS NOT NULL").join(wins, "h")
           .filter((first >= 0) & (first + n <= F.size("around")))
           .filter(F.slice("around", first + 1, n) == F.col("words")))
    start = F.col("pos") - F.col("offset")
    hits = met.select("doc_id", F.struct(start.alias("start"), (start + n).alias("end"), "item_id").alias("hit"))
    hits = hits.groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))
    words = seen.filter("h IS NULL").select("doc_id", "n_words")
    none = F.array().cast("array<struct<start:bigint,end:bigint,item_id:string>>")
    return words.join(hits, words["doc_id"].eqNullSafe(hits["doc_id"]), "left").select(
        words["doc_id"], "n_words", F.coalesce("hits", none).alias("hits"))


def hit_words(hits: Column) -> Column:
    """How many words the spans cover together."""
    covered = F.aggregate(F.array_sort(hits), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
                          lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
                                                F.greatest(a["upto"], s["end"]).alias("upto")))
    return covered["n"]


def op3_bench_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie in windows of ``benchmark`` items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contained_windows(docs, items)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda s: s["item_id"])))
    return found.select("doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(lower_ascii({}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS.replace('lower_ascii({})', _LOWER.format('text'))} AS w FROM documents),
  i AS (SELECT item_id, {_WORDS.replace('lower_ascii({})', _LOWER.format('text'))} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, array_to_string(w[a:a + n - 1], ' ') AS t, n FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM i) WHERE n > 0)),
  sizes AS (SELECT DISTINCT n FROM iw),
  dw AS (SELECT doc_id, a, n, array_to_string(w[a:a + n - 1], ' ') AS t FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, sizes WHERE len(w) >= n)),
  hit AS (SELECT doc_id, a, n, item_id FROM dw JOIN iw USING (n, t)),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM hit) GROUP BY 1),
  names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)"""

QUERIES = {"op3_bench_join": op3_bench_join}
ORACLES = {"op3_bench_join": _ORACLE}
