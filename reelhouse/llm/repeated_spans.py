"""Repeated token spans by a compacted de Bruijn graph.

Edges are windows of ``WINDOW`` consecutive words (k-mers of tokens), nodes the overlaps between
them. Consecutive edges of a document that share the same minimiser (the least hash among the
window's ``SEED``-word seeds) form a segment: a path that is walked as one. Equal segments have
equal edges throughout, so:

1. Segments are dealt by minimiser. A seed that occurs once proves all edges around it
   unrepeated. Where a seed's occurrences all continue alike (one segment, a nonbranching path), the
   path is compacted: its first source coordinate (document, word) stands, every other
   occurrence is repeated as a whole.
2. Where a seed's paths branch (several segments), one source of each distinct segment is
   expanded to its edges, joined back to its text by source coordinates; equal edges meet by
   hash, and all but the first source of an edge are repeated. Other occurrences of a segment
   need no expansion: they repeat the segment's first source throughout.
3. Repeated edges of a document merge into spans, joined to the text that is to lose them.

Keys are 128 bits of independent hashes (minimiser and segment, or two of an edge), so equal
keys mean equal words. A task keeps one row per distinct segment of a batch and settles the
rest itself, so a passage that sits in a third of all documents reaches the shuffle as a few rows per task.

Defined cases: null texts have no words; texts shorter than a window keep everything; rows of
one id (or none: they count as before all others) are one document, judged together, and the
windows of such copies at one place don't precede each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .words import NOT_SPACE, Words, mix64, pieces, split_words, utf8, windows_hash

WINDOW, SEED = 20, 8
_NO_ID = np.iinfo(np.int64).min


def _least_seed(seeds: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least seed among each ``span`` consecutive ones."""
    at, size = np.arange(len(seeds)), 1
    while size < span:
        step = min(size, span - size)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(seeds[right] < seeds[left], right, left)
        size += step
    return at


def _edges(w: Words, window: int, seed: int):
    """(first word, minimiser position) of every window that lies in one document."""
    k = len(w.doc) - window + 1
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), None
    seeds = windows_hash(w.h[0], seed)
    least = _least_seed(seeds, window - seed + 1)[:k]
    at = np.flatnonzero(w.doc[:k] == w.doc[window - 1:])
    return at, least[at], seeds


def _segments(w: Words, window: int, seed: int):
    """Segments of a run of documents: first window, number of windows, minimiser, hash."""
    at, least, seeds = _edges(w, window, seed)
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, e.view(np.uint64), e.view(np.uint64)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(at))
    whole = windows_hash(w.h[1], window)
    a, z = at[first], at[first + count - 1]
    path = mix64(whole[a] * np.uint64(0x9E3779B97F4A7C15) + (whole[z] ^ np.uint64(0x94D049BB133111EB)) * np.uint64(3) + count.astype(np.uint64))
    return a, count, seeds[least[first]], path


def _leaders(*keys: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """(order by key, document, word; where groups of equal keys begin in it)."""
    order = np.lexsort((pos, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


_ROW = "kind int, m long, path long, doc long, pos long, n long"
_NAMES = ["kind", "m", "path", "doc", "pos", "n"]
#: Row kinds: a segment to compare, a span of repeated windows, a segment to expand.
COMPARE, REPEATED, EXPAND = 0, 1, 2


def _batch(kind, m, path, doc, pos, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(kind, np.int32)), pa.array(np.asarray(m).view(np.int64)), pa.array(np.asarray(path).view(np.int64)),
         pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(pos, np.int64)), pa.array(np.asarray(n, np.int64))], names=_NAMES)


def _ids(column) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _emit_segments(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, parts = _ids(b.column(0)), utf8(b.column(1)), []
            for x, y in pieces(texts):
                w = split_words(texts[x:y], NOT_SPACE)
                a, n, m, path = _segments(w, window, seed)
                parts.append((m, path, ids[x + w.doc[a]], a - w.first[w.doc[a]], n))
            if not parts:
                continue
            m, path, doc, pos, n = map(np.concatenate, zip(*parts))
            # equal segments of the batch: the first goes on, the others are repeated
            order, first = _leaders(m, path, doc=doc, pos=pos)
            lead = np.repeat(order[first], np.diff(first, append=len(order)))
            later = (doc[order] != doc[lead]) | (pos[order] != pos[lead])
            later[first] = False
            kind = np.zeros(len(order), np.int32)
            kind[order[later]] = REPEATED
            same = np.zeros(len(order), bool)  # copies of one id at one place: the leader stands for them
            same[order] = ~later
            same[order[first]] = False
            keep = ~same
            yield _batch(kind[keep], m[keep], path[keep], doc[keep], pos[keep], n[keep])
    return run


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of some minimisers: what is repeated as a whole, what needs its edges."""
    cols = [np.concatenate([b.column(i).to_numpy() for b in bs]) for bs in [list(batches)] if bs for i in range(1, 6)]
    if not cols:
        return
    m, path, doc, pos, n = cols
    order, first = _leaders(m, path, doc=doc, pos=pos)
    size = np.diff(first, append=len(order))
    lead = np.repeat(order[first], size)
    later = order[(doc[order] != doc[lead]) | (pos[order] != pos[lead])]
    heads = order[first]
    seeds, where, paths = np.unique(m[heads], return_inverse=True, return_counts=True)
    branch = heads[paths[where] > 1]
    for kind, at in ((REPEATED, later), (EXPAND, branch)):
        if len(at):
            yield _batch(np.full(len(at), kind), m[at], path[at], doc[at], pos[at], n[at])


def _emit_edges(window: int):
    """Edges of the segments to expand: (two hashes, document, word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, spans = _ids(b.column(0)), utf8(b.column(1)), b.column(2).to_pylist()
            for x, y in pieces(texts):
                w = split_words(texts[x:y], NOT_SPACE)
                k = len(w.doc) - window + 1
                if k <= 0:
                    continue
                ask = np.array([(w.first[d] + s["pos"], s["n"], d) for d in range(y - x) for s in spans[x + d]], np.int64).reshape(-1, 3)
                ask = ask[ask[:, 0] + ask[:, 1] <= k]
                at = np.repeat(ask[:, 0] - np.concatenate(([0], np.cumsum(ask[:, 1])[:-1])) if len(ask) else ask[:, 0], ask[:, 1]) + np.arange(ask[:, 1].sum())
                e1, e2 = windows_hash(w.h[0], window), windows_hash(w.h[1], window)
                doc = w.doc[at]
                yield _batch(np.zeros(len(at)), e1[at], e2[at], ids[x + doc], at - w.first[doc], np.ones(len(at)))
    return run


def _later_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with an earlier equal one."""
    cols = [np.concatenate([b.column(i).to_numpy() for b in bs]) for bs in [list(batches)] if bs for i in range(1, 6)]
    if not cols:
        return
    m, path, doc, pos, n = cols
    order, first = _leaders(m, path, doc=doc, pos=pos)
    lead = np.repeat(order[first], np.diff(first, append=len(order)))
    at = order[(doc[order] != doc[lead]) | (pos[order] != pos[lead])]
    if len(at):
        yield _batch(np.full(len(at), REPEATED), m[at], path[at], doc[at], pos[at], n[at])


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Runs of windows with an earlier equal one: (doc, pos: first word of the first window,
    n: number of windows). ``docs``: (doc_id, text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.mapInArrow(_emit_segments(window, seed), _ROW)
    settled = rows.filter(F.col("kind") == REPEATED)
    judged = rows.filter(F.col("kind") == COMPARE).repartition("m").mapInArrow(_compact, _ROW).checkpoint()
    span = F.struct("pos", "n")
    asked = judged.filter(F.col("kind") == EXPAND).groupBy("doc").agg(F.collect_list(span).alias("spans"))
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text")
    edges = texts.join(asked, "doc").select("doc", "text", "spans").mapInArrow(_emit_edges(window), _ROW)
    branching = edges.repartition("m", "path").mapInArrow(_later_edges, _ROW)
    return (settled.union(judged.filter(F.col("kind") == REPEATED)).union(branching)).select("doc", "pos", "n")


def _cut(window: int):
    """Words left after the repeated windows' words go, and what went."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = utf8(b.column(1)), b.column(2).to_pylist()
            total, gone, kept, cut = [], [], [], []
            for t, ss in zip(texts, spans):
                words = (t or b"").split()  # bytes split on just the six ASCII white-space bytes
                runs = []
                if ss:
                    mark = np.zeros(len(words) + 1, np.int64)
                    for s in ss:
                        mark[min(s["pos"], len(words))] += 1
                        mark[min(s["pos"] + s["n"] + window - 1, len(words))] -= 1
                    hit = np.cumsum(mark[:-1]) > 0
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    runs = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                    words = [x for x, h in zip(words, hit.tolist()) if not h]
                    total.append(len(hit))
                    gone.append(int(hit.sum()))
                else:
                    total.append(len(words))
                    gone.append(0)
                kept.append(b" ".join(words))
                cut.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, kind)],
                names=["doc_id", "n_words", "n_removed", "kept", "removed"])
    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one
    space), removed (spans of words: start, end exclusive)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_windows(docs, window, seed).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    texts = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"))
    return texts.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur earlier."""
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
                       F.size("removed").alias("n_spans"))


_ORACLE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, a, md5(array_to_string(w[a:a + 19], ' ')) AS t FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS a FROM w WHERE len(w) >= 20)),
  late AS (SELECT doc_id, a FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS r FROM win) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS p FROM late),
  each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
  runs AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone)
    WHERE q IS NULL OR q < p - 1 GROUP BY 1),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
  n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256, coalesce(k, 0)::INT AS n_spans
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)"""

QUERIES = {"op2_repeated_spans": op2_repeated_spans}
ORACLES = {"op2_repeated_spans": _ORACLE}
