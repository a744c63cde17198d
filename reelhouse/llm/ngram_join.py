"""N-gram Jaccard join: a size-aware heavy-light join.

A document's set is its distinct shingles of ``SHINGLE`` words. Two sets link if their Jaccard
similarity is at least ``PERCENT`` / 100. Documents with equal sets are one representative.

Light sets (up to the boundary) enumerate subsets of fixed size: linked sets of size n miss at
most floor(n / 10) elements (at 90 percent, n / 5 at 80) of the other, so they share one of their subsets
that lack so many elements or fewer; each subset is one hash, the set's sum without the missing
ones. Heavy sets scan inverted lists: under one order of all shingles, rarest first, linked sets
share a shingle among their first n - ceil(0.9 n) + 1. The boundary is the size up to which
subsets cost less (rows they make) than list scans (rows times the length of their lists),
measured on the sets themselves; no set that may miss more than ``LOST`` elements is light. Sets that a light set could link to beyond the boundary enumerate, too.

Rarity comes from a table of fixed size that counts hashed shingles over all documents; any
order serves, this one keeps frequent shingles out of the lists.

Buckets (subset hashes, inverted lists) become components without all pairs of a bucket
(``clusters.link_buckets``). Candidate pairs must pass the length and positional bounds and the
parity bound: each set has a bit per element or more, holding the parity of the elements
hashed there; the bits in which two sets differ are a lower bound of their difference. Pairs
that pass are verified on whole sets, remade for their documents only: a bit table of fixed
size tells tasks which, so texts are never shuffled.

Defined cases: null texts and texts without words have the empty set, which links with
nothing; rows of one id count as one document when links are followed; rows without an id
belong to the component of an equal set, if any; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .clusters import link_buckets
from .words import NOT_SPACE, mix64, pieces, split_words, utf8, windows_hash, within

SHINGLE, PERCENT = 3, 90
#: Entries of the table of shingle counts and of the table of documents to verify.
COUNT_BITS, MEMBER_BITS, CHUNK = 1 << 20, 1 << 23, 1 << 12
#: Light sets miss at most so many elements, and have at most so many.
LOST, LIGHT = 2, 26


def _missing(n: int, percent: int) -> int:
    """How many of its n elements a set may lack in a linked one."""
    return n - -(-percent * n // 100)


def _largest(percent: int) -> int:
    """The largest possible boundary: what its sets can link to misses at most LOST elements, too."""
    return max(n for n in range(LIGHT + 1) if _missing(n * 100 // percent, percent) <= LOST)


def _sets(texts: list[bytes | None], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, distinct shingle hashes, sorted) of every text."""
    for x, y in pieces(texts):
        w = split_words(texts[x:y], NOT_SPACE, lower=True, hashes=1)
        at = within(w.doc, shingle)
        h = windows_hash(w.h[0], shingle)[at]
        edge = np.searchsorted(w.doc[at], np.arange(y - x + 1))
        for d in range(y - x):
            n = w.first[d + 1] - w.first[d]
            if 0 < n < shingle:
                yield x + d, windows_hash(w.h[0][w.first[d]:w.first[d + 1]], int(n))
            else:
                yield x + d, np.unique(h[edge[d]:edge[d + 1]])


def _slots(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(size - 1)).astype(np.int64)


def _count(shingle: int):
    """A task's shingle counts by table entry, in chunks that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNT_BITS, np.int64)
        for b in batches:
            texts = utf8(b.column(0))
            for x, y in pieces(texts):
                w = split_words(texts[x:y], NOT_SPACE, lower=True, hashes=1)
                h = windows_hash(w.h[0], shingle)[within(w.doc, shingle)]
                table += np.bincount(_slots(h, COUNT_BITS), minlength=COUNT_BITS)
        rows = table.reshape(-1, CHUNK)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([np.minimum(rows[i], 0xFFFFFFFF).astype("<u4").tobytes() for i in used], pa.binary())],
                                         names=["chunk", "n"])
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
            held += np.frombuffer(n, "<u4")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes() for v in total.values()], pa.binary())],
                                     names=["chunk", "n"])


def _rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    parts = texts.mapInArrow(_count(shingle), "chunk long, n binary").repartition("chunk").mapInArrow(_add_up, "chunk long, n binary")
    table = np.zeros((COUNT_BITS // CHUNK, CHUNK), np.uint32)
    for r in parts.collect():  # the table's fixed size
        table[r["chunk"]] = np.frombuffer(r["n"], "<u4")
    return table.ravel()


def _parity(h: np.ndarray) -> bytes:
    """Parity of the elements by hashed place, in the next power of two of bits (256 at least)."""
    size = max(256, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount(_slots(h, size), minlength=size) & 1, bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the shorter's size."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ _folded(y, len(x))).sum())


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bytes folded to ``size`` bytes, both powers of two."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _signatures(shingle: int, percent: int, sent):
    """Per document: set size, set key (128 bits), prefix of the inverted lists, subset hashes,
    parity."""
    largest = _largest(percent) * 100 // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = utf8(b.column(1)), []
            for _, s in _sets(texts, shingle):
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, None, None, None, None))
                    continue
                e = mix64(s ^ np.uint64(0x2545F4914F6CDD1D))
                key = e.sum(dtype=np.uint64)
                p = _missing(n, percent) + 1
                order = np.lexsort((s, sent.value[_slots(s, COUNT_BITS)]))[:p]
                subsets = None
                if n <= largest:
                    lost = [e[list(c)].sum(dtype=np.uint64) for d in range(_missing(n, percent) + 1) for c in combinations(range(n), d)]
                    subsets = mix64(key - np.array(lost, np.uint64) + np.uint64(1)).view(np.int64)
                rows.append((n, key.view(np.int64), s.sum(dtype=np.uint64).view(np.int64), s[order].view(np.int64), subsets, par := _parity(e),
                             _folded(np.frombuffer(par, np.uint8), 32).view(np.int64)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", "n", "k1", "k2", "prefix", "subsets", "parity", "fold"])
    return run


def _member_sets(shingle: int, sent):
    """Whole sets of the documents that the table has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sent.value[_slots(mix64(ids.astype(np.int64).view(np.uint64)), MEMBER_BITS)])
            texts = utf8(b.column(1).take(pa.array(at)))
            sets = [s.astype("<u8").tobytes() for _, s in _sets(texts, shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])
    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table entries of ids, as (word, bits)."""
    for b in batches:
        slot = np.unique(_slots(mix64(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), MEMBER_BITS))
        word, first = np.unique(slot >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)), first) if len(slot) else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _members(ids: DataFrame) -> np.ndarray:
    marks = ids.mapInArrow(_mark, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    table = np.zeros(MEMBER_BITS // 64, np.int64)  # its fixed size bounds what is gathered
    table[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
                both = np.concatenate((s, t))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _close(percent: int):
    """Pairs (a, b, their sizes and parities) whose sets may link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, m, n, p, q = (c.to_pylist() for c in b.columns)
            keep = [_differ(u, v) <= x + y - 2 * -(-percent * (x + y) // (100 + percent)) for x, y, u, v in zip(m, n, p, q)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _boundary(reps: DataFrame, lists: DataFrame) -> int:
    """The largest light set of those in ``reps``, by cost: rows that subsets make against rows in
    the lists times the length of those lists."""
    rows = reps.groupBy("n").agg(F.sum(F.size("subsets")).alias("rows"))
    scan = lists.groupBy("n").agg(F.sum("len").alias("scan"))
    cost = rows.join(scan, "n", "left").na.fill(0).collect()  # one row per size
    return min((0, *(r["n"] for r in cost)), key=lambda x: (sum(r["rows"] if r["n"] <= x else r["scan"] for r in cost), x))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    ensure_checkpoint_dir(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = sc.broadcast(_rarity(docs.select("text"), shingle))
    sig = docs.mapInArrow(_signatures(shingle, percent, order),
                          "doc_id long, n long, k1 long, k2 long, prefix array<long>, subsets array<long>, parity binary, fold array<long>").checkpoint()
    equal = sig.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")).checkpoint()
    reps = (sig.filter("n > 0").join(equal.select(F.col("rep").alias("doc_id"), "k1", "k2", "n"), ["doc_id", "k1", "k2", "n"], "left_semi")
            .select("doc_id", "n", "prefix", "subsets", "parity", "fold"))
    lists = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "bucket"))
    shared = lists.groupBy("bucket").agg(F.count("*").alias("len")).filter("len > 1")
    lists = lists.join(shared, "bucket").checkpoint()  # a list of one links nothing
    may_be_light = F.col("n") <= _largest(percent)
    light = _boundary(reps.filter(may_be_light), lists.filter(may_be_light))
    entries = lists.filter(F.col("n") > light).select("bucket", "id", "n", "pos")
    if light:
        subsets = reps.filter(F.col("n") <= light * 100 // percent).select("doc_id", "n", F.explode("subsets").alias("bucket"))
        entries = entries.union(subsets.select("bucket", F.col("doc_id").alias("id"), "n", F.lit(-1).alias("pos")))
    folds = reps.select(F.col("doc_id").alias("id"), "n", *[F.get("fold", F.lit(i)).alias(f"f{i}") for i in range(4)])
    entries = entries.join(folds, ["id", "n"])

    def may_link(x, y):
        a, b, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
        need = F.ceil(percent * (a + b) / (100.0 + percent) - 1e-9)  # of the intersection
        near = (F.least(a, b) * 100 >= percent * F.greatest(a, b))
        reach = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)
        differ = sum((F.bit_count(F.col(f"{x}f{k}").bitwiseXOR(F.col(f"{y}f{k}"))) for k in range(4)), F.lit(0))
        return near & ((i < 0) | (j < 0) | (reach >= need)) & (differ <= a + b - 2 * need)

    def verify(pairs):
        s = reps.select("doc_id", "n", "parity").dropDuplicates(["doc_id", "n", "parity"])
        both = (pairs.join(s.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("parity").alias("p")), "a")
                .join(s.select(F.col("doc_id").alias("b"), "n", F.col("parity").alias("q")), "b").select("a", "b", "m", "n", "p", "q"))
        close = both.mapInArrow(_close(percent), "a long, b long").checkpoint()
        ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        sets = (docs.filter("doc_id IS NOT NULL").mapInArrow(_member_sets(shingle, sc.broadcast(_members(ids))), "id long, s binary")
                .join(ids, "id", "left_semi").checkpoint())
        both = (close.join(sets.select(F.col("id").alias("a"), "s"), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t"))
        return both.mapInArrow(_linked(percent), "a long, b long").distinct()

    comps = link_buckets(entries, verify, extras=("n", "pos", "f0", "f1", "f2", "f3"), may_link=may_link)
    classes = equal.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "k1", "k2", "n", F.coalesce("comp", "rep").alias("component_id"))
    out = sig.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLE = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[a:a + least(3, len(w)) - 1], ' ') AS t FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS a FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (t) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    WHERE x.doc_id <> y.doc_id AND 100 * least(nx.n, ny.n) >= 90 * greatest(nx.n, ny.n)
    GROUP BY 1, 2, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
  reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = w.doc_id"""

QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLES = {"op5_ngram_join": _ORACLE}
