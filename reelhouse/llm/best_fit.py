"""Packing token pieces into sequences: best fit, then swap-based local search.

Only lengths matter for how full a sequence gets, and there are at most ``CAPACITY`` of them.
So Spark tokenises, counts the pieces of each length and ranks every piece among those of its
length; the plan is made on the counts alone. A plan is a list of fillings (a multiset of
lengths) with how many sequences have it; its size depends on the capacity, not on the number
of documents. Best fit, longest first, makes the first plan. The local search then exchanges
one piece for one, two for one, or moves a piece between underfull fillings wherever this
raises the sum of squared fills, until sequences empty or no exchange helps. Each exchange
applies to as many sequences as both fillings have.

Afterwards the piece of rank r among its length takes the r-th place the plan has for that
length. Ranks are counted within buckets of bounded size plus the counts of the buckets before
it, so equal lengths (a third of all rows may be copies) are never gathered in one task.

Tokens: the byte-level vocabulary of ``byte_bpe_50k`` as ranks; the tests hold its ids against
those of the ``tokenizers`` file of the same vocabulary. Texts that hold a special token's string get
its one id, as that file gives.

Defined cases: null and empty texts are one piece of the end id alone; equal rows are separate
pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CAPACITY, END_ID, BUCKET_ROWS = 1024, 2, 50_000
#: Fixed value: the public word pattern of this vocabulary, its runs possessive.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict = {}


def encoder(path: str | None = None):
    """The vocabulary at ``path`` (the installed public file by default), once per process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def _tokenise(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, done = [], {}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                cut = done.get(text)  # copies often lie together
                if cut is None:
                    ids = enc.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else enc.encode_ordinary(text)
                    ids.append(END_ID)
                    raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                    head = n % capacity or capacity
                    edges = [0, *range(head, n + 1, capacity)]
                    cut = done[text] = [(i, s, e - s, zlib.crc32(raw[4 * s:4 * e])) for i, (s, e) in enumerate(zip(edges, edges[1:]))]
                rows.extend((doc, *c) for c in cut)
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of (doc_id, text): documents longer than ``capacity`` are cut, the first piece
    being the shorter one."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _tokenise(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------ the plan, on counts alone
Filling = tuple  # of (length, how many), longest first


def _fill(f: Filling) -> int:
    return sum(a * n for a, n in f)


def _with(f: Filling, add: list[int] = (), drop: list[int] = ()) -> Filling:
    c = Counter(dict(f))
    c.update(add)
    c.subtract(drop)
    return tuple(sorted(((a, n) for a, n in c.items() if n), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, over (length -> count): filling -> number of sequences."""
    open_: dict[int, Counter] = {}  # room left -> fillings
    rooms: list[int] = []
    done: Counter = Counter()

    def put(f, n):
        room = capacity - _fill(f)
        if room == 0:
            done[f] += n
            return
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][f] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                f, n = next(iter(open_[room].items()))
                del open_[room][f]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, f, n = capacity, (), left
            each = min(room // length, left)   # one sequence takes what fits before the next is tried
            use = min(n, left // each)
            put(_with(f, [length] * each), use)
            left -= use * each
            if f and n > use:
                put(f, n - use)
    for fs in open_.values():
        done.update(fs)
    return done


def local_search(plan: Counter, capacity: int) -> Counter:
    """Exchanges between underfull fillings that raise the sum of squared fills, so they end."""
    full = Counter({f: n for f, n in plan.items() if _fill(f) == capacity})
    under = Counter({f: n for f, n in plan.items() if _fill(f) < capacity})
    total = sum(_fill(f) * n for f, n in plan.items())
    fewest = -(-total // capacity)

    def exchanges(a: Filling, b: Filling):
        """(gain of the fuller, pieces into it, pieces out of it), from the emptier ``b``."""
        room = capacity - _fill(a)
        xs, ys = [x for x, _ in b], [y for y, _ in a]
        pairs = [(x, z) for i, (x, n) in enumerate(b) for z in ([x] if n > 1 else []) + xs[i + 1:]]
        for x in xs:
            if x <= room:
                yield x, [x], []
            for y in ys:
                if 0 < x - y <= room:
                    yield x - y, [x], [y]
        for x, z in pairs:
            for y in ys:
                if 0 < x + z - y <= room:
                    yield x + z - y, [x, z], [y]

    stuck: set = set()
    while sum(full.values()) + sum(under.values()) > fewest:
        order = sorted((f for f in under), key=lambda f: (_fill(f), f))
        todo = None
        for b in order:                      # the emptiest first: it is to empty
            if b in stuck:
                continue
            best = max(((g, i, o, a) for a in order if (a != b and _fill(a) >= _fill(b)) or (a == b and under[b] > 1)
                        for g, i, o in exchanges(a, b)), default=None)
            if best:
                todo = (b, *best)
                break
            stuck.add(b)
        if not todo:
            break
        b, _, into, out, a = todo
        n = under[b] // 2 if a == b else min(under[a], under[b])
        for f in {a, b}:
            under[f] -= n * (2 if a == b else 1)
            if not under[f]:
                del under[f]
        for f in (_with(a, into, out), _with(b, out, into)):
            if f:
                (full if _fill(f) == capacity else under)[f] += n
        stuck.clear()
    return full + under


def places(plan: Counter) -> pd.DataFrame:
    """Where the pieces of each length go: from rank ``lo`` on, ``each`` to a sequence, the
    first sequence being ``seq``, at ``offset``."""
    rows, seq, used = [], 0, Counter()
    for f, n in sorted(plan.items(), reverse=True):
        offset = 0
        for length, each in f:
            rows.append((length, used[length], each, seq, offset))
            used[length] += n * each
            offset += length * each
        seq += n
    return pd.DataFrame(rows, columns=["length", "lo", "each", "seq", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    ensure_checkpoint_dir(spark)
    pieces = pieces.checkpoint()  # tokenised once
    buckets = pieces.count() // BUCKET_ROWS + 1
    p = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    held = p.groupBy("length", "_bucket").count()
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("count")).collect()}  # at most ``capacity`` rows
    table = places(local_search(best_fit(counts, capacity), capacity)).sort_values(["length", "lo"])
    by_length = {length: g[["lo", "each", "seq", "offset"]].to_numpy(np.int64) for length, g in table.groupby("length")}
    sent = spark.sparkContext.broadcast(by_length)  # as many rows as the plan has fillings and lengths

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = (p.withColumn("_rank", F.row_number().over(rank) - 1).join(held, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), r.to_numpy(np.int64)
        seq, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for x in np.unique(n):
            at, t = np.flatnonzero(n == x), sent.value[int(x)]
            row = t[np.searchsorted(t[:, 0], r[at], side="right") - 1]
            seq[at] = row[:, 2] + (r[at] - row[:, 0]) // row[:, 1]
            offset[at] = row[:, 3] + (r[at] - row[:, 0]) % row[:, 1] * x
        return pd.DataFrame({"sequence_id": seq, "offset": offset})

    return (ranked.withColumn("_place", place("length", "_rank"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs))


QUERIES = {"op10_best_fit": op10_best_fit}
ORACLES: dict[str, str] = {}
