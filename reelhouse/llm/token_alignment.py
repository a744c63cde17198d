"""Alignment of two tokenizers' tokens by the bytes they cover, and which tokens correspond.

Both token sequences cover the same bytes, so a byte offset where a token of each ends is a shared
cut. Cuts are found by divide and conquer: in an interval between two known cuts, a common end near
the middle is located by bisection (from the middle token of one side, the next end of the other
side is looked up, then the next end of the first, until both meet), the interval is split there and
both halves are treated alike; an interval without a common end inside is a leaf, a group of
tokens that only match as a whole. All intervals of one depth, of all documents that a task holds at
a time, are bisected together.

The last tokens of a group's two sides are linked. How many links the corpus has for a pair of ids is
counted in two steps: per task for the documents at hand, then per pair. Counts go back to the documents
in two ways. The pairs that occur in more than one ``COMMON``-th of all (document, pair) rows, at most
``COMMON`` of them, are sent to all tasks as arrays (17 bytes a pair); the rows of the others, none of
which is frequent, meet their counts in a join.

Side A is the byte-level vocabulary of ``byte_bpe_50k`` on a space and the text, side B the merge-type
vocabulary of ``piece_bpe_32k``, which adds that space itself. A's tokens come from the same
vocabulary as ranks; tests hold them against the ``tokenizers`` file.

Packed columns hold little-endian unsigned 32-bit integers: ids of both sides, and per shared cut the
number of tokens of each side before it.

Defined cases: texts that are null, empty, or whose joined token bytes differ from a space and the text
have no tokens; rows that repeat, also their ids, are rows; an empty table gives an empty result; only
the columns named in ``keep`` pass (a name the result has raises ValueError). A text is worked on whole:
a task holds some 60 times its size for it, and as much for each slice of ``SLICE_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .best_fit import encoder
from .piece_codec import SPACE, codec
from .words import slices

SLICE_BYTES, SLICE_PAIRS, COMMON = 1 << 18, 1 << 19, 1 << 19


# ------------------------------------------------------------------ shared cuts
def _meet(a: np.ndarray, b: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """Per interval the first place in ``a``, from ``at`` on in the direction ``step``, whose value is
    in ``b``, or -1 if ``stop`` comes first; a value of ``stop`` is in both."""
    found, open_ = np.full(len(at), -1), np.arange(len(at))
    while len(open_):
        inside = at < stop[open_] if step > 0 else at > stop[open_]
        at, open_ = at[inside], open_[inside]
        for x, y in ((a, b), (b, a)):  # the next end of the other side, then of this one
            nxt = np.searchsorted(y, x[at], side="left") if step > 0 else np.searchsorted(y, x[at], side="right") - 1
            at, nxt, open_ = at[nxt >= 0], nxt[nxt >= 0], open_[nxt >= 0]  # below 0: the other side begins later
            same = y[nxt] == x[at]
            found[open_[same]] = (at if x is a else nxt)[same]
            at, open_ = nxt[~same], open_[~same]
    return np.where((found < stop) if step > 0 else (found > stop), found, -1)


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in ``a`` (rising token ends) whose end is in ``b``, too. ``last`` are the places in ``a``
    of the documents' last tokens, which are shared."""
    cuts = [last]
    lo, hi = np.concatenate(([-1], last[:-1])), last  # tokens lo+1 .. hi, both ends shared
    while True:
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return np.sort(np.concatenate(cuts))
        mid = (lo + hi + 1) // 2
        cut = _meet(a, b, mid, hi, 1)
        left = cut < 0
        cut[left] = _meet(a, b, mid[left] - 1, lo[left], -1)
        split = cut >= 0
        lo, hi, cut = lo[split], hi[split], cut[split]
        cuts.append(cut)
        lo, hi = np.concatenate([lo, cut]), np.concatenate([cut, hi])


# ------------------------------------------------------------------ tokens of both sides
class Sides:
    """Both vocabularies: ids of a text, and each id's bytes."""

    def __init__(self, path_a: str | None, path_b: str | None):
        self.a, self.b = encoder(path_a), codec(path_b)
        known = {i: t for t, i in self.a._mergeable_ranks.items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        bytes_of = {self.b.byte_ids[x]: bytes([x]) for x in range(256)} if self.b.byte_ids else {}
        self.bytes_b = [bytes_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.b.pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.bytes_a, self.bytes_b))

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        a, b = self.a.encode_ordinary(" " + text), self.b.library.encode(text)
        want = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)


_SIDES: dict = {}


def sides(path_a: str | None = None, path_b: str | None = None) -> Sides:
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as packed binaries."""
    raw, at = values.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts * 4)))
    return pa.array([raw[s:e] for s, e in zip(at, at[1:])], pa.binary())


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a packed column end to end, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.array([len(r) // 4 for r in rows], np.int64)


def _align(texts: list[str | None], s: Sides) -> list[pa.Array]:
    ids = [s.ids(t) for t in texts]
    n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
    a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
    cuts_a = cuts_b = np.empty(0, np.int64)
    if len(a):
        ends_a, ends_b = np.cumsum(s.size_a[a]), np.cumsum(s.size_b[b])  # documents lie end to end
        cuts_a = shared_cuts(ends_a, ends_b, (np.cumsum(n_a) - 1)[n_a > 0])
        cuts_b = np.searchsorted(ends_b, ends_a[cuts_a])
    doc = np.repeat(np.arange(len(texts)), n_a)[cuts_a]
    held = np.bincount(doc, minlength=len(texts))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    return [_packed(a, n_a), _packed(b, n_b), _packed(cuts_a + 1 - first_a[doc], held), _packed(cuts_b + 1 - first_b[doc], held)]


ALIGNED = {"a_ids": "binary", "b_ids": "binary", "a_cuts": "binary", "b_cuts": "binary"}


def _schema(df: DataFrame, keep: tuple[str, ...], made: dict[str, str]) -> str:
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns named like the result's: {sorted(clash)}")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {t}" for c, t in made.items())])


def align(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``keep`` columns with both sides' ids and their shared cuts, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, k = sides(path_a, path_b), len(keep)
        for b in batches:
            for lo, hi in slices(b.column(k), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *_align(part.column(k).to_pylist(), s)], names=[*keep, *ALIGNED])

    schema = _schema(docs, keep, ALIGNED)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ groups and links
def _joined(parts: list, counts: np.ndarray) -> list[str]:
    edge = np.concatenate(([0], np.cumsum(counts))).tolist()
    return ["".join(parts[s:e])[:-1] for s, e in zip(edge, edge[1:])]


class _Names:
    """Decimal ids followed by each separator."""

    def __init__(self):
        self.upto, self.tables = 0, {}

    def get(self, sep: str, most: int) -> np.ndarray:
        if most >= self.upto:
            self.upto = max(2 * self.upto, most + 1, 1 << 16)
            self.tables = {x: np.array([f"{i}{x}" for i in range(self.upto)], object) for x in ",|;"}
        return self.tables[sep]


def _groups_and_links(part: pa.RecordBatch, at: int, names: _Names, base: int) -> list[pa.Array]:
    (a, n_a), (b, n_b), (cut_a, held), (cut_b, _) = (_flat(part.column(at + i)) for i in range(4))
    rows = np.arange(part.num_rows)
    doc = np.repeat(rows, held)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    end_a, end_b = first_a[doc] + cut_a, first_b[doc] + cut_b  # tokens before each cut, documents end to end
    texts = [""] * part.num_rows
    pair = np.empty(0, np.int64)
    if len(a):
        out = np.empty(len(a) + len(b), object)
        group_a, group_b = (np.repeat(np.arange(len(end_a)), np.diff(end, prepend=0)) for end in (end_a, end_b))
        place_a = np.arange(len(a)) + np.concatenate(([0], end_b))[group_a]  # after the B tokens of earlier groups
        place_b = np.arange(len(b)) + end_a[group_b]                         # after the A tokens up to its own
        most = int(max(a.max(), b.max()))
        out[place_a], out[place_b] = names.get(",", most)[a], names.get(",", most)[b]
        out[place_a[end_a - 1]], out[place_b[end_b - 1]] = names.get("|", most)[a[end_a - 1]], names.get(";", most)[b[end_b - 1]]
        texts = _joined(out.tolist(), n_a + n_b)
        pair = a[end_a - 1] * base + b[end_b - 1]
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(pair) != 0)))) if len(pair) else np.empty(0, np.int64)
    times = np.diff(np.concatenate((new, [len(pair)])))
    starts = np.searchsorted(doc[new], np.arange(part.num_rows + 1)).astype(np.int32)
    return [pa.array(n_a), pa.array(n_b), pa.array(held.astype(np.int64)),
            pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
            pa.ListArray.from_arrays(starts, pa.array(pair[new], pa.int64())), pa.ListArray.from_arrays(starts, pa.array(times, pa.int64()))]


GROUPED = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups_sha256": "string", "pairs": "array<long>", "times": "array<long>"}


def groups_and_links(aligned: DataFrame, base: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the digest of the written groups, and the distinct linked pairs (A's id *
    ``base`` + B's id) with how often the row has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = _Names(), len(keep)
        for b in batches:
            for lo, hi in slices(b.column(k), 4 * SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *_groups_and_links(part, k, names, base)], names=[*keep, *GROUPED])

    return aligned.select(*[F.col(f"`{c}`") for c in keep], *ALIGNED).mapInArrow(run, _schema(aligned, keep, GROUPED))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and each row's length."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _row_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    edge = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1))
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(size)]) if len(size) else ()


def _count_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and rows of each pair among some of the rows."""
    for b in batches:
        for lo, hi in _row_slices(b.column(0), SLICE_PAIRS):
            pair, times = (_lists(c.slice(lo, hi - lo))[0] for c in b.columns)
            keys, at = np.unique(pair, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.bincount(at, times, len(keys)).astype(np.int64)),
                 pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))], names=["pair", "links", "rows"])


def pair_counts(grouped: DataFrame, base: int) -> DataFrame:
    """Per pair: links in the corpus, rows that hold it, and whether no pair of its B id has more links."""
    some = grouped.select("pairs", "times").mapInArrow(_count_some, "pair long, links long, `rows` long")
    counts = some.groupBy("pair").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    of_b = Window.partitionBy(F.col("pair") % base)  # at most as many rows as A has ids
    return counts.withColumn("best", F.col("links") == F.max("links").over(of_b))


def _with_common(sent, k: int):
    """Adds up the counts of the common pairs; leaves the others as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, links, best = sent.value
        for b in batches:
            for lo, hi in _row_slices(b.column(k), SLICE_PAIRS):
                part = b.slice(lo, hi - lo)
                (pair, size), (times, _) = _lists(part.column(k)), _lists(part.column(k + 1))
                row = np.repeat(np.arange(part.num_rows), size)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                total, n_best = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(total, row[hit], times[hit] * links[at[hit]])
                np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
                starts = np.searchsorted(row[~hit], np.arange(part.num_rows + 1)).astype(np.int32)
                rest = [pa.ListArray.from_arrays(starts, pa.array(x[~hit], pa.int64())) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *rest, pa.array(total), pa.array(n_best)],
                                                 names=[*b.schema.names, "count_sum", "n_best"])
    return run


def count_links(grouped: DataFrame, base: int, common: int = COMMON) -> DataFrame:
    """``grouped`` rows (pairs, times and a unique ``row``) with count_sum and n_best over their links."""
    spark = grouped.sparkSession
    ensure_checkpoint_dir(spark)
    counts = pair_counts(grouped, base).checkpoint()
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    is_common = F.col("rows") * common >= rows  # true for ``common`` pairs at most, as ``rows`` is their sum
    table = counts.filter(is_common).select("pair", "links", "best").toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["links"].to_numpy(), table["best"].to_numpy().astype(np.int64)))
    cols = [c for c in grouped.columns if c not in ("pairs", "times")]
    types = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*cols, "pairs", "times"]), "count_sum long", "n_best long"])
    met = grouped.select(*[F.col(f"`{c}`") for c in cols], "pairs", "times").mapInArrow(_with_common(sent, len(cols)), schema)
    if len(table) == counts.count():
        return met.drop("pairs", "times")
    met = met.checkpoint()
    rest = (met.select("row", F.inline(F.arrays_zip("pairs", "times")))
            .join(counts.filter(~is_common), F.col("pairs") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.col("times") * F.col("links")).alias("_sum"),
                                F.sum(F.col("times") * F.col("best").cast("long")).alias("_best")))
    met = met.drop("pairs", "times").join(rest, "row", "left")
    return (met.withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
            .withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).drop("_sum", "_best"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, common: int = COMMON) -> DataFrame:
    """All documents aligned; links weighed by how often the corpus links their ids."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = len(sides().bytes_b)
    keep = ("doc_id", "row")
    aligned = align(docs.withColumn("row", F.monotonically_increasing_id()), keep=keep)
    grouped = groups_and_links(aligned, base, keep=keep).checkpoint()
    out = count_links(grouped, base, common)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
