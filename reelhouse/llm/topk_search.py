"""Exact top-k inner products by columnar branch-and-bound.

Vectors travel as one narrow row each. Queries are dealt to groups and candidates to shares; a
task gets one group and one share (queries go to every share, candidates to every group), the
group first and then the share in the order of its ids, so no row holds a pair of blocks. There
vectors are laid out in blocks stored dimension by dimension (vertical layout), and every block
of candidates meets every block of queries. What is left of a candidate after a run of slabs
can add at most the product of the remaining norms (Cauchy-Schwarz, rounded up to whole
numbers); a candidate whose bound is below every query's k-th best so far is dropped, and only
the survivors get the other slabs. The bound and the k-th best are rows of the blocks, so one
matrix product gives by how much each pair passes. How many slabs the first run has is chosen
on a few candidates of a block now and then: all of them where bounds drop too few.

Components and bounds are whole numbers, and products run in the shortest floats that hold all
sums exactly. Bounds are never rounded down. A task's candidates come in the order of their
ids, so later ones must be better than the k-th best; ties inside a block survive, and the
result is exact.

A task keeps its queries (``QUERY_BYTES`` at most) with k rows each and one block of
candidates, and emits k rows per query; a window over those picks the final ones.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; only vectors of equal length meet; a null id takes no part; a query id that repeats asks
once, with its smallest vector; candidate rows of the query's own id are not its candidates;
other repeated rows are candidates each; ties go to the smaller id. Scores beyond a long are
held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

QUERY_BLOCK, CANDIDATE_BLOCK, SLAB = 256, 2048, 16
#: Queries of a task, as blocks of 4-byte floats; shares of candidates at most, or so many tasks a core if those are more.
QUERY_BYTES, SHARES, TASKS = 64 << 20, 24, 4
#: Candidates that raise the k-th best at first; candidates the first run of slabs is chosen on, and after how many blocks again.
LEADERS, TRIED, TRY_AGAIN = 256, 64, 32
#: Passing pairs that are held until they are sorted in.
HITS = 1 << 18
EXACT = {np.float32: float(1 << 24), np.float64: float(1 << 53)}
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_SCRATCH: dict = {}  # products are written over the last ones: fresh memory costs a third of a product's time
_VECTOR = "dim int, vec_id long, cols binary"


def _floors(scale: int):
    """Whole-number components of the usable vectors."""
    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            at = vec.offsets.to_numpy()
            x = vec.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)  # nulls are NaN
            at = at - at[0]
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            ok = vec.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.clip(np.floor(x * scale), LEAST, MOST)
            if not ok.all():
                v, at = v[np.repeat(ok, np.diff(at))], np.concatenate(([0], np.cumsum(np.diff(at)[ok])))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v))],
                                             ["vec_id", "v"])
    return floors


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector as bytes: two a component where they fit, else eight."""
    for b in batches:
        ids, vec = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        width = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        high = np.concatenate(([0], np.cumsum(np.abs(flat) > 32767)))
        end = np.cumsum(width)
        short = high[end] == high[end - width]
        for rows, kind in ((short, np.dtype("<i2")), (~short, np.dtype("<f8"))):
            if rows.any():
                data = flat[np.repeat(rows, width)].astype(kind)
                ends = np.concatenate(([0], np.cumsum(width[rows]))) * kind.itemsize
                cols = pa.Array.from_buffers(pa.large_binary(), int(rows.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(width[rows], pa.int32()), pa.array(ids[rows], pa.int64()), cols.cast(pa.binary())],
                                                 ["dim", "vec_id", "cols"])


def _unpacked(dim: int, cols: pa.Array) -> np.ndarray:
    """(rows, dim) of what ``_pack`` wrote."""
    at = np.frombuffer(cols.buffers()[1], np.int64 if pa.types.is_large_binary(cols.type) else np.int32)[cols.offset:cols.offset + len(cols) + 1]
    data = np.frombuffer(cols.buffers()[2], np.uint8)[at[0]:at[-1]]
    short = np.diff(at) == 2 * dim
    if short.all():
        return data.view("<i2").reshape(-1, dim)
    out, is_short = np.empty((len(cols), dim)), np.repeat(short, np.diff(at))
    out[short] = data[is_short].view("<i2").reshape(-1, dim)
    out[~short] = data[~is_short].view("<f8").reshape(-1, dim)
    return out


class Block:
    """Vectors of whole numbers, dimension by dimension, with the norms of what each run of slabs leaves.

    ``head``: dimensions of the first run; ``met``: how many blocks this one has met."""

    def __init__(self, cols: np.ndarray, slab: int = SLAB):
        self.cols, self.dim, self.slab, self.made = cols, len(cols), slab, {}
        sums = np.add.reduceat(np.square(cols, dtype=float), np.arange(0, self.dim, slab), axis=0)
        rest = np.ceil(np.sqrt(np.cumsum(sums[::-1], axis=0)[::-1]) * (1 + 1e-12))
        self.norms, self.norm = rest[0], rest[0].max(initial=0)
        self.rest = np.concatenate((rest, np.zeros_like(rest[:1])))  # after 0, 1, ... slabs
        self.head, self.met = self.dim, 0

    def rows(self, kind, first, head: int) -> np.ndarray:
        """``first``, the norms of what is left and the dimensions before ``head``."""
        if kind not in self.made:
            self.made[kind] = [np.empty((self.dim + 2, self.cols.shape[1]), kind), None]
            self.made[kind][0][2:] = self.cols
        made, laid = self.made[kind]
        made[0] = first
        if laid != head:
            made[1] = self.rest[-(-head // self.slab)]
            self.made[kind][1] = head
        return made[:head + 2]

    def only(self, at: np.ndarray) -> Block:
        return Block(self.cols[:, at], self.slab)


def _first_run(q: Block, c: Block, kind, need) -> int:
    """How many dimensions to take before candidates are dropped: the cheapest on a few of them."""
    some = slice(None, None, max(1, c.cols.shape[1] // TRIED))
    cost = {q.dim: float(q.dim)}
    for head in range(q.slab, q.dim, q.slab):
        pass_by = q.rows(kind, -need, head).T @ np.ascontiguousarray(c.rows(kind, 1, head)[:, some])
        cost[head] = head + (pass_by.max(0) >= 0).mean() * q.dim
    return min(cost, key=cost.get)


def pair_scores(q, c, kth: np.ndarray, k: int, own: np.ndarray | None, slab: int = SLAB, pairs: bool = False):
    """Scores of queries (dim, n) against candidates (dim, m) that can reach ``kth`` (the least
    score that counts, per query): (surviving candidate positions, scores n x survivors), or with
    ``pairs`` (query positions, candidate positions, scores) of the pairs that reach it.

    ``q``, ``c``: arrays or ``Block``. ``own`` (n, m): pairs that don't count; where it is given,
    the first candidates raise those ``kth`` in place that are the lowest yet (of m above k)."""
    q, c = (x if isinstance(x, Block) else Block(x, slab) for x in (q, c))
    m = c.cols.shape[1]
    if not m or not q.cols.shape[1]:
        none = np.zeros(0, np.int64)
        return (none, none, none) if pairs else (np.arange(m), np.zeros((q.cols.shape[1], m), np.int64))
    kind = next((x for x, most in EXACT.items() if 4 * (q.norm + 1) * (c.norm + 1) < most), None)  # all partial sums are exact
    if kind is None:
        fit = 4 * (q.norm + 1) * (c.norms + 1) < EXACT[np.float64]
        s = np.empty((q.cols.shape[1], m), np.int64)
        if fit.any():  # beyond what doubles hold exactly: no pruning, also of the others in such a block
            s[:, fit] = pair_scores(q, c.only(fit), np.full(len(s), -np.inf), k, None)[1]
        big = q.cols.astype(float).astype(object).T @ c.cols[:, ~fit].astype(float).astype(object)
        s[:, ~fit] = np.clip(big, LEAST, MOST).astype(np.int64)
        if pairs:
            i, j = np.nonzero(s >= kth[:, None])
            return i, j, s[i, j]
        return np.arange(m), s
    limit = q.norm * c.norm + 1

    def passing(c: Block, head: int):
        need = np.minimum(np.maximum(kth, -limit), limit)
        n, m = len(need), c.cols.shape[1]
        if kind not in _SCRATCH or _SCRATCH[kind].size < n * m:
            _SCRATCH[kind] = np.empty(n * m, kind)
        by = np.matmul(q.rows(kind, -need, head).T, c.rows(kind, 1, head), out=_SCRATCH[kind][:n * m].reshape(n, m))
        return need, by, np.flatnonzero(by.max(0) >= 0)

    if own is not None and (open_ := kth <= LEAST).any() and m > k:
        lead = c.only(np.arange(min(m, max(LEADERS, 2 * k))))
        need, by, _ = passing(lead, q.dim)
        full = by[open_] + need[open_, None]
        full[own[open_, :full.shape[1]]] = -np.inf
        top = -np.partition(-full, k - 1, axis=1)[:, k - 1]
        kth[open_] = np.where(top > -np.inf, top, kth[open_])
    if q.met % TRY_AGAIN == 1:
        q.head = _first_run(q, c, kind, np.minimum(np.maximum(kth, -limit), limit))
    q.met += 1
    need, by, alive = passing(c, q.head)
    if q.head < q.dim and len(alive):
        left = Block.__new__(Block)
        left.cols, left.dim, left.slab, left.made, left.rest = c.cols[:, alive], c.dim, c.slab, {}, c.rest[:, alive]
        need, by, still = passing(left, q.dim)
        alive, by = alive[still], by[:, still]
    elif len(alive) < m:
        by = by.take(alive, axis=1)
    if pairs:
        i, j = np.divmod(np.flatnonzero(by >= 0), max(1, len(alive)))
        return i, alive[j], (by[i, j] + need[i]).astype(np.int64)
    return alive, (by + need[:, None]).astype(np.int64)


class Best:
    """The k best of each query: higher score first, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.have = k, np.zeros(n, np.int64)
        self.scores, self.ids = np.full((n, k), LEAST), np.full((n, k), MOST)

    def need(self) -> np.ndarray:
        """What a candidate of a larger id must reach to count, per query."""
        return np.where(self.have < self.k, LEAST, np.minimum(self.scores[:, -1], MOST - 1) + 1)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        told, n = np.unique(rows, return_counts=True)
        r = np.concatenate((rows, np.repeat(told, self.k)))
        s, v = np.concatenate((scores, self.scores[told].ravel())), np.concatenate((ids, self.ids[told].ravel()))
        o = np.lexsort((v, ~s, r))
        first = np.concatenate(([0], np.cumsum(n + self.k)[:-1]))
        o = o[(first[:, None] + np.arange(self.k)).ravel()]
        self.scores[told], self.ids[told] = s[o].reshape(-1, self.k), v[o].reshape(-1, self.k)
        self.have[told] = np.minimum(self.k, self.have[told] + n)


def _alike(mat: np.ndarray) -> np.ndarray:
    """The rows in an order that brings like ones together: what passes for none of a block is dropped,
    so the fewer directions a block has, the better. Rows too long for small floats come last."""
    norm = np.sqrt(np.einsum("ij,ij->i", mat, mat, dtype=float, casting="unsafe"))
    unit = (mat / np.maximum(norm, 1)[:, None]).astype(np.float32)
    some = unit[::QUERY_BLOCK].T
    near = np.concatenate([(unit[a:a + QUERY_BLOCK] @ some).argmax(1) for a in range(0, len(unit), QUERY_BLOCK)])
    return np.lexsort((near, (norm >= 1 << 25).astype(int) + (norm >= 1 << 11)))


class _Queries:
    """A task's queries of one length in blocks."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int):
        o = _alike(mat)
        self.ids, self.k, self.best, self.seen = ids[o], k, Best(len(ids), k), 0
        self.blocks = [(slice(a, a + QUERY_BLOCK), Block(np.ascontiguousarray(mat[o[a:a + QUERY_BLOCK]].T))) for a in range(0, len(o), QUERY_BLOCK)]

    def size(self) -> int:
        """Rows of the next block: small ones first, while the k-th best are low and much passes."""
        return min(CANDIDATE_BLOCK, max(LEADERS, self.seen))

    def meet(self, ids: np.ndarray, mat: np.ndarray) -> None:
        self.seen += len(ids)
        c, need, got, held = Block(np.ascontiguousarray(mat.T)), self.best.need(), [], 0
        low = (need == LEAST).any()
        for rows, q in self.blocks:
            kth = need[rows]
            own = self.ids[rows, None] == ids if low and (kth == LEAST).any() else None
            i, j, s = pair_scores(q, c, kth, self.k, own, pairs=True)
            if len(i):
                got.append((i + rows.start, j, s))
                held += len(i)
            if got and (held >= HITS or q is self.blocks[-1][1]):  # sorted once for many blocks
                i, j, s = (np.concatenate(x) for x in zip(*got))
                other = ids[j] != self.ids[i]
                self.best.add(i[other], s[other], ids[j[other]])
                got, held = [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 1 << 14):
            real = np.arange(self.k) < self.best.have[a:a + (1 << 14), None]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(self.ids[a:a + (1 << 14)], real.sum(1)), pa.int64()),
                "vec_id": pa.array(self.best.ids[a:a + (1 << 14)][real], pa.int64()),
                "score": pa.array(self.best.scores[a:a + (1 << 14)][real], pa.int64())})


def _search(k: int):
    """Rows (part, kind, dim, vec_id, cols), sorted so: a part's queries (kind 0), then its candidates."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, ready, dim, left = None, {}, {}, None, []  # left: candidates that don't fill a block yet

        def meet(last: bool) -> None:
            nonlocal left
            if not left:
                return
            q = ready[dim]
            ids, mat = (np.concatenate(x) for x in zip(*left))
            a = 0
            while len(ids) - a >= q.size() or last and a < len(ids):
                z = a + q.size()
                q.meet(ids[a:z], mat[a:z])
                a = z
            left = [(ids[a:], mat[a:])] if a < len(ids) else []

        for b in batches:
            part, kind, width, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            same = (part[1:] == part[:-1]) & (kind[1:] == kind[:-1]) & (width[1:] == width[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if now != part[a]:
                    meet(True)
                    for q in ready.values():
                        yield from q.found()
                    now, asked, ready, dim = part[a], {}, {}, None
                w = int(width[a])
                rows = ids[a:z].copy(), _unpacked(w, b.column(4).slice(a, z - a)).copy()
                if kind[a] == 0:
                    asked.setdefault(w, []).append(rows)
                    continue
                if dim != w:
                    meet(True)
                    dim = w
                    if w in asked:
                        ready[w] = _Queries(*(np.concatenate(x) for x in zip(*asked.pop(w))), k)
                if w in ready:
                    left.append(rows)
                    if sum(len(x[0]) for x in left) >= ready[w].size():
                        meet(False)
        meet(True)
        for q in ready.values():
            yield from q.found()
    return search


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the usable vectors, components floor(scale * x)."""
    given = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    return given.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(
        _floors(scale), "vec_id long, v array<double>")


def dealt(queries: DataFrame, candidates: DataFrame, groups: int, shares: int) -> DataFrame:
    """What the tasks read, both frames as ``_VECTOR``: each query once for every share, each
    candidate once for every group of queries, a part's queries before its candidates."""
    def spread(to: int, *by: str):
        return F.pmod(F.xxhash64(*by), F.lit(to)).cast("int")

    q = queries.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
        (spread(groups, "vec_id") * shares + F.col("_share")).alias("part"), F.lit(0).alias("kind"), "dim", "vec_id", "cols")
    c = candidates.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        (F.col("_group") * shares + spread(shares, "vec_id", "cols")).alias("part"), F.lit(1).alias("kind"), "dim", "vec_id", "cols")
    return q.union(c).repartitionById(groups * shares, F.col("part")).sortWithinPartitions("part", "kind", "dim", "vec_id")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, groups: int) -> DataFrame:
    """Each query's ``k`` best candidates; both frames are (vec_id, v array<double> of whole
    numbers). ``groups``: how many shares the candidates are dealt to, or fewer (every query
    brings k rows out of each share)."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_pack, _VECTOR).checkpoint()
    held = asked.agg(F.sum(4 * (F.col("dim").cast("long") + 2))).first()[0] or 0
    many = max(1, -(-held // QUERY_BYTES))
    shares = min(groups, max(SHARES, -(-TASKS * spark.sparkContext.defaultParallelism // many)))
    met = dealt(asked, candidates.mapInArrow(_pack, _VECTOR), many, shares)
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for every row whose id is divisible by 50."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = whole_numbers(e.filter(F.col("vec_id").cast("long") % 50 == 0), "vec_id", "embedding")
    return top_k(asked, whole_numbers(e, "vec_id", "embedding"), 5, groups)


_ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 5"""

QUERIES = {"op9_topk_search": op9_topk_search}
ORACLES = {"op9_topk_search": _ORACLE}
