"""Exact search against all pairs: groups, shares, blocks, ties, odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelhouse.llm import topk_search

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _best(queries, candidates, k):
    """{query id: [(score, id)]} over all pairs of equal length."""
    asked = {}
    for i, v in queries:
        asked[i] = min(asked.get(i, v), v)
    out = {}
    for i, q in asked.items():
        s = [(-max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(q, v)))), j) for j, v in candidates if j != i and len(v) == len(q)]
        out[i] = [(-a, j) for a, j in sorted(s)[:k]]
    return {i: x for i, x in out.items() if x}


def _by_query(rows):
    out = {}
    for i, rank, j, s in sorted(rows):
        out.setdefault(i, []).append((s, j))
        assert rank == len(out[i])
    return out


def _odd(rng):
    """Vectors of three lengths with copies, repeated ids, and some too long for small or for all floats."""
    some = [(i, [float(x) for x in rng.integers(-40, 40, rng.choice([1, 20, 64]))]) for i in range(300)]
    some += [(i + 1000, v) for i, v in some[:60]] + [(i + 2000, v) for i, v in some[:60]] + some[:30]  # copies; repeated rows
    some += [(i, [float(x) for x in rng.integers(-40, 40, 20)]) for i in range(0, 40, 2)]  # repeated ids, other vectors
    some += [(3000 + i, [float(x) for x in rng.integers(-40_000, 40_000, 64)]) for i in range(20)]
    return some + [(4000 + i, [float(2 ** int(e)) for e in rng.integers(20, 45, 20)]) for i in range(10)]


@pytest.mark.parametrize("query_bytes", [1 << 30, 4 * 66 * 20])
def test_search_equals_all_pairs(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(topk_search, "QUERY_BYTES", query_bytes)
    vectors = _odd(np.random.default_rng(4))
    queries = [(i, v) for i, v in vectors if i % 3 == 0]
    q, c = (spark.createDataFrame(x, "vec_id long, v array<double>").repartition(5) for x in (queries, vectors))
    got = topk_search.top_k(q, c, 4, 6).collect()
    assert _by_query(map(tuple, got)) == _best(queries, vectors, 4)


def test_search_deals_single_vectors(spark):
    """No row holds a pair of blocks: each vector travels alone, to as many tasks as its kind needs."""
    vectors = [(i, [float(i), 1.0]) for i in range(200)]
    v = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    assert "Join" not in topk_search.top_k(v.filter("vec_id < 50"), v, 3, 8)._jdf.queryExecution().optimizedPlan().toString()
    packed = v.mapInArrow(topk_search._pack, topk_search._VECTOR)
    met = topk_search.dealt(packed.filter("vec_id < 50"), packed, 2, 8)
    assert [tuple(r) for r in met.groupBy("kind").agg(F.count("*"), F.max(F.length("cols"))).orderBy("kind").collect()] == [(0, 50 * 8, 4), (1, 200 * 2, 4)]
    at = met.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("part").alias("n")).collect()
    assert len(at) == 16 and {r.n for r in at} == {1}


def _run(queries, candidates, k, size=700):
    """The task's search over rows as they come to it, in batches of ``size``."""
    rows = []
    for kind, side in enumerate((queries, candidates)):
        for ids, mat in side:
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * mat.shape[1], pa.int32()), pa.array(mat.astype(float).ravel()))
            packed = pa.Table.from_batches(list(topk_search._pack([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), v], ["vec_id", "v"])])))
            packed = packed.add_column(0, "kind", pa.array([kind] * len(packed), pa.int32())).add_column(0, "part", pa.array([0] * len(packed), pa.int32()))
            rows.append(packed.sort_by("vec_id"))
    table = pa.concat_tables(rows).combine_chunks()
    out = [x for b in topk_search._search(k)(table.to_batches(max_chunksize=size)) for x in b.to_pylist()]
    return {i: [(x["score"], x["vec_id"]) for x in out if x["query_id"] == i] for i in {x["query_id"] for x in out}}


@pytest.mark.parametrize("kind", ["even", "leading", "copies"])
def test_task_prunes_exactly(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9_000, 64))
    if kind == "leading":
        x *= np.linspace(2, 0.05, 64) ** 2
    if kind == "copies":
        x = x[rng.integers(0, 40, len(x))]
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 256)
    got = _run([(np.arange(0, 9_000, 30), x[::30])], [(np.arange(9_000), x)], 5)
    scores = (x[::30] @ x.T).astype(np.int64)
    scores[np.arange(300), np.arange(0, 9_000, 30)] = LEAST
    for i in range(300):
        o = np.lexsort((np.arange(9_000), -scores[i].astype(float)))[:5]
        assert got[30 * i] == [(scores[i, j], j) for j in o]


def test_survivors_alone_get_later_slabs():
    """Where leading dimensions tell, the first run of slabs is short and drops most candidates."""
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(40_000, 64)) * np.linspace(8, 0.1, 64) ** 2)
    q = topk_search._Queries(np.arange(64), x[:64], 5)
    for a in range(0, len(x), 2048):
        q.meet(np.arange(a, min(a + 2048, len(x))), x[a:a + 2048])
    for _, b in q.blocks:
        b.met = 1  # due to choose again
    q.meet(np.arange(50_000, 52_048), x[:2048])
    assert max(b.head for _, b in q.blocks) <= 32


def test_copies_that_come_later_are_dropped():
    """A tie of a larger id doesn't count, so masses of copies don't pass again and again."""
    one = np.full((2048, 16), 3.0)
    q = topk_search._Queries(np.arange(10), one[:10], 5)
    q.meet(np.arange(2048), one)
    for rows, b in q.blocks:
        i, j, s = topk_search.pair_scores(b, topk_search.Block(one.T), q.best.need()[rows], 5, None, pairs=True)
        assert not len(i) and not len(j) and not len(s)
    assert q.best.ids.tolist() == [[j for j in range(6) if j != i][:5] for i in q.ids]


def test_pairs_are_the_scores_that_reach():
    rng = np.random.default_rng(8)
    for scale in (40, 40_000, 1 << 26):  # products in 4 and 8 bytes, and beyond what these hold
        c, q = (np.floor(rng.normal(size=(64, n)) * scale) for n in (500, 20))
        full = (q.T @ c) if scale < 1 << 26 else (q.astype(object).T @ c.astype(object))
        kth = np.sort(full.astype(float), axis=1)[:, -7].astype(np.int64)
        alive, s = topk_search.pair_scores(q, c, kth, 5, None)
        i, j, p = topk_search.pair_scores(q, c, kth, 5, None, pairs=True)
        assert {(a, b, int(x)) for a, b, x in zip(i, j, p)} == {(a, b, int(full[a, b])) for a in range(20) for b in range(500) if int(full[a, b]) >= kth[a]}
        assert set(j) <= set(alive) and s.shape == (20, len(alive))


@pytest.mark.parametrize("n, m", [(1, 1), (1, 3), (3, 1), (300, 2), (2, 300)])
def test_few_vectors(monkeypatch, n, m):
    monkeypatch.setattr(topk_search, "_SCRATCH", {})
    x = np.random.default_rng(n * m).integers(-9, 9, (n + m, 20)).astype(float)
    queries, candidates = [(i, list(v)) for i, v in enumerate(x[:n])], [(i + 1, list(v)) for i, v in enumerate(x[n:])]
    got = _run([(np.arange(n), x[:n])], [(np.arange(m) + 1, x[n:])], 4)
    assert {i: v for i, v in got.items() if v} == _best(queries, candidates, 4)


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [0.5, -0.25]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, float("inf")]), (None, [1.0, 1.0]),
            (7, [-0.001, 1e300]), (8, [1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    got = {r.vec_id: list(r.v) for r in topk_search.whole_numbers(df, "id", "e").collect()}
    assert got == {1: [128.0, -64.0], 7: [-1.0, 2.0 ** 63], 8: [256.0]}
    none = topk_search.whole_numbers(df.filter("id = 2"), "id", "e")
    assert topk_search.top_k(none, topk_search.whole_numbers(df, "id", "e"), 5, 4).count() == 0
    assert topk_search.top_k(topk_search.whole_numbers(df, "id", "e"), none, 5, 4).count() == 0
