"""The distributed tree and its witnesses against a plain one on one machine."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from reelhouse import llm
from reelhouse.llm import merkle_manifest as M

from ..conftest import SF_SMALL


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves, fan=3):
    """(root, per leaf: siblings of each level with the place)."""
    level, at, found = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for leaf, i in enumerate(at):
            run = runs[i // fan]
            found[leaf].append((i % fan, [d for j, d in enumerate(run) if j != i % fan]))
            at[leaf] = i // fan
        level = [_h(*r) for r in runs]
    return level[0], found


def _plain(rows, fan=3):
    """(source, order, leaf) -> sorted [(leaf, subroot, root, witness levels)]."""
    groups = {}
    for s, o, d in rows:
        groups.setdefault(s, []).append(((o is not None, o or 0), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s]), *_tree([d for _, d in sorted(groups[s])], fan)) for s in names}
    root, over = _tree([trees[s][1] for s in names], fan)
    return sorted((d, trees[s][1], root, repr(w + over[i])) for i, s in enumerate(names)
                  for (_, d), w in zip(trees[s][0], trees[s][2]))


def _got(df):
    return sorted((r.leaf, r.subroot, r.root, repr([(p, [x.hex() for x in o]) for p, o in M.levels(r.witness)]))
                  for r in df.collect())


def _leaves(spark, rows):
    return spark.createDataFrame(rows, "source string, o long, digest string")


@pytest.mark.parametrize("fan,height", [(3, 1), (3, 7), (2, 2), (5, 1)])
def test_trees_of_all_sizes(spark, fan, height):
    """Small blocks: block roots are appended over several layers."""
    rows = [(f"s{n:02d}", i, _h(f"{n}.{i}")) for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 61) for i in range(n)]
    assert _got(M.witnesses(_leaves(spark, rows), "source", "o", "digest", fan=fan, height=height)) == _plain(rows, fan)


def test_one_hot_group_and_odd_rows(spark):
    rows = [("hot", i, _h(str(i))) for i in range(700)]
    rows += [(None, 5, _h("n")), ("", 1, _h("e")), ("é", 1, _h("x")), ("z", None, _h("y")), ("z", 3, _h("a")), ("z", 3, _h("a")), ("z", 3, _h("b"))]
    rows += [("\U0001f600", 1, _h("q")), ("￮", 1, _h("r"))]  # bytewise, not by UTF-16 units
    df = _leaves(spark, rows).withColumn("pos2", F.lit(1)).withColumn("g", F.lit("x")).withColumn("c0", F.lit("y"))
    out = M.witnesses(df, "source", "o", "digest", carry=("g", "c0", "o"), height=2)
    assert _got(out) == _plain(rows) and {(r.g, r.c0) for r in out.collect()} == {("x", "y")}
    with pytest.raises(ValueError):
        M.witnesses(df.withColumn("pos", F.lit(1)), "source", "o", "digest", carry=("pos",))


def test_lone_leaf_lone_groups_and_none(spark):
    assert _got(M.witnesses(_leaves(spark, [("a", 1, _h("1"))]), "source", "o", "digest")) == [(_h("1"), _h("1"), _h("1"), "[]")]
    rows = [(f"g{i}", 1, _h(str(i))) for i in range(40)]
    assert _got(M.witnesses(_leaves(spark, rows), "source", "o", "digest", height=1)) == _plain(rows)
    assert M.witnesses(_leaves(spark, rows).limit(0), "source", "o", "digest").count() == 0


def test_append_extends_witnesses_of_open_subtrees():
    """After each append, leaves hold just the siblings of the runs completed so far."""
    tree, ds = M.Appender(3, None, True), [hashlib.sha256(bytes([i])).digest() for i in range(10)]
    for i, d in enumerate(ds):
        tree.append(d)
        done = i + 1
        for leaf in range(done):
            full = sum(1 for level in range(1, 3) if (leaf // 3 ** level + 1) * 3 ** level <= done)
            assert len(tree.parts[leaf]) == full
    root, parts = tree.finish()
    assert all(M.fold(d, w) == root for d, w in zip(ds, parts))
    assert M.fold(ds[1], parts[0]) != root


def test_query_equals_plain_trees(spark):
    def leaf(r, text):
        cols = (r.doc_id, r.source, r.lang, r.n_chars, text)
        return _h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cols))

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {d: rest for d, *rest in _plain([(r.source, r.doc_id, leaf(r, r.text)) for r in docs])}
    got = llm.queries()["op13_merkle_manifest"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in docs}
    for r in got:
        d = by_id[r.doc_id]
        subroot, root, w = want[leaf(d, d.text)]
        shown = (d.text or "").replace("\n", "") if d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 2 == 0 else d.text
        top = leaf(d, shown)
        for place, others in eval(w):
            top = _h(*others[:place], top, *others[place:])
        proof = _h(*(x for _, others in eval(w) for x in others))
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == \
            (leaf(d, d.text), subroot, root, proof, top, top == root)
    assert 0 < sum(r.verified for r in got) < len(got)
