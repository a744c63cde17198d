"""Encoding by backtracking against the library and against merging whole texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelhouse import llm
from reelhouse.llm import piece_codec

from ..conftest import SF_SMALL


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec()


def _ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def _made_texts(codec, n):
    rng = random.Random(3)
    pieces = [p.replace(piece_codec.SPACE, " ") for p in codec.ids]
    letters = sorted(codec.alphabet)
    for k in range(n):
        yield ["".join(rng.choices(pieces, k=rng.randint(1, 25))),
               "".join(rng.choices(" ab e\n\tthing\r", k=rng.randint(0, 60))),
               "".join(rng.choices(letters, k=rng.randint(1, 30))),
               "".join(chr(rng.randrange(0, 0xD000)) for _ in range(20)),
               " " * rng.randint(0, 40) + "a" + " " * rng.randint(0, 70) + rng.choice(pieces),
               rng.choice("aAx01.=-_ ▁") * rng.randint(1, 300) + "\x00\U0001f600"][k % 6]


def test_ids_equal_the_library(codec):
    for text in _made_texts(codec, 6000):
        assert _ids(codec.encode(text)) == codec.library.encode(text), text


def test_ids_equal_merging_the_whole_text(codec):
    """Brute force of the definition, without cuts, automaton or memory."""
    for text in _made_texts(codec, 600):
        whole = codec.merge(codec.library.normalize(text))
        want = []
        for p in whole:
            want += [codec.ids[p]] if p in codec.ids else [codec.byte_ids[b] for b in p.encode()]
        assert _ids(codec.encode(text)) == want, text


def test_backtracking_takes_back_and_marks(codec):
    """Longest pieces first are wrong for many texts; those need the way back."""
    undone = 0
    for p in list(codec.ids)[:6000]:
        for q in ("ing", "▁the", "er"):
            run = p + q
            greedy, at = [], 0
            while at < len(run):
                size = max(n for n in range(1, len(run) - at + 1) if run[at:at + n] in codec.ids)
                greedy.append(run[at:at + size])
                at += size
            got = [codec.pieces[i] for i in codec.backtrack(run)]
            assert got == codec.merge(run)
            undone += got != greedy
    assert undone > 100


def test_long_runs_without_cuts(codec):
    for text in ("x" * 60_000, "1" * 60_000, "abcdefgh" * 8_000, "中文字" * 20_000, " " * 60_000, "ab " * 60_000):
        assert _ids(codec.encode(text)) == codec.library.encode(text)


def test_memory_bounds_do_not_change_results(codec, monkeypatch):
    texts = list(_made_texts(codec, 300))
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(piece_codec, "MEMO_PARTS", 3)
    monkeypatch.setattr(piece_codec, "MEMO_PAIRS", 3)
    codec.parts.clear(), codec.pairs.clear()
    assert [codec.encode(t) for t in texts] == want


def test_rows_and_odd_cases(spark, codec):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "same"), (4, " two  words \n"), (5, "y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    out = piece_codec.encode(docs).collect()
    assert sorted((repr(r.doc_id), _ids(r.ids)) for r in out) == sorted((repr(i), [1, *codec.library.encode(t or ""), 2]) for i, t in rows)
    assert all(r.n_tokens == len(_ids(r.ids)) for r in out)
    bare = piece_codec.encode(docs, begin=False, end=False)
    back = {(r.doc_id, r.decoded) for r in piece_codec.decode(bare, into="decoded").collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert piece_codec.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        piece_codec.encode(docs, keep=("doc_id", "ids"))


def test_other_kinds_of_model_are_refused(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "MERGE_TYPE", 1)
    with pytest.raises(ValueError):
        piece_codec.Codec()


def test_query_equals_the_library(spark, codec):
    got = {tuple(r) for r in llm.queries()["op11_piece_codec"](spark, SF_SMALL).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = codec.library.encode(r.text or "", add_bos=True, add_eos=True)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()))
    assert got == want
