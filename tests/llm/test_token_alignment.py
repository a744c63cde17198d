"""Alignment against the named tokenizers and sets of byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelhouse.llm import token_alignment as T

from ..conftest import SF_SMALL


def _tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _byte_level():
    """The public byte-to-character map of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def plain():
    a_tok, b_tok = _tokenizers()
    of = _byte_level()

    def tokens(text):
        if not text:
            return [], []
        want = b" " + text.encode()
        a = [(i, bytes(of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in b_tok.encode(text):
            p = b_tok.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            return [], []
        return a, b

    def result(texts):
        rows, counts = [], Counter()
        for text in texts:
            sides = tokens(text)
            ends = [np.cumsum([len(t) for _, t in s]).tolist() for s in sides]
            links = [(i, j) for i, x in enumerate(ends[0]) for j in [np.searchsorted(ends[1], x)] if ends[1][j] == x]
            counts.update((sides[0][i][0], sides[1][j][0]) for i, j in links)
            rows.append((sides, links))
        most = {}
        for (a, b), n in counts.items():
            most[b] = max(most.get(b, 0), n)
        out = []
        for (a, b), links in rows:
            groups, s, u = [], 0, 0
            for i, j in links:
                groups.append(",".join(str(x) for x, _ in a[s:i + 1]) + "|" + ",".join(str(x) for x, _ in b[u:j + 1]))
                s, u = i + 1, j + 1
            ids = [(a[i][0], b[j][0]) for i, j in links]
            out.append((len(a), len(b), len(links), len(links), sum(counts[p] == most[p[1]] for p in ids), sum(counts[p] for p in ids),
                        hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        return out
    return result


ODD = [None, "", " ", "a", " two  spaces\n\tand more ", "▁ not a space", "<|endoftext|> and <s> </s> <0x41> are text", "x" * 20_000,
       "1234567890" * 2_000, "中文字符🙂🙂" * 500, "été à côté", "\x00\x01", "same text", "same text", "aaaa bbbb " * 3_000]


def _run(spark, d, **kw):
    out = T.op12_token_alignment(spark, d, **kw)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r[0], tuple(r[1:])) for r in out.collect()), key=repr)


@pytest.mark.parametrize("common", [T.COMMON, 40])
def test_odd_texts(spark, plain, tmp_path, common):
    """Also with few pairs common, or none: the others' counts come by the join."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "another text of the same id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("pairs", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(zip([i for i, _ in rows], plain([t for _, t in rows])), key=repr)
    assert _run(spark, str(tmp_path), common=common) == want


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert _run(spark, str(tmp_path)) == []


def test_query_equals_plain(spark, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(zip([r.doc_id for r in docs], plain([r.text for r in docs])), key=repr)
    assert _run(spark, SF_SMALL) == want


def test_cuts_of_random_ends():
    """Many documents at once, some without any cut inside."""
    rng = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9):
        a, b, last, base = [], [], [], 0
        for _ in range(60):
            size = int(rng.integers(1, 400))
            inner = np.arange(1, size)
            x, y = inner[rng.random(size - 1) < share], inner[rng.random(size - 1) < 0.5]
            if rng.random() < 0.3:
                y = np.setdiff1d(y, x)
            a += [*(base + x), base + size]
            b += [*(base + y), base + size]
            last.append(len(a) - 1)
            base += size
        a, b = np.array(a), np.array(b)
        assert T.shared_cuts(a, b, np.array(last)).tolist() == np.flatnonzero(np.isin(a, b)).tolist()


def test_kept_names_must_differ(spark):
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, a_ids long")
    with pytest.raises(ValueError):
        T.align(docs, keep=("a_ids",))
    assert T.align(docs).columns == ["doc_id", *T.ALIGNED]
