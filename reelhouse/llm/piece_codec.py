"""Exact encoding and decoding with a merge-type (BPE) sentencepiece vocabulary.

A merge-type encoder joins the best-scored adjacent pair (ties: the leftmost) until no two
neighbours form a piece. Its result is the only sequence of pieces in which every two neighbours
are compatible, that is, merging their joined text from single characters gives the two pieces
back. So a text is encoded from left to right by backtracking: an Aho-Corasick pass finds the
longest piece at every position; the piece is taken if compatible with the one before it, else
the next shorter piece that starts there is tried; where none fits, the position is marked as
failed in a bitfield, no later attempt ends there, and the piece before it is taken back. What
stands on the stack is always the encoding of the text before it, so a mark holds for good and
every position is left at most once.

Where no piece holds two characters side by side, nothing merges across them: texts are cut there
(before white space, around characters outside the vocabulary), and parts that repeat are encoded
once per task. Characters outside the vocabulary become byte pieces. The library at the model's path gives the
model, its normalisation and the decoding.

Columns: ``ids`` holds the ids as little-endian unsigned 32-bit integers, the layout of token
files; ``n_tokens`` counts them.

Defined cases: null and empty texts have no ids but the begin and end ids asked for; rows that
repeat stay rows; an empty table gives an empty result; only the columns named in ``keep`` pass, so
other names can't clash (a name in ``keep`` that an output column has raises ValueError). A text is
worked on whole: the task holds some 30 times its size for it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

SPACE = "▁"
#: Parts that one task remembers, the longest of them, and the remembered pairs (memory, not results).
MEMO_PARTS, MEMO_CHARS, MEMO_PAIRS = 400_000, 48, 400_000
#: Fixed values of the public model format: kinds of pieces, the merge-type model.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGE_TYPE = 1, 2, 3, 6, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = raw[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield number, raw[at:at + size]
        at += size


class Codec:
    """The model at ``path`` (the installed public file by default)."""

    def __init__(self, path: str | None = None):
        import ahocorasick
        import public_tokenizers
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        kinds, model_type = [], 1
        for number, value in _fields(sp.serialized_model_proto()):
            if number == 1:
                kinds.append(dict(_fields(value)).get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
        if model_type != MERGE_TYPE or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type model without user-defined or unused pieces is needed")
        self.pieces = [sp.id_to_piece(i) for i in range(len(kinds))]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        bytes_ = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.byte_ids = [bytes_.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)] if bytes_ else None
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.packed = [struct.pack("<I", i) for i in range(len(kinds))]
        self.size = [len(p) for p in self.pieces]
        self.shorter = [0] * len(kinds)  # the next shorter piece that a piece starts with (0: none)
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, i)
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), 0)
        self.matches.make_automaton()
        # Parts: a run of spaces with what follows it, ended by control characters that no piece holds
        used = set().union(*self.ids)
        bare = "".join(re.escape(chr(i)) for i in range(32) if chr(i) not in used)
        by_space = not any(p[1] == SPACE != p[0] for p in self.inside)
        rest = f"[^{SPACE}{bare}]"
        self.split = re.compile(f"{SPACE}+{rest}*|{rest}+" + (f"|[{bare}]+" if bare else "") if by_space else r"(?s).+").findall
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}

    # ------------------------------------------------------------------ compatibility
    def merge(self, text: str) -> list[str]:
        """``text`` (the length of a piece or two) merged from its characters."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score),
                       default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` (0: the start) stays beside ``right`` when their text is merged anew."""
        pair = [self.pieces[i] for i in (left, right) if i]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merge("".join(pair)) == pair
        return known

    # ------------------------------------------------------------------ backtracking
    def backtrack(self, run: str) -> list[int]:
        """The ids of ``run``, all of whose characters are pieces."""
        n, size, shorter, pairs = len(run), self.size, self.shorter, self.pairs
        longest = [0] * (n + 1)
        for last, i in self.matches.iter(run):
            start = last - size[i] + 1
            if size[i] > size[longest[start]] or not longest[start]:
                longest[start] = i
        failed = bytearray(n // 8 + 1)
        taken: list[int] = []
        at, i, before = 0, longest[0], 0
        while at < n:
            while i:
                end = at + size[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(before << 32 | i)
                    if fits or fits is None and self._compatible(before, i):
                        break
                i = shorter[i]
            if i:
                taken.append(i)
                before, at = i, end
                i = longest[at]
            else:
                if not taken:
                    raise ValueError(f"no encoding of {run[:40]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                i = shorter[taken.pop()]
                at -= size[before]
                before = taken[-1] if taken else 0
        return taken

    def _cut(self, part: str) -> list[str]:
        """``part`` cut wherever no piece holds both neighbours."""
        edges = [0, *(i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.inside), len(part)]
        return [part[a:b] for a, b in zip(edges, edges[1:])]

    def _encode_part(self, part: str) -> bytes:
        if len(part) <= MEMO_CHARS and self.alphabet.issuperset(part):
            return b"".join([self.packed[i] for i in self.backtrack(part)])
        ids: list[int] = []
        for run in self._cut(part):
            if self.alphabet.issuperset(run):
                ids += self.backtrack(run)
            elif self.byte_ids is not None:
                ids += [self.byte_ids[b] for b in run.encode()]
            else:
                ids += [self.library.unk_id()] * len(run)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        out, parts = [], self.parts
        for part in self.split(self.library.normalize(text)):
            ids = parts.get(part)
            if ids is None:
                ids = self._encode_part(part)
                if len(part) <= MEMO_CHARS:
                    if len(parts) >= MEMO_PARTS:
                        parts.clear()
                    parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_CODECS: dict = {}


def codec(path: str | None = None) -> Codec:
    """The model at ``path``, once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _kept(docs: DataFrame, keep: tuple[str, ...], made: dict[str, str]) -> str:
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns named like the result's: {sorted(clash)}")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ", ".join(f"`{c}` {t}" for c, t in [*((c, types[c]) for c in keep), *made.items()])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", begin: bool = True, end: bool = True,
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the ids of each whole text: n_tokens long, ids binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        head = np.array([c.library.bos_id()] * begin, "<u4").tobytes()
        tail = np.array([c.library.eos_id()] * end, "<u4").tobytes()
        for b in batches:
            for lo, hi in slices(b.column(len(keep))):
                ids = [head + (c.encode(t) if t else b"") + tail for t in b.column(len(keep)).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    schema = _kept(docs, keep, {"n_tokens": "long", "ids": "binary"})
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", into: str = "text",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the text that the library gives for packed ids (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo, hi in slices(b.column(len(keep))):
                texts = [c.decode(x or b"") for x in b.column(len(keep)).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))),
                                                  pa.array(texts, pa.string())], names=[*keep, into])

    schema = _kept(encoded, keep, {into: "string"})
    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("ids")).mapInArrow(run, schema)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids, then decoded again; digests of both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs).withColumn("ids_sha256", F.sha2("ids", 256)), into="decoded", keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_piece_codec": op11_piece_codec}
ORACLES: dict[str, str] = {}
