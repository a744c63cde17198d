"""Words of whole texts as flat numpy arrays, hashed without a Python loop over words.

A task sees Arrow batches; ``pieces`` cuts a batch into runs of whole documents of about
``CHUNK_BYTES``, so the work arrays stay small however long the batch is. A single longer
text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


mix64 = _mix

#: Word bytes: everything but the six ASCII white-space bytes ...
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ... or ASCII letters and digits and every byte of a non-ASCII character.
WORDISH = np.zeros(256, bool)
WORDISH[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _byte_values(seed: int) -> np.ndarray:
    return _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(seed))


_VALUES = tuple(_byte_values(b ^ 0x5851F42D4C957F2D) for b in _BASES)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Words:
    """Words of some documents laid end to end: byte span and document of each word."""

    data: bytes          # the texts, joined by one space
    start: np.ndarray    # first byte of each word in ``data``
    end: np.ndarray      # one past its last byte
    doc: np.ndarray      # index of its document in the run
    first: np.ndarray    # per document: index of its first word; one more entry at the end
    h: tuple[np.ndarray, ...]  # one or two independent 64-bit hashes of each word

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]]


def split_words(texts: list[bytes | None], kind: np.ndarray = NOT_SPACE, lower: bool = False,
                hashes: int = 2) -> Words:
    """Words of ``texts`` (None: none); ``kind`` marks the bytes of words."""
    texts = [t or b"" for t in texts]
    data = b" ".join(texts)
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
        data = raw.tobytes()
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate(([0], np.cumsum(lens + 1)))  # byte where each document begins
    is_word = kind[raw]
    edge = np.diff(is_word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, offset)
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    hs = []
    if len(start):
        length = end - start
        at = np.flatnonzero(is_word)
        place = at - np.repeat(start, length)
        head = np.concatenate(([0], np.cumsum(length)[:-1]))
        b = raw[at]
        for values, base in list(zip(_VALUES, _BASES))[:hashes]:
            pw = _powers(base, int(length.max()))
            hs.append(_mix(np.add.reduceat(values[b] * pw[place], head) + length.astype(np.uint64)))
    else:
        hs = [np.empty(0, np.uint64)] * hashes
    return Words(data, start, end, doc, first, tuple(hs))


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (by doubling; not across the end)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base = 0xA0761D6478BD642F
    sums, size, have, out, done = h, 1, n, None, 0
    while have:
        if have & 1:
            # ``out`` covers the first ``done`` words, ``sums`` the next ``size``
            if out is None:
                out, done = sums, size
            else:
                k = len(sums) - done
                out = out[:k] * _U(pow(base, size, 1 << 64)) + sums[done:done + k]
                done += size
        have >>= 1
        if have:
            sums = sums[:-size] * _U(pow(base, size, 1 << 64)) + sums[size:]
            size *= 2
    return _mix(out[:len(h) - n + 1] + _U(n))


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions whose ``n`` consecutive words lie in one document."""
    k = len(doc) - n + 1
    if k <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(doc[:k] == doc[n - 1:])


def pieces(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def slices(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of an Arrow string column, about ``limit`` bytes of text each."""
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    if not len(size):
        return
    edge = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1))
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(size)])


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes (None for null)."""
    import pyarrow as pa
    return column.cast(pa.binary()).to_pylist()
