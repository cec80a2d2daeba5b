"""Vectorised text kernels over Arrow buffers, shared by the corpus operators.

A *word* is a maximal run of bytes other than the six ASCII white-space bytes, taken after Unicode lower-casing;
a document never shares a word with its neighbour in the batch. Everything works on whole texts: batches are cut
into row slices of a few megabytes so that the temporaries stay in cache, a longer single text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = " \t\n\r\f\x0b"
#: The same words as a regular expression, for Spark and for SQL.
WORD = "[^ \\t\\n\\r\\f\\x0B]+"

_U = np.uint64
_rng = np.random.default_rng(0x7E55E2A)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE.encode())] = True


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        inv = int(pow(int(base), -1, 1 << 64))
        self.base, self.inverse = base, _U(inv)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            out = []
            for b in (self.base, self.inverse):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out
        return self.up, self.down


_PP, _QP = _Powers(_P), _Powers(_Q)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Words:
    """All words of some texts: 64-bit hash, byte range in `data`, and for each text its range of words."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and their offsets; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """What `token_hashes` needs of some bytes, for callers that hash them more than once."""
    n = len(data)
    up, _ = _PP.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return sums


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    sums = byte_sums(data) if sums is None else sums
    _, down = _PP.upto(len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start])


def split(data: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where `gap` is false, cut at the texts' bounds."""
    n = len(data)
    before = np.ones(n + 1, bool)
    before[1:] = gap
    before[offs] = True
    after = np.ones(n + 1, bool)
    after[:n] = gap
    after[offs] = True
    full = ~gap
    return np.flatnonzero(full & before[:n]), np.flatnonzero(full & after[1:]) + 1


def words(texts: pa.Array, lower: bool = True) -> Words:
    if lower:
        texts = pc.utf8_lower(texts.cast(pa.large_string()))
    data, offs = flat(texts)
    start, end = split(data, offs, _SPACE[data])
    return Words(data, token_hashes(data, start, end), start, end, np.searchsorted(start, offs))


def range_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each run h[lo:hi]; equal runs have equal hashes wherever they stand."""
    n = len(h)
    up, down = _QP.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the word at which each begins."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(w.offsets[1:], w.counts)  # where the word's text ends
    at = np.flatnonzero(left - np.arange(total) >= n)
    return range_hashes(w.hash, at, at + n), at


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text, or of one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(h.view(np.int64) if h.dtype == np.uint64 else h)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)
