"""Column-wise construction of the BWT and LCP array of a collection, by sequential files.

After Bauer, Cox and Rosone (2013) and Cox, Garofalo, Rosone and Sciortino (2016). In round t the suffix of length t of
every string is inserted into the sorted list of all suffixes that are there: its place is given by its first symbol
c and by how many c the transform holds before the place of the suffix one shorter. A round reads the transform, the
common prefixes and the suffixes' names in order, twice, and writes them once with the new entries let in; memory holds a
block, the alphabet's counters and one number a string. Files stay in memory up to `SPOOL` bytes and go on in
the shared folder from there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs

BLOCK = 1 << 20
SPOOL = 1 << 26


def uri(folder: str) -> str:
    """The folder as Arrow names it: `file:/x` has an empty host there, and S3 one scheme."""
    if "://" in folder:
        return re.sub("^s3[an]://", "s3://", folder)
    return "file://" + folder.removeprefix("file:")


class Sequential:
    """Numbers that are written in order, then read in order; a file once there are too many."""

    def __init__(self, folder: str, dtype: type, spool: int = SPOOL) -> None:
        self.folder, self.dtype, self.spool = folder, np.dtype(dtype), spool
        self.parts: list[np.ndarray] = []
        self.held, self.stream, self.fs = 0, None, None

    def write(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        self.parts.append(values)
        self.held += values.nbytes
        if self.stream is not None or self.held > self.spool:
            self._spill()

    def _spill(self) -> None:
        if self.stream is None:
            self.fs, root = pafs.FileSystem.from_uri(uri(self.folder))
            self.fs.create_dir(root, recursive=True)
            self.path = f"{root}/bwt-{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.path)
        for p in self.parts:
            self.stream.write(p.tobytes())
        self.parts, self.held = [], 0

    def blocks(self) -> Iterator[np.ndarray]:
        if self.stream is None:
            whole = self.parts[0] if len(self.parts) == 1 else np.concatenate([np.zeros(0, self.dtype), *self.parts])
            for at in range(0, len(whole), BLOCK):
                yield whole[at : at + BLOCK]
            return
        if not self.stream.closed:
            self.stream.close()
        with self.fs.open_input_stream(self.path) as f:
            while data := f.read(BLOCK * self.dtype.itemsize):
                yield np.frombuffer(data, self.dtype)

    def drop(self) -> None:
        if self.stream is not None:
            if not self.stream.closed:
                self.stream.close()
            self.fs.delete_file(self.path)
        self.parts = []


class _Least:
    """Minimum of any range of an array."""

    def __init__(self, a: np.ndarray) -> None:
        self.levels = [a]
        k = 1
        while 2 * k <= len(a):
            p = self.levels[-1]
            self.levels.append(np.minimum(p[:-k], p[k:]))
            k *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both included."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k):
            w = k == level
            t = self.levels[level]
            out[w] = np.minimum(t[lo[w]], t[hi[w] - (1 << int(level)) + 1])
        return out


def build(symbols: np.ndarray, offsets: np.ndarray, alphabet: int, cap: int, folder: str, spool: int = SPOOL) -> tuple[Sequential, Sequential, Sequential]:
    """Files (symbol before the suffix, common prefix with the suffix before, string << 20 | length) in suffix order.

    symbols: 1 to alphabet of all strings one after another; 0 stands for a string's begin. cap bounds the prefixes kept.
    """
    m, sizes = len(offsets) - 1, np.diff(offsets)
    lcp_type = np.uint8 if cap < 250 else np.uint16
    top = np.iinfo(lcp_type).max

    def before(strings: np.ndarray, t: int) -> np.ndarray:
        at = offsets[strings + 1] - 1 - t
        return np.where(t < sizes[strings], symbols[np.maximum(at, 0)], 0) if len(symbols) else np.zeros(len(strings), np.uint16)

    def files() -> tuple[Sequential, Sequential, Sequential]:
        return Sequential(folder, np.uint16, spool), Sequential(folder, lcp_type, spool), Sequential(folder, np.int64, spool)

    everyone = np.arange(m)
    bwt, lcp, names = files()
    first = before(everyone, 0)
    bwt.write(first)
    lcp.write(np.zeros(m, lcp_type))
    names.write(everyone.astype(np.int64) << 20)
    counts = np.bincount(first, minlength=alphabet + 1)
    place, who = everyone.copy(), everyone.copy()
    for t in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[who] >= t
        place, who = place[live], who[live]
        start = m + np.concatenate([[0, 0], np.cumsum(counts[1:])])[: alphabet + 1]  # where suffixes that begin with a symbol start
        seen = np.zeros(alphabet + 1, np.int64)
        least = np.full(alphabet + 1, top, lcp_type)  # since the last occurrence of the symbol
        fresh = np.zeros(alphabet + 1, bool)  # whether that was inserted last round
        slots, prefix, old_slots, old_prefix = [], [], [], []
        base = 0
        for b, ls in zip(bwt.blocks(), lcp.blocks(), strict=True):
            n = len(b)
            mine = place[np.searchsorted(place, base) : np.searchsorted(place, base + n)] - base
            new = np.zeros(n, bool)
            new[mine] = True
            order = np.argsort(b, kind="stable")
            order = order[np.searchsorted(b[order], 1) :]
            sym = b[order]
            head = np.ones(len(order), bool)
            head[1:] = sym[1:] != sym[:-1]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            isnew = new[order]
            after = np.empty(len(order), bool)
            after[1:] = isnew[:-1]
            after[head] = fresh[sym[head]]
            ask = np.flatnonzero(isnew | after)
            if len(ask):
                c, q = sym[ask], order[ask]
                rank = seen[c] + ask - begin[ask]
                value = np.zeros(len(ask), np.int64)
                rmq = _Least(ls)
                inside = ~head[ask]
                value[inside] = 1 + rmq(order[ask[inside] - 1] + 1, q[inside]).astype(np.int64)
                across = ~inside & (seen[c] > 0)
                if across.any():
                    value[across] = 1 + np.minimum(least[c[across]], rmq(np.zeros(across.sum(), np.int64), q[across])).astype(np.int64)
                value = np.minimum(value, cap)
                slot = start[c] + rank
                yes = isnew[ask]
                back = np.argsort(q[yes])  # in the order of `mine`
                slots.append(slot[yes][back])
                prefix.append(value[yes][back])
                old_slots.append(slot[~yes])
                old_prefix.append(value[~yes])
            last = np.ones(len(order), bool)
            last[:-1] = head[1:]
            np.minimum(least, ls.min(initial=top), out=least)
            tail = np.minimum.accumulate(np.append(ls, top)[::-1])[::-1]
            least[sym[last]] = tail[order[last] + 1]
            fresh[sym[last]] = isnew[last]
            seen += np.bincount(sym, minlength=alphabet + 1)
            base += n
        none = np.zeros(0, np.int64)
        slots, prefix = np.concatenate(slots or [none]), np.concatenate(prefix or [none])
        order = np.argsort(slots)
        slots, prefix, who = slots[order], prefix[order], who[order]
        old_slots, old_prefix = np.concatenate(old_slots or [none]), np.concatenate(old_prefix or [none])
        order = np.argsort(old_slots)
        old_slots, old_prefix = old_slots[order], old_prefix[order]
        symbol, name = before(who, t), (who.astype(np.int64) << 20) | t
        gap = slots - np.arange(len(slots))  # old entries before each
        counts += np.bincount(symbol, minlength=alphabet + 1)
        out, base, total = files(), 0, base
        for b, ls, a in zip(bwt.blocks(), lcp.blocks(), names.blocks(), strict=True):
            lo, hi = np.searchsorted(gap, base), np.searchsorted(gap, base + len(b)) if base + len(b) < total else len(gap)
            at = slots[lo:hi] - base - lo
            keep = np.ones(len(b) + hi - lo, bool)
            keep[at] = False
            for f, had, add in zip(out, (b, ls, a), (symbol, prefix, name), strict=True):
                x = np.empty(len(keep), f.dtype)
                x[keep] = had
                x[at] = add[lo:hi]
                if f is out[1]:
                    u, v = np.searchsorted(old_slots, (base + lo, base + lo + len(keep)))
                    x[old_slots[u:v] - base - lo] = old_prefix[u:v]
                f.write(x)
            base += len(b)
        for f in (bwt, lcp, names):
            f.drop()
        bwt, lcp, names = out
        place = slots
    return bwt, lcp, names


def classes(lcp: Sequential, names: Sequential, least: int) -> Iterator[np.ndarray]:
    """Runs of suffixes that share a prefix of at least so many symbols, two suffixes or more, as arrays of names, many runs at once.

    Yields (names, run number) pairs of arrays; a run never spans two of them.
    """
    held_n, held_l = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for ls, ns in zip(lcp.blocks(), names.blocks(), strict=True):
        ns, ls = np.concatenate([held_n, ns]), np.concatenate([held_l, ls.astype(np.int64)])
        brk = np.flatnonzero(ls < least)
        cut = brk[-1] if len(brk) else 0
        yield _runs(ns[:cut], ls[:cut], least)
        held_n, held_l = ns[cut:], ls[cut:]
    yield _runs(held_n, held_l, least)


def _runs(ns: np.ndarray, ls: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(ns):
        return ns, ns
    run = np.cumsum(ls < least)
    many = np.bincount(run)[run] > 1
    return ns[many], run[many]
