"""Arrow string columns as flat numpy arrays: word bounds, line bounds and
rolling fingerprints, computed for a chunk of documents at once.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never
uses those bytes inside a character, so bytes and characters agree.
Fingerprints are polynomials modulo 2**64 over random byte values, mixed by a
bijection. ``f(i, j) = (P[j] - P[i]) * B**-i`` does not depend on where the
span stands, so equal spans get equal fingerprints in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once; a single longer document is one chunk.
CHUNK_BYTES = 1 << 19
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B**0 .. B**(n-1) (or of the inverse) modulo 2**64, kept between calls."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, _INV if inverse else BASE, dtype=np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Fingerprints of any span of a sequence of uint64 values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])
        self.inv = powers(n + 1, inverse=True)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def windows(self, k: int) -> np.ndarray:
        """Fingerprints of all windows of k values."""
        if len(self.sums) <= k:
            return np.zeros(0, dtype=np.uint64)
        d = self.sums[k:] - self.sums[:-k]
        return mix(d * self.inv[: len(d)])


class Chunk:
    """Some documents: their bytes end to end and ``off`` (n + 1 offsets)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, rows: slice):
        self.data, self.off, self.rows = data, off, rows
        self.n = len(off) - 1

    def words(self) -> None:
        """Sets ``ws``/``we`` (word bounds), ``wdoc`` and ``woff`` (words of
        document d: woff[d] to woff[d + 1])."""
        n = len(self.data)
        space = _SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.ws = np.flatnonzero(~space & (before | cut[:n]))
        self.we = np.flatnonzero(~space & (after | cut[1:])) + 1
        self.woff = np.searchsorted(self.ws, self.off)
        self.wdoc = np.repeat(np.arange(self.n), np.diff(self.woff))

    def byte_rolling(self) -> Rolling:
        return Rolling(_TABLE[self.data])

    def word_hashes(self, rolling: Rolling | None = None) -> np.ndarray:
        return (rolling or self.byte_rolling()).spans(self.ws, self.we)


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole documents, in order; a null text counts as empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for part in parts:
        if part.null_count:
            part = part.fill_null("")
        if len(part) == 0:
            continue
        wide = pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type)
        _, obuf, dbuf = part.buffers()
        off = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32)[part.offset: part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, np.uint8)
        i, n = 0, len(part)
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(n, max(i + 1, j))
            yield Chunk(data[off[i]:off[j]], off[i:j + 1] - off[i], slice(base + i, base + j))
            i = j
        base += n


def per_doc_sum(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over off[d]:off[d+1] for each document."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def repeated_in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where (doc, h) occurs more than once."""
    return repeat_ranks(h, doc)[0]


def repeat_ranks(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs more than once, occurs earlier) of each (doc, h), in the given
    order of the entries of a document."""
    n = len(h)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    key = h ^ mix(doc.astype(np.uint64) + U(1))
    order = np.argsort(key, kind="stable")
    k, d, hh = key[order], doc[order], h[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (hh[1:] == hh[:-1])
    many, later = np.empty(n, bool), np.empty(n, bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True at each of n places that a window [s, s + width) covers."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1))
    ends = starts + width
    d -= np.bincount(ends, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def minimizers(h: np.ndarray, group: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: (place of the leftmost smallest hash in each run of w
    consecutive entries of one group, run starts). Equal runs choose the same
    offset wherever they stand."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sparse table: leftmost minimum of 2**j entries, doubled until w is covered
    at = np.arange(n)
    span = 1
    while span * 2 <= w:
        a, b = at[:-span], at[span:]
        at = np.where(h[b] < h[a], b, a)
        span *= 2
    m = n - w + 1
    a, b = at[:m], at[w - span:w - span + m]
    at = np.where(h[b] < h[a], b, a)
    ok = group[:m] == group[w - 1:]
    return at[ok], np.flatnonzero(ok)


def columns(df, *names: str):
    """The named columns, ids as bigint and the rest as strings; one that the input
    lacks is null."""
    from pyspark.sql import functions as F
    have = set(df.columns)
    kind = {n: "bigint" if n.endswith("_id") else "string" for n in names}
    return [(F.col(f"`{n}`") if n in have else F.lit(None)).cast(kind[n]).alias(n) for n in names]


def strip_columns(df, *names: str):
    """The named columns only (see ``columns``)."""
    return df.select(*columns(df, *names))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[97:123] = True
_TOKEN[128:] = True


class Tokens:
    """Folded tokens of a chunk: maximal runs of letters, digits and bytes
    beyond ASCII, ASCII capitals lowered. ``h`` their fingerprints, ``doc``
    their document, ``off`` the tokens of each document, ``s``/``e`` bounds."""

    def __init__(self, c: Chunk):
        low = _FOLD[c.data]
        n = len(low)
        is_t = np.zeros(n + 2, bool)
        is_t[1:-1] = _TOKEN[low]
        cut = np.zeros(n + 1, bool)
        cut[c.off] = True
        self.s = np.flatnonzero(is_t[1:] & (~is_t[:-1] | cut))
        self.e = np.flatnonzero(is_t[:-1] & (~is_t[1:] | cut))
        self.h = Rolling(_TABLE[low]).spans(self.s, self.e)
        self.off = np.searchsorted(self.s, c.off)
        self.doc = np.repeat(np.arange(c.n), np.diff(self.off))
