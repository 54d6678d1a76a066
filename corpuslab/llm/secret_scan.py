"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored
at the hits only, then embedded checksums.

Base kinds (a match that is too short still uses up its text, then is dropped):

* ``assign``: a password-like name, ``:`` or ``=``, and a value of 6+ characters;
* ``access``: ``AKIA`` and 20+ characters in all;
* ``hex``: a run of 24+ characters of 0-9a-f (runs are found on the byte
  array; there is no keyword to look for).

Added by the method, each proven by the checksum that it carries:

* ``github``: ``ghp_`` / ``gho_`` / ``ghu_`` / ``ghs_`` / ``ghr_``, 30 base-62 characters and
  the CRC-32 of these in six base-62 digits;
* ``npm``: ``npm_``, the same layout.

All patterns are ASCII, so the scan runs on UTF-8 bytes and turns offsets into
code points at the end. Null texts count as empty; an empty text has no spans.
Overlapping spans of different kinds are all reported.
Repeated rows are scanned each for itself and very long texts whole; other columns,
whatever their names, are not read by the scan. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
# The contract's patterns.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
           "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
            "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github",
            "ghs_": "github", "ghr_": "github", "npm_": "npm"}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MASK = "[SECRET]"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_automaton = None


def automaton():
    """The keyword automaton, built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for w, kind in KEYWORDS.items():
            a.add_word(w, (len(w), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def checksum62(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS62[r] + out
    return out.encode()


def hex_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of hex characters of MIN_HEX or more, never across documents."""
    n = len(data)
    m = np.zeros(n + 1, bool)
    m[:n] = _HEX[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev = np.zeros(n + 1, bool)
    prev[1:] = m[:-1]
    starts = np.flatnonzero(m & (~prev | first))
    ends = np.flatnonzero(prev & (~m | first))
    long = ends - starts >= MIN_HEX
    return starts[long], ends[long]


def scan_bytes(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every keyword-led span of one text, in bytes."""
    out, done = [], dict.fromkeys(KINDS, 0)
    for last, (size, kind) in automaton().iter(raw.lower().decode("latin-1")):
        at = last - size + 1
        if at < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, at)
            good = m and len(m[2]) >= MIN_ASSIGN
        elif kind == "access":
            m = ACCESS.match(raw, at)
            good = m and m.end() - at >= MIN_ACCESS
        else:
            m = CHECKED[kind].match(raw, at)
            good = m and checksum62(m[1]) == m[2]
        if m:
            done[kind] = m.end()
            if good:
                out.append((at, KINDS.index(kind), m.end()))
    return out


SCHEMA = "starts array<int>, ends array<int>, kinds array<int>"


def _scan_chunk(c: T.Chunk) -> list[list[tuple[int, int, int]]]:
    """Spans of each document in code points, by start and kind."""
    hs, he = hex_runs(c.data, c.off)
    hdoc = np.searchsorted(c.off, hs, side="right") - 1
    found: list[list] = [[] for _ in range(c.n)]
    for d, s, e in zip(hdoc.tolist(), hs.tolist(), he.tolist()):
        found[d].append((s - int(c.off[d]), 2, e - int(c.off[d])))
    for d in range(c.n):
        a, b = c.off[d], c.off[d + 1]
        found[d] += scan_bytes(c.data[a:b].tobytes())
        if found[d]:
            lead = np.zeros(b - a + 1, np.int64)
            np.cumsum((c.data[a:b] & 0xC0) != 0x80, out=lead[1:])
            found[d] = sorted((int(lead[s]), k, int(lead[e])) for s, k, e in found[d])
    return found


def _scan(batches):
    for b in batches:
        for c in T.chunks(b.column("text")):
            f = _scan_chunk(c)
            part = b.slice(c.rows.start, c.n)
            cols = [part.column(i) for i in range(part.num_columns)]
            names = list(part.schema.names)
            for i, n in ((0, "starts"), (2, "ends"), (1, "kinds")):
                cols.append(pa.array([[x[i] for x in spans] for spans in f], pa.list_(pa.int32())))
                names.append(n)
            yield pa.RecordBatch.from_arrays(cols, names=names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans as three arrays (starts, ends, kinds)."""
    d = T.strip_columns(docs, "doc_id", "text")
    return d.mapInArrow(_scan, f"doc_id bigint, text string, {SCHEMA}")


def _digests(batches):
    for b in batches:
        rows = {"doc_id": b.column("doc_id").to_pylist()}
        n = {k: [] for k in BASE_KINDS}
        sha, spans = [], []
        for c in T.chunks(b.column("text")):
            for f in _scan_chunk(c):
                for i, k in enumerate(BASE_KINDS):
                    n[k].append(sum(x[1] == i for x in f))
                say = [f"{KINDS[k]}:{s}:{e}" for s, k, e in f]
                spans.append(",".join(say))
                sha.append(hashlib.sha256(",".join(x for x, y in zip(say, f) if y[1] < 3).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64())] + [pa.array(n[k], pa.int64()) for k in BASE_KINDS] + [pa.array(sha), pa.array(spans)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    d = T.strip_columns(docs, "doc_id", "text")
    return d.mapInArrow(_digests, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def _mask(batches):
    for b in batches:
        out, sizes = [], []
        texts = b.column("text").to_pylist()
        at = 0
        for c in T.chunks(b.column("text")):
            for f in _scan_chunk(c):
                t = texts[at]
                at += 1
                if f:
                    keep, pos = [], 0
                    for s, _, e in f:
                        if s >= pos:
                            keep += [t[pos:s], MASK]
                        pos = max(pos, e)
                    t = "".join(keep) + t[pos:]
                out.append(t)
                sizes.append(len(t) if t is not None and f else None)
        names = list(b.schema.names)
        cols = [b.column(i) for i in range(b.num_columns)]
        cols[names.index("text")] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64())], names=[*names, "_chars"])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span replaced by MASK; ``n_chars``
    is brought up to date where it exists and the text changed."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    d = docs.toDF(*[n if i != at else "text" for i, n in enumerate(names)])
    from pyspark.sql.types import LongType, StructField, StructType
    out = d.mapInArrow(_mask, StructType([*d.schema.fields, StructField("_chars", LongType())]))
    cols = []
    for i, c in enumerate(docs.columns):
        new = F.col("text" if i == at else f"c{i}")
        if c == "n_chars":
            new = F.coalesce(F.col("_chars"), new).cast(docs.schema[i].dataType)
        cols.append(new.alias(c))
    return out.select(*cols)
