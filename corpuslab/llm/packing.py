"""Best-fit packing planned on the histogram of lengths.

1. Every text becomes token ids plus an end id; a document longer than
   ``seq_len`` is cut into pieces of ``seq_len``, the last one shorter.
2. The histogram of piece lengths - at most ``seq_len`` counts, whatever the
   corpus - is packed on the driver by best-fit decreasing over counts: all bins
   with the same room are one group, and a whole run of equal pieces is placed
   in a group at once. The plan is a list of runs: pieces of length L with ranks
   r to r + n go to sequences s to s + n at one offset.
3. Pieces are ranked within their length (hot lengths in hashed buckets, so no
   window holds more than about ``BUCKET`` rows) and take the planned slot of
   their (length, rank).

Tokens: a word between white space always gets the same ids, since the
tokenizer never joins across white space; each worker keeps the ids of the
words it has met (at most ``CACHE`` words, then it starts afresh).

Nulls: a null text counts as empty; an empty text is one piece with the end id
alone. Repeated rows are packed each for itself. Very long texts give many
pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

SEQ_LEN, END_ID = 2048, 0
BUCKET, CACHE, BROADCAST_RUNS = 65536, 1_000_000, 100_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids of a text as little-endian uint32 bytes, from ids by word."""

    #: A word of Latin letters, perhaps with one mark at its end: the tokenizer
    #: splits these two apart and nothing else, so the letters can be looked up alone.
    PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        hidden = [b for b in range(256) if b not in shown]
        # byte-level alphabet of the tokenizer family: printable bytes stand for themselves
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.plain_ok = self._check()
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _full(self, word: str) -> bytes:
        return np.asarray(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _core(self, core: str) -> bytes:
        got = self.cores.get(core)
        if got is None:
            shown = core if core.isascii() else "".join(self.alphabet[b] for b in core.encode())
            got = np.asarray([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
            self.cores[core] = got
        return got

    def _check(self) -> bool:
        """Does looking up letters and end mark apart agree with this tokenizer?"""
        self.cores = {}
        try:
            return all(self._core(a.lower()) + self._full(b) == self._full(a + b)
                       for a, b in (("Token", "."), ("Été", ","), ("größe", ""), ("A", "?"), ("unbelievably", "!")))
        except Exception:  # another kind of model: always take the full path
            return False

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        m = self.PLAIN.fullmatch(text) if self.plain_ok else None
        if m is None:
            return self._full(text)
        got = self._core(m[1].lower())
        if m[2]:
            mark = m[2].encode()
            if mark not in self.words:
                self.words[mark] = self._full(m[2])
            got += self.words[mark]
        return got

    def encode(self, raw: bytes) -> bytes:
        words = raw.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            known = self.words
            if len(known) > CACHE or len(self.cores) > CACHE:
                known.clear()
                self.cores.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.__missing__(w)
            return b"".join(map(known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, seq_len: int, end_id: int):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        enc = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        size = 4 * seq_len
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for c in T.chunks(b.column("text")):
                for d in range(c.n):
                    raw = enc.encode(c.data[c.off[d]:c.off[d + 1]].tobytes()) + end
                    doc = ids[c.rows.start + d]
                    rows += [(doc, i, i * seq_len, len(raw[a:a + size]) // 4, zlib.crc32(raw[a:a + size]))
                             for i, a in enumerate(range(0, len(raw), size))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, first rank, n, first
    sequence, offset): n pieces in n sequences, one each."""
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, n)
    rooms = np.zeros(seq_len + 1, dtype=bool)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0

        def fill(base: int, n: int, room: int, each: int) -> None:
            """``each`` pieces into each of the n bins from ``base`` that have ``room``."""
            nonlocal rank, need
            for k in range(each):
                runs.append((length, rank, n, base, seq_len - room + k * length))
                rank += n
            need -= n * each
            left = room - each * length
            if left:
                bins[left].append((base, n))
                rooms[left] = True
        while need:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                base, n = bins[room].pop()
                if not bins[room]:
                    rooms[room] = False
            else:
                room, base, n = seq_len, opened, -(-need // (seq_len // length))
                opened += n
            each = room // length
            full = min(n, need // each)
            if full < n:  # not all of these bins can be filled
                rest = min(need - full * each, each - 1) if n > full else 0
                if rest:
                    over = (base + full + 1, n - full - 1)
                else:
                    over = (base + full, n - full)
                if full:
                    fill(base, full, room, each)
                if rest:
                    fill(base + full, 1, room, rest)
                if over[1] and room < seq_len:
                    bins[room].append(over)
                    rooms[room] = True
            else:
                fill(base, n, room, each)
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    d = T.strip_columns(docs, "doc_id", "text")
    p = d.mapInArrow(_pieces(tokenizer or default_tokenizer(), seq_len, end_id),
                     "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    p = materialize(p, "packing-pieces")
    hist = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}
    runs = plan(hist, seq_len)
    schema = "length bigint, first bigint, n bigint, sequence bigint, offset bigint"
    slots = spark.createDataFrame(runs, schema)
    if len(runs) <= BROADCAST_RUNS:
        slots = F.broadcast(slots)
    heads = spark.createDataFrame([(k, -(-v // BUCKET)) for k, v in hist.items()], "length bigint, buckets bigint")
    p = p.join(F.broadcast(heads), "length")  # at most seq_len rows
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    w = Window.partitionBy("length", "bucket")
    sizes = p.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = p.withColumn("place", F.row_number().over(w.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    here = (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(slots, here).select(
        "doc_id", "piece", "start", ranked["length"].alias("length"), "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
