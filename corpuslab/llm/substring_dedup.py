"""Exact substring dedup over word windows, by level-wise doubling.

A window of ``LENGTH`` (20) words whose words also start earlier in the corpus is
removed. The levels have 5, 10 and 20 words; only windows that are repeated at
one length are extended to twice that length:

* Level 5: of the sixteen 5-word windows in a 20-word window the one with the
  smallest fingerprint (leftmost on ties) stands for it. Equal 20-word windows
  pick the same one at the same offset, so all repeats survive while about one
  word in eight sends a row.
* Level 10: each surviving place is extended to ten words, to the right where
  its 20-word windows reach that far, else to the left.
* Level 20: the windows of the survivors are compared whole (96-bit
  fingerprints); all but the first occurrence (smallest doc_id, then start) are
  removed. Every candidate has then been decided.

One shuffle per level, keyed by fingerprint, after pre-aggregation in each
batch (see ``repeats.witnesses``), so a passage that every document shares sends
one row per batch. Texts that equal an earlier document's text need no windows
at all: every window of theirs starts earlier. The texts are shuffled once, by
document, and that exchange serves both extensions and the final cut.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Null and empty texts have
no words; fewer than 20 words: nothing is removed. Rows that share a doc_id are
one document to the order, so none of them precedes the others by that id.
Repeated rows give repeated results. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import repeats as R
from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

LENGTH = 20


class _Windows:
    """The whole windows of a chunk: ``s`` their first words, ``m`` the word at
    which their representative short window begins, ``side`` 1 if that one is
    extended to the left."""

    def __init__(self, c: T.Chunk, length: int, first: int):
        c.words()
        self.h = c.word_hashes()
        self.roll = T.Rolling(self.h)
        self.short = self.roll.windows(first)
        n = len(self.h) - length + 1
        if n <= 0:
            self.s = self.m = self.side = np.zeros(0, np.int64)
            return
        run = length - first + 1
        group = c.wdoc[:len(self.short)]
        m, s = T.minimizers(self.short, group, run)
        ok = s + length <= len(self.h)
        ok[ok] = c.wdoc[s[ok]] == c.wdoc[s[ok] + length - 1]
        self.s, self.m = s[ok], m[ok]
        self.side = (self.m - self.s > length - 2 * first).astype(np.int64)


def _level_first(length: int, first: int):
    def run(batches):
        for b in batches:
            d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
            g, d, kp = [], [], []
            for c in T.chunks(b.column("text")):
                w = _Windows(c, length, first)
                p = np.unique(w.m)
                doc = c.wdoc[p]
                g.append(w.short[p])
                d.append(d_all[c.rows][doc])
                kp.append(R.pack(k_all[c.rows][doc], p - c.woff[doc]))
            if g:
                yield R.witnesses(np.concatenate(g), np.concatenate(d), np.concatenate(kp))
    return run


def _level_double(length: int, first: int):
    """Surviving places -> windows of 2 * first words there."""
    def run(batches):
        for b in batches:
            d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
            g, d, kp = [], [], []
            for c in T.chunks(b.column("text")):
                w = _Windows(c, length, first)
                alive = R.lists(b.column("places"), c.rows, c.woff)
                at = np.unique((w.m * 2 + w.side)[R.member(w.m, alive)])
                p, side = at // 2, at % 2
                start = p - first * side
                doc = c.wdoc[p]
                g.append(w.roll.spans(start, start + 2 * first) ^ T.mix(side.astype(np.uint64) + T.U(1)))
                d.append(d_all[c.rows][doc])
                kp.append(R.pack(k_all[c.rows][doc], (p - c.woff[doc]) * 2 + side))
            if g:
                yield R.witnesses(np.concatenate(g), np.concatenate(d), np.concatenate(kp))
    return run


def _level_last(length: int, first: int):
    """Surviving places -> their whole windows, with a second fingerprint."""
    def run(batches):
        for b in batches:
            d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
            g, g2, d, kp = [], [], [], []
            for c in T.chunks(b.column("text")):
                w = _Windows(c, length, first)
                alive = R.lists(b.column("places"), c.rows, c.woff * 2)
                s = w.s[R.member(w.m * 2 + w.side, alive)]
                doc = c.wdoc[s]
                g.append(w.roll.spans(s, s + length))
                g2.append(T.Rolling(T.mix(w.h ^ T.U(0x5851F42D4C957F2D))).spans(s, s + length) & T.U(0xFFFFFFFF00000000))
                d.append(d_all[c.rows][doc])
                kp.append(R.pack(k_all[c.rows][doc], s - c.woff[doc]))
            if g:
                yield R.witnesses(np.concatenate(g), np.concatenate(d), np.concatenate(kp), np.concatenate(g2))
    return run


def _cut(length: int):
    """Documents with the starts of their removed windows (or ``whole``) ->
    counts, kept text and its digest."""
    def run(batches):
        for b in batches:
            whole = np.asarray(b.column("whole").fill_null(False))
            out: list[list] = [[], [], []]
            for c in T.chunks(b.column("text")):
                c.words()
                starts = R.lists(b.column("places"), c.rows, c.woff)
                gone = T.cover(starts, length, len(c.ws))
                n = np.diff(c.woff)
                gone |= (whole[c.rows] & (n >= length))[c.wdoc] if len(gone) else gone
                out[0] += n.tolist()
                out[1] += T.per_doc_sum(gone, c.woff).tolist()
                raw = c.data.tobytes()
                for d in range(c.n):
                    a, z = int(c.woff[d]), int(c.woff[d + 1])
                    stay = a + np.flatnonzero(~gone[a:z])
                    out[2].append(b" ".join([raw[x:y] for x, y in zip(c.ws[stay].tolist(), c.we[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def _survivors(rows: DataFrame) -> DataFrame:
    """Rows of keys that occur more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy("g", "known"))
    return rows.withColumn("n", n).filter(F.col("known") | F.col("many") | (F.col("n") > 1))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    if length < 4:
        raise ValueError("length must be at least four words")
    first = length // 4
    k = R.keyed(docs)
    text = k.select("d", "k", "text")
    copied = R.classes(k).filter("copies > 1").select("h1", "h2", "first_d")
    later = k.select("d", "k", "h1", "h2").join(copied, ["h1", "h2"]).filter(F.col("d") > F.col("first_d"))
    later = materialize(later.select("d", "k", F.lit(True).alias("later")).distinct(), "repeat-copies")
    rows = text.join(later, ["d", "k"], "left_anti").mapInArrow(_level_first(length, first), R.ROWS)
    rows = text.join(R.positions(_survivors(rows)), ["d", "k"]).mapInArrow(_level_double(length, first), R.ROWS)
    rows = text.join(R.positions(_survivors(rows)), ["d", "k"]).mapInArrow(_level_last(length, first), R.ROWS + ", g2 int")
    # repeats known within their batch need no shuffle by fingerprint
    place = F.struct("d", F.col("kp").bitwiseAND(0xFFFFFFFF).alias("s"))
    first_at = F.min(place).over(Window.partitionBy("g", "g2"))
    open_rows = rows.filter(~F.col("known")).select("g", "g2", "d", "kp")
    gone = open_rows.withColumn("at", first_at).filter(place > F.col("at")).select("d", "kp") \
        .unionByName(rows.filter("known").select("d", "kp"))
    spans = R.positions(gone).join(later, ["d", "k"], "full_outer")
    full = text.join(spans, ["d", "k"], "left")
    full = full.select(R.doc_id().alias("doc_id"), "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"),
                       F.col("later").alias("whole"))
    return full.mapInArrow(_cut(length), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
