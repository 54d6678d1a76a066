"""Exact byte-level dedup with logarithmic families of suffix arrays.

A byte is removed if it lies in a ``LENGTH``-byte (200) string that also starts
anywhere else, in the same document or another.

Candidates come first: in every 200-byte string the ``SEED``-byte window with the
smallest fingerprint (leftmost on ties) is its anchor. Equal strings have their
anchors at the same offset, so looking at anchors alone loses no match, and about
one byte in fifty sends a row. What is left is dealt to tasks by seed; each task
keeps a ``SuffixFamily`` of all suffixes of its share: a new batch gets its suffix
array over the bytes, is merge-scanned against the existing levels for common
prefixes of 200 bytes and becomes a level; levels of equal size merge.

1. Seeds: anchors whose first 100 bytes occur elsewhere survive (a ``Family`` of
   sorted fingerprints).
2. Contexts: all strings that share an anchor make one context (up to 300
   bytes). A context that occurs elsewhere, same shape, is a match as a whole.
3. Strings: one of each different context goes to the family of its seed, which
   matches the single 200-byte strings by their bytes and so finds the exact ends
   of partial matches. A seed with more than ``HOT`` different contexts is not
   gathered in one task: its strings are dealt out one by one instead, by
   fingerprints of 96 bits.

Hot keys are pre-aggregated in every batch (``repeats.witnesses``). Texts equal to
another document's are matches as a whole; only the first of them is indexed.
The texts are shuffled once; that exchange serves all steps and the cut.

Null texts count as empty; texts under 200 bytes lose nothing. Repeated rows are
copies of each other. Cuts may split a UTF-8 character, so the kept part is
binary. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import repeats as R
from corpuslab.llm import textarrays as T
from corpuslab.llm.suffix_family import SuffixFamily
from corpuslab.session import materialize

LENGTH, SEED, HOT = 200, 100, 50_000
_HIGH = T.U(0xFFFFFFFF00000000)
_TABLE2 = T.mix(T._TABLE)


class Family:
    """Fingerprints in levels: sorted different keys (two fingerprints) and the
    row that stands for each. For candidates and the single strings of hot seeds."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.matched = np.zeros(0, bool)
        self.rows = 0

    def add(self, g: np.ndarray, g2: np.ndarray, sure: np.ndarray | None = None) -> None:
        """A new batch; ``sure`` marks rows already known to be matched."""
        n = len(g)
        if self.rows + n > len(self.matched):
            self.matched = np.concatenate([self.matched, np.zeros(max(n, len(self.matched)), bool)])
        if n == 0:
            return
        order = np.lexsort((g2, g))
        a, a2 = g[order], g2[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (a2[1:] != a2[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        hit = size > 1
        if sure is not None:
            hit |= np.maximum.reduceat(sure[order], start)
        a, a2 = a[start], a2[start]
        held = np.zeros(len(a), bool)
        for _, lg, lg2, lrow in self.levels:  # merge-scan
            lo, hi = np.searchsorted(lg, a, "left"), np.searchsorted(lg, a, "right")
            at, left = lo, np.flatnonzero(lo < hi)
            while len(left):
                same = lg2[at[left]] == a2[left]
                hit[left[same]] = held[left[same]] = True
                self.matched[lrow[at[left[same]]]] = True
                at = at.copy()
                at[left] += 1
                left = left[~same & (at[left] < hi[left])]
        self.matched[self.rows + order] |= np.repeat(hit, size)
        self.levels.append((0, a[~held], a2[~held], self.rows + order[start][~held]))
        self.rows += n
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (gen, a, a2, r), (_, b, b2, s) = self.levels.pop(), self.levels.pop()
            a, a2, r = np.concatenate([b, a]), np.concatenate([b2, a2]), np.concatenate([s, r])
            order = np.lexsort((a2, a))
            self.levels.append((gen + 1, a[order], a2[order], r[order]))


class _Anchors:
    """The 200-byte strings of a chunk by anchor: anchor ``p``, first and last
    start ``a`` and ``b``, document ``doc``."""

    def __init__(self, c: T.Chunk):
        self.roll = c.byte_rolling()
        self.seeds = self.roll.windows(SEED)
        n = len(c.data)
        of = np.repeat(np.arange(c.n), np.diff(c.off))
        m, s = T.minimizers(self.seeds, of[:len(self.seeds)], LENGTH - SEED + 1)
        ok = s + LENGTH <= n
        ok[ok] = of[s[ok]] == of[s[ok] + LENGTH - 1]
        m, s = m[ok], s[ok]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (of[s[1:]] != of[s[:-1]])
        first = np.flatnonzero(new)
        self.p, self.a = m[first], s[first]
        self.b = s[np.append(first[1:], len(s)) - 1] if len(s) else s
        self.doc = of[self.p]


def _seeds(batches):
    for b in batches:
        d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
        g, d, kp = [], [], []
        for c in T.chunks(b.column("text")):
            x = _Anchors(c)
            g.append(x.seeds[x.p])
            d.append(d_all[c.rows][x.doc])
            kp.append(R.pack(k_all[c.rows][x.doc], x.p - c.off[x.doc]))
        if g:
            yield R.witnesses(np.concatenate(g), np.concatenate(d), np.concatenate(kp))


def _match_seeds(batches):
    """One task's share of the seeds -> (d, kp) of those that occur elsewhere."""
    family, d, kp = Family(), [], []
    for b in batches:
        known, many = np.asarray(b.column("known")), np.asarray(b.column("many"))
        bd, bkp = np.asarray(b.column("d")), np.asarray(b.column("kp"))
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(bd[known]), pa.array(bkp[known])], names=["d", "kp"])
        g = np.asarray(b.column("g")).view(np.uint64)[~known]
        family.add(g, np.zeros(len(g), np.uint64), many[~known])
        d.append(bd[~known])
        kp.append(bkp[~known])
    if d:
        hit = family.matched[:family.rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(d)[hit]), pa.array(np.concatenate(kp)[hit])], names=["d", "kp"])


CONTEXTS = "g bigint, known boolean, many boolean, d bigint, kp bigint, g2 int, seed bigint, shape int"


def _span2(c: T.Chunk, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    return T.Rolling(_TABLE2[c.data]).spans(a, e) & _HIGH


def _alive(c: T.Chunk, x: _Anchors, places, scale: int) -> np.ndarray:
    """Anchors among the chunk's listed places (place * scale + flags)."""
    return R.member(x.p, np.unique(R.lists(places, c.rows, c.off * scale) // scale))


def _contexts(batches):
    """Surviving anchors -> their contexts, pre-aggregated."""
    for b in batches:
        d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
        g, g2, d, kp, seed, shape = [], [], [], [], [], []
        for c in T.chunks(b.column("text")):
            x = _Anchors(c)
            keep = _alive(c, x, b.column("places"), 1)
            p, a, e, doc = x.p[keep], x.a[keep], x.b[keep] + LENGTH, x.doc[keep]
            form = (p - a) * 256 + (x.b[keep] - a)
            g.append(x.roll.spans(a, e) ^ T.mix(form.astype(np.uint64)))
            g2.append(_span2(c, a, e))
            d.append(d_all[c.rows][doc])
            kp.append(R.pack(k_all[c.rows][doc], p - c.off[doc]))
            seed.append(x.seeds[p])
            shape.append(form)
        if g:
            d, kp = np.concatenate(d), np.concatenate(kp)
            w = R.witnesses(np.concatenate(g), d, kp, np.concatenate(g2))
            # the seed and shape go by (d, kp)
            order = np.lexsort((kp, d))
            wd, wkp = np.asarray(w.column("d")), np.asarray(w.column("kp"))
            place = np.empty(len(wd), np.int64)
            sub = np.lexsort((wkp, wd))
            uniq = np.ones(len(order), bool)
            uniq[1:] = (d[order][1:] != d[order][:-1]) | (kp[order][1:] != kp[order][:-1])
            place[sub] = order[uniq]
            yield pa.RecordBatch.from_arrays(
                [*w.columns, pa.array(np.concatenate(seed)[place].view(np.int64)), pa.array(np.concatenate(shape)[place].astype(np.int32))],
                names=[*w.schema.names, "seed", "shape"])


STRINGS = "key bigint, key2 int, context binary, lead int, n int, settled boolean, d bigint, k int, start int"


def _strings(batches):
    """One of each different context -> its bytes, or, for a hot seed, its
    single strings' fingerprints. ``places``: place * 4 + 2 hot + settled."""
    for b in batches:
        d_all, k_all = np.asarray(b.column("d")), np.asarray(b.column("k"))
        for c in T.chunks(b.column("text")):
            x = _Anchors(c)
            listed = R.lists(b.column("places"), c.rows, c.off * 4)
            keep = np.flatnonzero(R.member(x.p, np.unique(listed // 4)))
            if not len(keep):
                continue
            flags = listed[np.searchsorted(listed // 4, x.p[keep])] % 4
            raw = c.data.tobytes()
            doc = x.doc[keep]
            a, z = x.a[keep], x.b[keep]
            cold = np.flatnonzero(flags < 2)
            hot = np.flatnonzero(flags >= 2)
            n = z[hot] - a[hot] + 1
            s = np.repeat(a[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hot) else np.zeros(0, np.int64)
            sdoc, sflag = np.repeat(doc[hot], n), np.repeat(flags[hot], n)
            key = np.concatenate([x.seeds[x.p[keep]][cold], x.roll.spans(s, s + LENGTH)]).view(np.int64)
            key2 = (np.concatenate([np.zeros(len(cold), np.uint64), _span2(c, s, s + LENGTH)]) >> T.U(32)).astype(np.uint32).view(np.int32)
            ctx = [raw[i:j] for i, j in zip(a[cold].tolist(), (z[cold] + LENGTH).tolist())] + [None] * len(s)
            rows = np.concatenate([doc[cold], sdoc])
            lead = np.concatenate([a[cold], s]) - c.off[rows]
            count = np.concatenate([z[cold] - a[cold] + 1, np.ones(len(s), np.int64)])
            settled = np.concatenate([flags[cold], sflag]) % 2 == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(key2), pa.array(ctx, pa.binary()), pa.array(lead.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(settled), pa.array(d_all[c.rows][rows]), pa.array(k_all[c.rows][rows]), pa.array(lead.astype(np.int32))],
                names=[y.split()[0] for y in STRINGS.split(", ")])


SPANS = "d bigint, k int, start int, n int"


def _match_strings(batches):
    """One task's share of the contexts -> runs of matched strings."""
    family, lone_strings = SuffixFamily(LENGTH), Family()
    places, lone, d, k, start, settled, n = [], [], [], [], [], [], []
    for b in batches:
        alone = np.asarray(b.column("context").is_null())
        g = np.asarray(b.column("key")).view(np.uint64)[alone]
        g2 = np.asarray(b.column("key2")).view(np.uint32).astype(np.uint64)[alone] << T.U(32)
        for c in T.chunks(b.column("context").filter(pa.array(~alone))):
            count = np.diff(c.off) - LENGTH + 1
            starts = np.repeat(c.off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            places.append(family.add(c.data, starts + np.arange(len(starts))))
            lone.append(np.zeros(len(starts), bool))
        places.append(lone_strings.rows + np.arange(len(g)))
        lone.append(np.ones(len(g), bool))
        lone_strings.add(g, g2)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        for out, name in ((d, "d"), (k, "k"), (start, "start"), (settled, "settled")):
            out.append(np.asarray(b.column(name))[order])
        n.append(np.asarray(b.column("n"), dtype=np.int64)[order])
    if not d:
        return
    d, k, start, settled, n = (np.concatenate(x) for x in (d, k, start, settled, n))
    places, lone = np.concatenate(places), np.concatenate(lone)
    hit = np.zeros(len(places), bool)
    hit[lone], hit[~lone] = lone_strings.matched[places[lone]], family.matched(places[~lone])
    hit &= ~np.repeat(settled, n)
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin = hit.copy()
    begin[1:] &= ~(hit[:-1] & (of[1:] == of[:-1]))
    end = hit.copy()
    end[:-1] &= ~(hit[1:] & (of[1:] == of[:-1]))
    i, j = np.flatnonzero(begin), np.flatnonzero(end)
    yield pa.RecordBatch.from_arrays([pa.array(d[of[i]]), pa.array(k[of[i]]), pa.array((start[of[i]] + inside[i]).astype(np.int32)),
                                      pa.array((j - i + 1).astype(np.int32))], names=["d", "k", "start", "n"])


def _cut(batches):
    """Documents with their matched runs (or ``whole``) -> counts and kept bytes."""
    for b in batches:
        whole = np.asarray(b.column("whole").fill_null(False))
        out: list[list] = [[], [], [], []]
        for c in T.chunks(b.column("text")):
            n = len(c.data)
            part = b.column("spans").slice(c.rows.start, c.n)
            flat = part.flatten()
            times = np.asarray(pc.fill_null(pc.list_value_length(part), 0), dtype=np.int64)
            s = np.asarray(flat.field("start"), dtype=np.int64) + np.repeat(c.off[:-1], times)
            e = s + np.asarray(flat.field("n"), dtype=np.int64) - 1 + LENGTH
            size = np.diff(c.off)
            all_of = whole[c.rows] & (size >= LENGTH)
            s, e = np.concatenate([s, c.off[:-1][all_of]]), np.concatenate([e, c.off[1:][all_of]])
            depth = np.bincount(s, minlength=n + 1) - np.bincount(e, minlength=n + 1)
            gone = np.cumsum(depth)[:n] > 0
            first = np.zeros(n + 1, bool)
            first[c.off] = True
            run = gone.copy()
            run[1:] &= ~gone[:-1] | first[1:n]
            out[0] += size.tolist()
            out[1] += T.per_doc_sum(gone, c.off).tolist()
            out[2] += T.per_doc_sum(run, c.off).tolist()
            out[3] += [c.data[a:z][~gone[a:z]].tobytes() for a, z in zip(c.off[:-1].tolist(), c.off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    k = R.keyed(docs)
    text = k.select("d", "k", "text")
    copied = R.classes(k).filter("copies > 1").select("h1", "h2", "first_d")
    same = k.select("d", "k", "h1", "h2").join(copied, ["h1", "h2"]).select("d", "k", (F.col("d") > F.col("first_d")).alias("later")).distinct()
    same = materialize(same, "suffix-copies")
    rows = text.join(same.filter("later").select("d", "k"), ["d", "k"], "left_anti").mapInArrow(_seeds, R.ROWS)
    alive = R.positions(rows.repartition("g").mapInArrow(_match_seeds, "d bigint, kp bigint"))
    ctx = text.join(alive, ["d", "k"]).mapInArrow(_contexts, CONTEXTS)
    here = Window.partitionBy("g", "g2", "known")
    place = F.struct("d", "kp")
    ctx = ctx.withColumn("n", F.count(F.lit(1)).over(here)).withColumn("at", F.min(place).over(here))
    ctx = ctx.withColumn("settled", F.col("known") | F.col("many") | (F.col("n") > 1))
    ctx = materialize(ctx.select("d", "kp", "seed", "shape", "settled", (~F.col("known") & (place == F.col("at"))).alias("first")), "suffix-contexts")
    whole = ctx.filter("settled").select("d", *R.unpack_columns(), "shape")
    whole = whole.select("d", "k", (F.col("p") - F.shiftright("shape", 8)).alias("start"), (F.col("shape").bitwiseAND(255) + 1).alias("n"))
    one = ctx.filter("first")
    hot = one.groupBy("seed").count().filter(F.col("count") > HOT).select("seed", F.lit(2).alias("hot"))
    one = one.join(hot, "seed", "left").select("d", *R.unpack_columns(), (F.coalesce("hot", F.lit(0)) + F.col("settled").cast("int")).alias("f"))
    listed = one.groupBy("d", "k").agg(F.collect_list(F.col("p").cast("bigint") * 4 + F.col("f")).alias("places"))
    strings = text.join(listed, ["d", "k"]).mapInArrow(_strings, STRINGS)
    parts = strings.repartition("key").mapInArrow(_match_strings, SPANS)
    spans = whole.unionByName(parts).groupBy("d", "k").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = spans.join(same.select("d", "k", F.lit(True).alias("whole")), ["d", "k"], "full_outer")
    full = text.join(spans, ["d", "k"], "left")
    full = full.select(R.doc_id().alias("doc_id"), "text", F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"), "whole")
    return full.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
