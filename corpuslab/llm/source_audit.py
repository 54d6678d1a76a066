"""Source divergence audit with in-mapper stripes.

1. Every task folds whole documents into hash stripes, one a (language, term):
   the number of documents and the occurrences by source. When the stripes hold
   more than ``SPILL`` entries they are sent on and the task starts afresh, so
   its memory is bounded; a term of every document costs one row a task.
2. Stripes are merged by (language, term), streaming over sorted rows. A stripe
   is no longer than the sources of its language. Terms in fewer than
   ``MIN_DOCS`` documents go.
3. Totals by (language, source) and language come from the merged stripes. Each
   language is dealt out in ``PARTS`` shares of its terms; a share meets the
   totals of its language in a cogroup and its stripes directly emit
   divergences: one partial sum a pair of sources and share, and the best
   ``TOP`` terms a source and share. Pairs are worked through in blocks of
   sources and terms, never as rows.

A share of p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) is an integer, and the
divergence of two shares is floor((p - q)**2 / (p + q)): all sums are exact and
do not depend on the order of the rows.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lowered.
Null text, lang and source count as ''. Empty texts make their group known but
add nothing. Repeated rows count each. Very long texts are folded piece by
piece. Other columns, whatever their names, are not read; a missing lang or
source column counts as ''. An empty table gives an empty result. The counts of
a language may reach 9e15.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

MIN_DOCS, TOP, SCALE_STEPS = 10, 10, (1000, 1000, 1000)
SPILL, PARTS, LONG_BYTES = 400_000, 64, 1 << 21
#: Numbers handled at once: terms x sources x sources of a block.
CELLS, SIDE = 1 << 21, 256
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

STRIPES = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"
_STRIPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                      ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def term_counts(text: bytes) -> Counter:
    """Occurrences by term of one text; a long one is taken match by match."""
    low = text.lower()  # bytes: only A-Z change
    if len(low) <= LONG_BYTES:
        return Counter(TERM.findall(low))
    return Counter(m.group() for m in TERM.finditer(low))


def _rows(stripes: dict, groups: set):
    """The stripes as record batches; a group stands as a stripe of the empty term."""
    rows = [(lang, b"", 0, [s], [0]) for lang, s in groups]
    for lang, terms in stripes.items():
        for t, s in terms.items():
            df = s.pop(None)
            rows.append((lang, t, df, list(s), list(s.values())))
        terms.clear()
    for a in range(0, len(rows), 20_000):
        lang, term, df, sources, counts = zip(*rows[a:a + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string(), safe=False), pa.array(df, pa.int64()),
                                          pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], schema=_STRIPES)


def _fold(spill: int):
    def run(batches):
        stripes, groups, size = {}, set(), 0
        for b in batches:
            lang, source = (b.column(c).fill_null("").to_pylist() for c in ("lang", "source"))
            text = b.column("text").cast(pa.binary()).fill_null(b"")
            for i in range(b.num_rows):
                src = source[i]
                groups.add((lang[i], src))
                mine = stripes.setdefault(lang[i], {})
                for t, n in term_counts(text[i].as_py()).items():
                    s = mine.get(t)
                    if s is None:
                        mine[t] = {None: 1, src: n}  # None: the documents
                        size += 2
                    else:
                        s[None] += 1
                        if src in s:
                            s[src] += n
                        else:
                            s[src] = n
                            size += 1
                if size >= spill:
                    yield from _rows(stripes, set())
                    stripes, size = {}, 0
        yield from _rows(stripes, groups)
    return run


def _key_starts(t: pa.Table) -> np.ndarray:
    """First row of each run of equal (lang, term)."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for name in ("lang", "term"):
        c = t.column(name)
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)))
    return np.flatnonzero(new)


def _merged(t: pa.Table, min_docs: int) -> pa.RecordBatch:
    """Whole runs of stripes -> one stripe each; kept terms and groups only."""
    start = _key_starts(t)
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
    df = np.add.reduceat(np.asarray(t.column("df")), start)
    sources = t.column("sources").combine_chunks()
    length = np.asarray(pc.list_value_length(sources), dtype=np.int64)
    names = sources.flatten().dictionary_encode()
    of = np.repeat(run, length) * max(1, len(names.dictionary)) + np.asarray(names.indices, dtype=np.int64)
    cell, inverse = np.unique(of, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, inverse, np.asarray(t.column("counts").combine_chunks().flatten()))
    run, code = cell // max(1, len(names.dictionary)), cell % max(1, len(names.dictionary))
    keep = (df >= min_docs) | np.asarray(pc.equal(t.column("term").take(pa.array(start)), ""))
    take = keep[run]
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(run[take], minlength=len(start))[keep])), pa.int32())
    first = pa.array(start[keep])
    return pa.RecordBatch.from_arrays(
        [t.column("lang").combine_chunks().take(first), t.column("term").combine_chunks().take(first), pa.array(df[keep]),
         pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(code[take]))),
         pa.ListArray.from_arrays(offsets, pa.array(total[take]))], schema=_STRIPES)


def _merge(min_docs: int):
    """Sorted stripes -> merged stripes. The last run of a batch waits for the next;
    a run over many batches is merged as it comes, so it stays one stripe."""
    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).cast(_STRIPES)
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            last = int(_key_starts(t)[-1])
            if last:
                yield _merged(t.slice(0, last).combine_chunks(), min_docs)
            held = pa.Table.from_batches([_merged(t.slice(last).combine_chunks(), 0)])
        if held is not None:
            yield _merged(held, min_docs)
    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), exact: long division in three steps."""
    out, rest = np.divmod(count + 2, total)
    for step in SCALE_STEPS:
        digit, rest = np.divmod(rest * step, total)
        out = out * step + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


RESULT = "lang string, source string, part string, item string, value bigint"


def _emit(top: int):
    """(stripes of a share, totals of its language) -> partial results."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        names = [names[i] for i in order]
        lang, n = right.column("lang")[0].as_py(), len(names)
        norm = np.asarray(right.column("norm"))[order]
        lang_norm = np.asarray(right.column("lang_norm"))[:1]
        known = pa.array(names, pa.string())
        out = [_table(lang, known, "pair", *x) for x in _pairs(left, known, norm)]
        if left.num_rows:
            source, item, value = _best_terms(left, known, norm, lang_norm, top)
            out.append(_table(lang, known, "term", source, pa.array(item, pa.string()), value))
        return pa.concat_tables(out)
    return run


def _table(lang: str, known: pa.Array, part: str, source, item, value) -> pa.Table:
    n = len(value)
    item = item if isinstance(item, pa.Array) else known.take(pa.array(item))
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": known.take(pa.array(source, pa.int64())),
                     "part": pa.array([part] * n, pa.string()), "item": item, "value": pa.array(value, pa.int64())})


def _cells(stripes: pa.Table, known: pa.Array):
    """(stripe, source, count) of all entries, by stripe."""
    sources = stripes.column("sources").combine_chunks()
    length = np.asarray(pc.list_value_length(sources), dtype=np.int64)
    col = np.asarray(pc.index_in(sources.flatten(), known), dtype=np.int64)
    return np.repeat(np.arange(stripes.num_rows), length), col, np.asarray(stripes.column("counts").combine_chunks().flatten())


def _pairs(stripes: pa.Table, known: pa.Array, norm: np.ndarray):
    """(source, other source, sum over the stripes), block of sources by block."""
    n = len(norm)
    cells = _cells(stripes, known) if stripes.num_rows else None
    for a in range(0, n, SIDE):
        for b in range(a, n, SIDE):
            i, j = np.meshgrid(np.arange(a, min(n, a + SIDE)), np.arange(b, min(n, b + SIDE)), indexing="ij")
            f = np.zeros(i.shape, np.int64) if cells is None else _pair_sums(*cells, norm, stripes.num_rows, a, b)
            yield i[i < j], j[i < j], f[i < j]


def _best_terms(stripes: pa.Table, known: pa.Array, norm: np.ndarray, lang_norm: np.ndarray, top: int):
    """The ``top`` terms of each source whose share is above the language's."""
    terms = stripes.column("term").to_pylist()
    row, col, value = _cells(stripes, known)
    whole = np.zeros(len(terms), np.int64)
    np.add.at(whole, row, value)
    p, q = shares(value, norm[col]), shares(whole, lang_norm)[row]
    f = divergence(p, q)
    good = np.flatnonzero((value > 0) & (p > q))
    good = good[np.lexsort((-f[good], col[good]))]
    cut = np.searchsorted(col[good], np.arange(len(norm) + 1))
    source, item, values = [], [], []
    for s in range(len(norm)):
        mine = good[cut[s]:cut[s + 1]]
        if len(mine) > top:  # ties of the last place are settled by the term
            mine = mine[f[mine] >= f[mine[top - 1]]]
        for v, t in sorted((-int(f[i]), terms[row[i]].encode()) for i in mine)[:top]:
            source.append(s)
            item.append(t.decode())
            values.append(-v)
    return source, item, values


def _pair_sums(row, col, value, norm, n_terms, a, b):
    """Sums over all terms of the divergences of the sources a.. and b.. of two blocks."""
    na, nb = min(SIDE, len(norm) - a), min(SIDE, len(norm) - b)
    out = np.zeros((na, nb), np.int64)
    step = max(1, CELLS // (na * nb))

    def block(lo, hi, first, width):
        x, y = np.searchsorted(row, [lo, hi])
        here = (col[x:y] >= first) & (col[x:y] < first + width)
        c = np.zeros((hi - lo, width), np.int64)
        c[row[x:y][here] - lo, col[x:y][here] - first] = value[x:y][here]
        return shares(c, norm[first:first + width])
    for lo in range(0, n_terms, step):
        hi = min(n_terms, lo + step)
        p = block(lo, hi, a, na)
        q = p if a == b else block(lo, hi, b, nb)
        out += divergence(p[:, :, None], q[:, None, :]).sum(axis=0)
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, spill: int = SPILL, parts: int = PARTS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    d = T.strip_columns(docs, "lang", "source", "text")
    folded = d.mapInArrow(_fold(spill), STRIPES)
    merged = folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(min_docs), STRIPES)
    merged = materialize(merged, "audit-stripes")
    groups = merged.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    stripes = merged.filter("term <> ''").select("lang", "term", "sources", "counts", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("share"))
    each = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("z")) \
        .groupBy("lang", F.col("z.sources").alias("source")).agg(F.sum("z.counts").alias("n"))
    v = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    per = groups.join(each, ["lang", "source"], "left").join(v, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v"))
    per = materialize(per, "audit-totals")
    # at least 1, for languages without kept terms (their norms are never used)
    norm = per.join(per.groupBy("lang").agg(F.sum("n").alias("lang_n")), "lang").select(
        "lang", "source", F.greatest(F.lit(1), F.col("n") + 2 * F.col("v")).cast("bigint").alias("norm"),
        F.greatest(F.lit(1), F.col("lang_n") + 2 * F.col("v")).cast("bigint").alias("lang_norm"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("share"))
    out = stripes.groupBy("lang", "share").cogroup(norm.groupBy("lang", "share")).applyInArrow(_emit(top), RESULT)
    out = materialize(out, "audit-shares")
    pair = out.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pair.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("z"), "value")
    both = pair.select("lang", "z.source", F.lit("pair").alias("part"), "z.item", "value") \
        .unionByName(out.filter("part = 'term'"))
    # a window holds the other sources of one source, or ``top`` terms a share
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.withColumn("rank", F.row_number().over(w)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
