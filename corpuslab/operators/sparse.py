"""Documents as sparse rows: terms are counted, weighted and normalised inside the
row, so the corpus itself is never shuffled; only the vocabulary's counts are.

* ``counted``: (kept columns, terms, tf) - a document's distinct terms with their
  counts. Tokens come from the JVM expressions of ``functions.text``; n-grams and
  counts are made in Arrow batches, a slice of words at a time.
* ``term_stats`` / ``text_stats`` / ``vocabulary``: document and corpus frequency by
  term (of counted rows, of texts), summed in the task first; the ``max_features``
  most frequent by corpus count (ties by term) with df >= min_df.
* ``Vectorizer``: the chosen terms with their idf, at most ``max_features`` of
  them, broadcast to the tasks; ``rows`` gives (kept columns, idx, w) and
  ``weights`` the long form (doc, term, weight).
* ``Vectorizer.known`` / ``Vectorizer.text_weights``: from the texts in one step, without
  a table of counted rows. ``known`` gives (kept columns, idx, tf), the form to store:
  ``scaled`` (or ``csr`` with a ``Scale``) makes the weights from it.

Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), divided by the row's norm.
A document without a known term keeps its row, with empty arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as X

#: Words handled at once; a longer document is a slice of its own.
SLICE = 50_000
#: The same where terms are looked up: each lookup reads the whole vocabulary first.
PLACED = 200_000
#: Terms that a task adds up before it sends them on (Spark adds up further before the
#: shuffle), and rows of a batch that it sends.
TALLY, SENT = 250_000, 50_000


class Words:
    """Word n-grams lo..hi of the text column."""

    def __init__(self, text: str = "text", lo: int = 1, hi: int = 1):
        self.text, self.lo, self.hi = text, lo, hi

    def tokens(self):
        return X.word_tokens(F.col(self.text))

    def grams(self, flat: pa.Array, owner: np.ndarray):
        """(code, document, None, dictionary) of all n-grams of flat tokens. Words are numbered
        first, an n-gram is the number of its first n - 1 words and that of the last, and
        only different ones are spelt out."""
        words = flat.dictionary_encode()
        last, wide = np.asarray(words.indices, dtype=np.int64), max(1, len(words.dictionary))
        gram, names, codes, owners, spelt, base = last, words.dictionary, [], [], [], 0
        for n in range(1, self.hi + 1):
            inside = owner[:max(0, len(last) - n + 1)] == owner[n - 1:]  # by the place where it begins
            if n > 1:
                pair = pa.array(gram[:len(inside)] * wide + last[n - 1:]).filter(pa.array(inside)).dictionary_encode()
                both = np.asarray(pair.dictionary)
                names = pc.binary_join_element_wise(names.take(pa.array(both // wide)), words.dictionary.take(pa.array(both % wide)), " ")
                gram = np.zeros(len(inside), np.int64)  # places that begin none keep 0; longer ones begin there neither
                gram[inside] = np.asarray(pair.indices)
            if n >= self.lo:
                codes.append(gram[inside] + base)
                owners.append(owner[:len(inside)][inside])
                spelt.append(names)
                base += len(names)
        return np.concatenate(codes), np.concatenate(owners), None, pa.concat_arrays(spelt)


class CharWb:
    """Character n-grams lo..hi inside space-padded words (see
    ``functions.text.char_wb_ngrams``), made once for each different word."""

    def __init__(self, text: str = "text", lo: int = 3, hi: int = 5):
        self.text, self.lo, self.hi = text, lo, hi

    def tokens(self):
        return X.ws_words(F.lower(F.col(self.text)))

    def _of(self, word: str) -> list[str]:
        w = f" {word} "
        if len(w) < self.lo:
            return [w]
        return [w[i:i + n] for n in range(self.lo, self.hi + 1) for i in range(len(w) - n + 1)]

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(grams by word, their codes, dictionary) of different words. A gram is one number,
        a few bits a character; texts with too many different characters go gram by gram."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        flat = np.frombuffer(f" {joined} ".encode("utf-32-le"), np.uint32)
        char = np.unique(flat)
        bits = max(1, int(len(char) - 1).bit_length())
        length = np.asarray(pc.utf8_length(words), dtype=np.int64) + 2  # with the spaces on both sides
        if bits * self.hi > 62 or char[0] == 0 or self.lo < 1 or not len(words):  # numpy's strings lose zeros at their end
            lists = [self._of(w) for w in words.to_pylist()]
            coded = pa.array([g for x in lists for g in x], pa.string()).dictionary_encode()
            return np.array([len(x) for x in lists], dtype=np.int64), np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        place = np.zeros(int(char[-1]) + 1, np.int64)
        place[char] = np.arange(len(char))
        code = place[flat]
        first = np.cumsum(length - 1) - (length - 1)  # neighbours share their space
        many = {n: np.maximum(0, length - n + 1) if n >= self.lo else (length == n).astype(np.int64) for n in range(1, self.hi + 1)}
        size = sum(many.values())
        free, out, names, gram, base = np.cumsum(size) - size, np.empty(size.sum(), np.int64), [], np.zeros(len(code), np.int64), 0
        for n, times in many.items():
            gram = (gram[:len(code) - n + 1] << bits) | code[n - 1:]  # by the place where it begins
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            coded = pa.array(gram[np.repeat(first, times) + inside]).dictionary_encode()
            different = np.asarray(coded.dictionary)
            if len(different):
                out[np.repeat(free, times) + inside] = np.asarray(coded.indices) + base
                spelt = np.stack([char[different >> bits * k & (1 << bits) - 1] for k in reversed(range(n))], axis=1)
                names.append(pa.array(spelt.view(f"<U{n}").ravel(), pa.string()))
                free, base = free + times, base + len(different)
        return size, out, pa.concat_arrays(names)

    def grams(self, flat: pa.Array, owner: np.ndarray):
        words = flat.dictionary_encode()
        wide = max(1, len(words.dictionary))
        pair, times = np.unique(owner * wide + np.asarray(words.indices, dtype=np.int64), return_counts=True)
        doc, word = pair // wide, pair % wide
        size, coded, names = self._coded(words.dictionary)
        first = np.concatenate([[0], np.cumsum(size)])
        n = size[word]
        at = np.repeat(first[word] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64), n) + np.arange(n.sum())
        return coded[at], np.repeat(doc, n), np.repeat(times, n), names


def slices(length: np.ndarray, limit: int = SLICE):
    """(from, to) of runs of rows whose lengths sum to about ``limit``."""
    end = np.cumsum(length)
    a = 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)


def _distinct(spec, tok: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(document, code, tf, dictionary) of the distinct terms of a slice, by document and code."""
    code, own, weight, names = spec.grams(tok.flatten(), np.repeat(np.arange(len(tok)), _lengths(tok)))
    return *_summed(own, code, weight, max(1, len(names))), names


def _summed(own: np.ndarray, code: np.ndarray, weight: np.ndarray | None, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, tf) of occurrences, by document and code (below ``wide``)."""
    key = own * wide + code
    if weight is None:
        key, tf = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        tf = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
    return key // wide, key % wide, tf


def _count(spec, kept: list[str]):
    def run(batches):
        for b in batches:
            tok = b.column("_tok")
            for lo, hi in slices(_lengths(tok)):
                own, code, tf, names = _distinct(spec, tok.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in kept), _lists(own, hi - lo, names.take(pa.array(code))),
                     _lists(own, hi - lo, pa.array(tf.astype(np.int32)))], names=[*kept, "terms", "tf"])
    return run


def counted(df: DataFrame, spec, keep: Sequence[str] = ("doc",)) -> DataFrame:
    """The kept columns with ``terms`` (distinct) and ``tf`` of each row (a kept
    column of such a name should be renamed first)."""
    keep = list(keep)
    x = df.select(*keep, spec.tokens().alias("_tok"))
    schema = T.StructType([f for f in x.schema if f.name != "_tok"]).add("terms", T.ArrayType(T.StringType())).add("tf", T.ArrayType(T.IntegerType()))
    return x.mapInArrow(_count(spec, keep), schema)


def _sums(batches):
    for b in (x for whole in batches for x in pieces(whole, column="terms")):
        terms, tf = b.column("terms").flatten().dictionary_encode(), np.asarray(b.column("tf").flatten())
        code = np.asarray(terms.indices)
        n = len(terms.dictionary)
        if n:
            yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.bincount(code, minlength=n).astype(np.int64)),
                                              pa.array(np.bincount(code, weights=tf, minlength=n).astype(np.int64))], names=["term", "df", "cf"])


def term_stats(rows: DataFrame) -> DataFrame:
    """(term, df, cf), one row a term and batch before the shuffle."""
    return rows.select("terms", "tf").mapInArrow(_sums, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _tally(spec, limit: int):
    def run(batches):
        held, n = [], 0
        for b in batches:
            tok = b.column("_tok")
            for lo, hi in slices(_lengths(tok)):
                _, code, tf, names = _distinct(spec, tok.slice(lo, hi - lo))
                held.append(pa.table({"term": names, "df": np.bincount(code, minlength=len(names)).astype(np.int64),
                                      "cf": np.bincount(code, weights=tf, minlength=len(names)).astype(np.int64)}))
                n += len(names)
                if n > limit:
                    t = _added(held)
                    held, n = ([t], t.num_rows) if 2 * t.num_rows <= limit else ([], 0)
                    if not held:
                        yield from t.to_batches(max_chunksize=SENT)
        if held:
            yield from _added(held).to_batches(max_chunksize=SENT)
    return run


def _added(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
    return t.select(["term", "df_sum", "cf_sum"]).rename_columns(["term", "df", "cf"])


def text_stats(df: DataFrame, spec, limit: int = TALLY) -> DataFrame:
    """(term, df, cf) of texts, as ``term_stats`` of their counted rows, which are not
    made: a task adds its slices up, ``limit`` terms at once, before the shuffle."""
    sums = df.select(spec.tokens().alias("_tok")).mapInArrow(_tally(spec, limit), "term string, df bigint, cf bigint")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(stats: DataFrame, max_features: int, min_df: int = 1) -> DataFrame:
    """The ``max_features`` most frequent terms with df >= min_df."""
    return stats.filter(F.col("df") >= min_df).orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)


class Vectorizer:
    """Terms (by rank) with their idf. On the driver: at most ``max_features`` terms."""

    def __init__(self, terms: list[str] | pa.Array, df: np.ndarray, n_docs: int):
        self.terms = pa.array(terms, pa.string()) if isinstance(terms, list) else terms
        self.idf = np.log((1 + n_docs) / (1 + np.asarray(df, dtype=np.float64))) + 1

    @classmethod
    def fit(cls, rows: DataFrame, max_features: int, min_df: int = 1) -> "Vectorizer":
        got = vocabulary(term_stats(rows), max_features, min_df).select("term", "df").collect()
        order = [r["term"] for r in got]
        return cls(order, np.array([r["df"] for r in got], dtype=np.float64), rows.count())

    @classmethod
    def stored(cls, table: DataFrame) -> "Vectorizer":
        """From a table of ``vocabulary`` with the column n_docs."""
        got = table.orderBy(F.col("cf").desc(), "term").select("term", "df", "n_docs").toPandas()
        return cls(got["term"].tolist(), got["df"].to_numpy(np.float64), int(got["n_docs"].iloc[0]) if len(got) else 0)

    def __len__(self) -> int:
        return len(self.terms)

    def weigh(self, terms, tf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, idx, w) of lists of terms and counts, by row and idx."""
        length = np.asarray(pc.fill_null(pc.list_value_length(terms), 0), dtype=np.int64)
        idx = pc.fill_null(pc.index_in(terms.flatten(), self.terms), -1)
        idx = np.asarray(idx, dtype=np.int64)
        row, tf = np.repeat(np.arange(len(length)), length), np.asarray(tf.flatten(), dtype=np.float64)
        good = idx >= 0
        row, idx, tf = row[good], idx[good], tf[good]
        order = np.argsort(row * max(1, len(self)) + idx, kind="stable")
        row, idx, tf = row[order], idx[order], tf[order]
        w = (1 + np.log(tf)) * self.idf[idx] if len(idx) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(length)))
        return row, idx, w / norm[row] if len(row) else w

    def place(self, spec, tok: pa.Array):
        """(document, idx, tf) of the known terms of a slice, by document and idx."""
        code, own, weight, names = spec.grams(tok.flatten(), np.repeat(np.arange(len(tok)), _lengths(tok)))
        idx = np.asarray(pc.fill_null(pc.index_in(names, self.terms), -1), dtype=np.int64)[code]
        good = idx >= 0
        return _summed(own[good], idx[good], None if weight is None else weight[good], max(1, len(self)))

    @property
    def scale(self) -> "Scale":
        return Scale([self.idf])

    def known(self, df: DataFrame, spec, keep: Sequence[str]) -> DataFrame:
        """(kept columns, idx, tf) of texts."""
        return Union({"": self}).known(df, {"": spec}, keep)

    def text_weights(self, df: DataFrame, spec, doc: str = "doc") -> DataFrame:
        """(doc, term, idx, weight) of texts in one step."""
        x = df.select(doc, spec.tokens().alias("_tok"))
        here = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([x.schema[doc]]).add("term", T.StringType()).add("idx", T.IntegerType()).add("weight", T.DoubleType())

        def run(batches):
            v = here.value
            scale = v.scale
            for b in batches:
                tok, ids = b.column("_tok"), b.column(doc)
                for lo, hi in slices(_lengths(tok), PLACED):
                    own, idx, tf = v.place(spec, tok.slice(lo, hi - lo))
                    w = scale.weights(own, idx, tf, hi - lo)
                    out = pa.table({doc: ids.slice(lo, hi - lo).take(pa.array(own)), "term": v.terms.take(pa.array(idx)), "idx": idx.astype(np.int32), "weight": w})
                    yield from out.to_batches(max_chunksize=SENT)
        return x.mapInArrow(run, schema)

    def rows(self, counted_rows: DataFrame) -> DataFrame:
        """(kept columns, idx, w)."""
        keep = [c for c in counted_rows.columns if c not in ("terms", "tf")]
        schema = T.StructType([counted_rows.schema[c] for c in keep]).add("idx", T.ArrayType(T.IntegerType())).add("w", T.ArrayType(T.DoubleType()))
        here = counted_rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            v = here.value
            for b in (x for whole in batches for x in pieces(whole, column="terms")):
                row, idx, w = v.weigh(b.column("terms"), b.column("tf"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _lists(row, b.num_rows, pa.array(idx.astype(np.int32))),
                                                  _lists(row, b.num_rows, pa.array(w))], names=[*keep, "idx", "w"])
        return counted_rows.mapInArrow(run, schema)

    def weights(self, rows: DataFrame, doc: str = "doc") -> DataFrame:
        """(doc, term, idx, weight): sparse rows in the long form."""
        here = rows.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([rows.schema[doc]]).add("term", T.StringType()).add("idx", T.IntegerType()).add("weight", T.DoubleType())

        def run(batches):
            for b in batches:
                length = np.asarray(pc.list_value_length(b.column("idx")), dtype=np.int64)
                idx = b.column("idx").flatten()
                yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(np.repeat(np.arange(b.num_rows), length))), here.value.terms.take(idx), idx,
                                                  b.column("w").flatten()], names=[doc, "term", "idx", "weight"])
        return rows.select(doc, "idx", "w").mapInArrow(run, schema)


class Union:
    """Several vectorizers side by side, each normalised by itself: the columns of
    the second begin where those of the first end, and so on. ``names`` are the
    prefixes of their columns of counted rows ('' for terms and tf)."""

    def __init__(self, parts: dict[str, Vectorizer]):
        self.parts = parts

    def __len__(self) -> int:
        return sum(map(len, self.parts.values()))

    @property
    def scale(self) -> "Scale":
        return Scale([v.idf for v in self.parts.values()])

    def known(self, df: DataFrame, specs: dict, keep: Sequence[str]) -> DataFrame:
        """(kept columns, idx, tf) of texts: every part counts its own terms (``specs``)
        in the same step."""
        keep = list(keep)
        x = df.select(*keep, *[spec.tokens().alias(f"_tok{p}") for p, spec in specs.items()])
        schema = T.StructType([x.schema[c] for c in keep]).add("idx", T.ArrayType(T.IntegerType())).add("tf", T.ArrayType(T.IntegerType()))
        here = df.sparkSession.sparkContext.broadcast(self.parts)

        def run(batches):
            for b in batches:
                toks = {p: b.column(f"_tok{p}") for p in specs}
                for lo, hi in slices(sum(map(_lengths, toks.values())), PLACED):
                    got, base = [], 0
                    for p, v in here.value.items():
                        row, idx, tf = v.place(specs[p], toks[p].slice(lo, hi - lo))
                        got.append((row, idx + base, tf))
                        base += len(v)
                    row, idx, tf = (np.concatenate(z) for z in zip(*got))
                    order = np.argsort(row, kind="stable")
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), _lists(row, hi - lo, pa.array(idx[order].astype(np.int32))),
                                                      _lists(row, hi - lo, pa.array(tf[order].astype(np.int32)))], names=[*keep, "idx", "tf"])
        return x.mapInArrow(run, schema)


#: 1 + ln(tf) of small counts; 0 does not occur.
LOGS = 1 + np.log(np.maximum(np.arange(256), 1).astype(np.float64))


class Scale:
    """Weights of known terms: idf by column, in blocks that are normalised each by itself."""

    def __init__(self, blocks: list[np.ndarray]):
        self.idf, self.ends = np.concatenate(blocks), np.cumsum([len(x) for x in blocks])

    def __len__(self) -> int:
        return len(self.idf)

    def weights(self, row: np.ndarray, idx: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
        if not len(idx):
            return np.zeros(0)
        w = (np.take(LOGS, tf) if int(tf.max()) < len(LOGS) else 1 + np.log(tf.astype(np.float64))) * self.idf[idx]
        of = row if len(self.ends) == 1 else row * len(self.ends)
        for end in self.ends[:-1]:
            of = of + (idx >= end)
        norm = np.sqrt(np.bincount(of, weights=w * w, minlength=rows * len(self.ends)))
        return w / norm[of]


#: Writer options for known rows: ascending idx as differences.
COMPACT = {"parquet.writer.version": "v2", "parquet.enable.dictionary#idx.list.element": "false", "parquet.enable.dictionary#tf.list.element": "false"}
#: Entries of sparse rows that are worked on at once.
PIECE = 1 << 18


def pieces(b: pa.RecordBatch, limit: int = PIECE, column: str = "idx"):
    """A batch of sparse (or counted) rows as runs of about ``limit`` entries."""
    for lo, hi in slices(_lengths(b.column(column)) + 1, limit):
        yield b.slice(lo, hi - lo)


def csr(b: pa.RecordBatch, scale: Scale | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, w) of a batch of sparse rows (idx, w), with ``scale`` of (idx, tf)."""
    length = _lengths(b.column("idx"))
    row, idx = np.repeat(np.arange(b.num_rows), length), np.asarray(b.column("idx").flatten(), dtype=np.int64)
    if scale is None:
        return row, idx, np.asarray(b.column("w").flatten(), dtype=np.float64)
    return row, idx, scale.weights(row, idx, np.asarray(b.column("tf").flatten()), b.num_rows)


def packed(rows: DataFrame, keep: Sequence[str], value: str, limit: int = PIECE) -> DataFrame:
    """Sparse rows for many passes: (rows), a compressed record of about ``limit`` entries
    each. Of lists the JVM hands over every single entry, of a record only its bytes. ``idx``
    lies there as the low byte and the rest of its differences."""
    keep = list(keep)

    def run(batches):
        for b in (x for whole in batches for x in pieces(whole, limit)):
            offsets = pa.array(np.append(0, np.cumsum(_lengths(b.column("idx")))).astype(np.int32))
            step = np.diff(np.asarray(b.column("idx").flatten()).astype(np.int32), prepend=np.int32(0))  # below 0 where a row begins
            values = np.asarray(b.column(value).flatten())
            if value == "tf" and len(values):
                values = values.astype(np.min_scalar_type(int(values.max())))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((step & 255).astype(np.uint8), step >> 8, values)]
            one = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists], names=[*keep, "low", "high", value])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(one)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])
    return rows.select(*keep, "idx", value).mapInArrow(run, "rows binary")


def unpacked(batches, keep: Sequence[str], value: str):
    """The batches of sparse rows (kept columns, idx, value) of ``packed`` records."""
    for blob in (x for b in batches for x in b.column("rows")):
        b = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
        low, high = (np.asarray(b.column(c).flatten()) for c in ("low", "high"))
        idx = pa.ListArray.from_arrays(b.column("low").offsets, pa.array(np.cumsum(high << 8 | low, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), idx, b.column(value)], names=[*keep, "idx", value])


def scaled(known: DataFrame, scale: Scale) -> DataFrame:
    """(kept columns, idx, w) of rows (kept columns, idx, tf)."""
    keep = [c for c in known.columns if c not in ("idx", "tf")]
    schema = T.StructType([known.schema[c] for c in keep]).add("idx", T.ArrayType(T.IntegerType())).add("w", T.ArrayType(T.DoubleType()))
    here = known.sparkSession.sparkContext.broadcast(scale)

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                row, _, w = csr(b, here.value)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("idx"), _lists(row, b.num_rows, pa.array(w))], names=[*keep, "idx", "w"])
    return known.select(*keep, "idx", "tf").mapInArrow(run, schema)


def class_sums(rows: DataFrame, label: str, scale: Scale | None = None, limit: int = TALLY) -> DataFrame:
    """(label, idx, total, documents): sums of the weights by class and term, added up in
    the task (``limit`` sums at once) before the shuffle; idx -1 counts the documents."""
    schema = T.StructType([T.StructField("label", rows.schema[label].dataType)]).add("idx", T.IntegerType()).add("total", T.DoubleType())
    here = rows.sparkSession.sparkContext.broadcast(scale)

    def added(held):
        t = pa.concat_tables(held).group_by(["label", "idx"], use_threads=False).aggregate([("total", "sum")])
        return t.select(["label", "idx", "total_sum"]).rename_columns(["label", "idx", "total"])

    def run(batches):
        held, size = [], 0
        for b in (x for whole in batches for x in pieces(whole)):
            names = b.column(label).dictionary_encode()
            code = np.asarray(pc.fill_null(names.indices, -1), dtype=np.int64)
            row, idx, w = csr(b, here.value)
            good = code[row] >= 0
            row, idx, w = row[good], idx[good], w[good]
            wide = int(idx.max()) + 1 if len(idx) else 1
            key, inverse = np.unique(code[row] * wide + idx, return_inverse=True)
            total = np.bincount(inverse, weights=w, minlength=len(key))
            n = np.bincount(code[code >= 0], minlength=len(names.dictionary))
            which = np.concatenate([key // wide, np.arange(len(n))])
            held.append(pa.table({"label": names.dictionary.take(pa.array(which)), "idx": np.concatenate([key % wide, np.full(len(n), -1)]).astype(np.int32),
                                  "total": np.concatenate([total, n.astype(np.float64)])}))
            size += len(which)
            if size > limit:
                t = added(held)
                held, size = ([t], t.num_rows) if 2 * t.num_rows <= limit else ([], 0)
                if not held:
                    yield from t.to_batches(max_chunksize=SENT)
        if held:
            yield from added(held).to_batches(max_chunksize=SENT)
    return rows.select(label, "idx", "w" if scale is None else "tf").mapInArrow(run, schema).groupBy("label", "idx").agg(F.sum("total").alias("total"))
