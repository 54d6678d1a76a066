"""Quality rules by distribution divergence.

Every document gets a histogram of its character classes and one of the
common words of its language; each is compared by Jensen-Shannon distance
(base 2, square root of the divergence) with the same histogram of the whole
language. A document that diverges too far in either is rejected.

* Common words of a language: at least ``COMMON`` of all its words. They are
  found exactly: a word that common overall is at least half that common in
  chunks that hold at least half of that mass, so each chunk reports its local
  candidates only (at most 2 / COMMON), and a second pass counts them exactly.
* Guards: the character test needs ``MIN_CHARS`` classed characters, the word
  test ``MIN_WORDS`` words; a language needs ``MIN_LANG_WORDS`` words to serve
  as a reference. Without them a test passes.
* Base rules (always): under 20 words, or more than 30 % of the words in
  repeated 8-word windows.

Nulls: a null text counts as empty (base rule rejects it); a null language
counts as the empty one. Repeated rows are judged each for itself. Very long texts
are judged whole. Other columns, whatever their names, are not read by the
verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

COMMON = 1 / 200
MIN_CHARS, MIN_WORDS, MIN_LANG_WORDS = 300, 50, 2000
MAX_CHAR_JS, MAX_WORD_JS = 0.32, 0.45
MAX_BROADCAST_LANGS = 1000
MIN_BASE_WORDS, MAX_REPEAT_PCT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "newline", "punctuation", "symbol", "other ascii", "beyond ascii")


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 get none (-1)."""
    t = np.full(256, 7, dtype=np.int8)
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = 0, 1, 2
    t[[0x20, 9, 11, 12, 13]], t[10] = 3, 4
    t[list(b".,;:!?'\"()-")] = 5
    t[list(SYMBOLS)] = 6
    t[0x80:0xC0], t[0xC0:] = -1, 8
    return t


_CLASS = _class_table()
_IS_SYMBOL = _CLASS == 6


def _lower_hashes(c: T.Chunk) -> np.ndarray:
    """Fingerprints of the words with ASCII capitals folded."""
    d = c.data
    low = np.where((d >= 65) & (d <= 90), d + 32, d)
    return T.Chunk(low, c.off, c.rows).byte_rolling().spans(c.ws, c.we)


def _candidates(batches):
    """Per chunk and language: words at least half as common as COMMON, and
    (word 0) the number of words."""
    for b in batches:
        lang = b.column("lang").fill_null("").to_pylist()
        for c in T.chunks(b.column("text")):
            c.words()
            h = _lower_hashes(c)
            of = np.asarray(lang[c.rows], dtype=object)
            names, code = np.unique(of, return_inverse=True)
            wcode = code[c.wdoc]
            out: list[tuple] = []
            for k, name in enumerate(names):
                hk = h[wcode == k]
                if len(hk):
                    u, n = np.unique(hk, return_counts=True)
                    out.append((name, 0, len(hk)))
                    big = n >= COMMON / 2 * len(hk)
                    out += [(name, int(x), int(y)) for x, y in zip(u[big].view(np.int64), n[big]) if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                                                  pa.array([r[2] for r in out], pa.int64())], names=["lang", "word", "n"])


def common_candidates(docs: DataFrame) -> dict[str, list[int]]:
    """Candidate common words by language, on the driver: at most 2 / COMMON
    for each language that has MIN_LANG_WORDS words."""
    rows = docs.select("lang", "text").mapInArrow(_candidates, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "quality-candidates")
    total = rows.filter("word = 0").select("lang", F.col("n").alias("total")).filter(F.col("total") >= MIN_LANG_WORDS)
    kept = rows.filter("word <> 0").join(total, "lang").filter(F.col("n") >= COMMON / 2 * F.col("total"))
    out: dict[str, list[int]] = {}
    for r in kept.select("lang", "word").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return {k: sorted(v) for k, v in out.items()}


MEASURES = ("doc_id bigint, lang string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, classes array<bigint>, common array<bigint>")


def _measure(c: T.Chunk, lang: list[str], cand: dict[str, np.ndarray]) -> list[np.ndarray | list]:
    c.words()
    d, nd = c.data, c.n
    roll = c.byte_rolling()
    doc_of_byte = np.repeat(np.arange(nd), np.diff(c.off))
    cls = _CLASS[d]
    seen = cls >= 0
    classes = np.bincount(doc_of_byte[seen] * len(CLASSES) + cls[seen], minlength=nd * len(CLASSES)).reshape(nd, -1)
    n_words = np.diff(c.woff)
    chars = seen & ~T._SPACE[d]
    word_chars = T.per_doc_sum(chars, c.off)
    n_symbols = T.per_doc_sum(_IS_SYMBOL[d], c.off)
    # lines: between document starts and line feeds
    nl = np.flatnonzero(d == 10)
    ls = np.unique(np.concatenate([c.off[:-1][np.diff(c.off) > 0], nl + 1]))
    ls = ls[ls < len(d)] if len(d) else ls[:0]
    ldoc = np.searchsorted(c.off, ls, side="right") - 1
    ends = np.append(nl, len(d))
    le = np.minimum(ends[np.searchsorted(nl, ls, side="left")], c.off[ldoc + 1])
    inked = np.searchsorted(c.ws, ls) < np.searchsorted(c.ws, le)
    ls, le, ldoc = ls[inked], le[inked], ldoc[inked]
    _, later = T.repeat_ranks(roll.spans(ls, le), ldoc)
    n_dup_lines = np.bincount(ldoc[later], minlength=nd)
    # words in 8-word windows that occur twice or more
    wh = c.word_hashes(roll)
    w8 = T.Rolling(wh).windows(REPEAT_WINDOW)
    ok = np.flatnonzero(c.wdoc[:len(w8)] == c.wdoc[REPEAT_WINDOW - 1:]) if len(w8) else np.zeros(0, np.int64)
    many = T.repeated_in_doc(w8[ok], c.wdoc[ok])
    covered = T.cover(ok[many], REPEAT_WINDOW, len(wh))
    n_repeat = T.per_doc_sum(covered, c.woff)
    # counts of the language's candidate words
    common: list[list[int]] = [[] for _ in range(nd)]
    low = _lower_hashes(c).view(np.int64)
    of = np.asarray(lang, dtype=object)
    for name in set(lang):
        words = cand.get(name)
        if words is None:
            continue
        mine = np.flatnonzero(of == name)
        slot = np.full(nd, -1)
        slot[mine] = np.arange(len(mine))
        wsel = slot[c.wdoc] >= 0
        x, s = low[wsel], slot[c.wdoc][wsel]
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        hit = words[at] == x
        counts = np.bincount(s[hit] * len(words) + at[hit], minlength=len(mine) * len(words)).reshape(len(mine), -1)
        for i, row in zip(mine, counts):
            common[i] = row.tolist()
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, classes.tolist(), common]


def _measures(cand: dict[str, list[int]]):
    def run(batches):
        words = {k: np.asarray(v, dtype=np.int64) for k, v in cand.items() if v}
        for b in batches:
            lang = b.column("lang").fill_null("").to_pylist()
            for c in T.chunks(b.column("text")):
                m = _measure(c, lang[c.rows], words)
                part = b.slice(c.rows.start, c.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang[c.rows], pa.string()), part.column("text_key")]
                    + [pa.array(x, pa.int64()) for x in m[:5]] + [pa.array(x, pa.list_(pa.int64())) for x in m[5:]],
                    names=[x.split()[0] for x in MEASURES.split(", ")])
    return run


def _js(p, q, sp, sq):
    """Jensen-Shannon distance of two count arrays with the sums sp, sq."""
    def term(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    shares = F.zip_with(p, q, lambda a, b: F.struct((a / sp).alias("a"), (b / sq).alias("b")))
    total = F.aggregate(shares, F.lit(0.0), lambda acc, e: acc + term(e["a"], (e["a"] + e["b"]) / 2) + term(e["b"], (e["a"] + e["b"]) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``char_js``, ``word_js``,
    ``base_failed`` and ``kept``."""
    docs = T.strip_columns(docs, "doc_id", "lang", "text").withColumn("text_key", F.xxhash64("text"))
    cand = common_candidates(docs)
    m = materialize(docs.mapInArrow(_measures(cand), MEASURES), "quality-measures")

    def total(col):
        return m.select("lang", F.posexplode(col).alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n")) \
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("z")) \
            .select("lang", F.transform("z", lambda e: e["n"]).alias(f"ref_{col}"))
    words = m.filter(F.col("lang").isin(sorted(cand))).groupBy("lang").agg(F.sum("n_words").alias("ref_words"))
    refs = words.join(total("classes"), "lang", "left").join(total("common"), "lang", "left")
    refs = refs.select("lang", "ref_words", "ref_classes", "ref_common")
    # one row for each language with a reference, counted above
    j = m.join(F.broadcast(refs) if len(cand) <= MAX_BROADCAST_LANGS else refs, "lang", "left")
    # exactly the common words; everything else is one class of its own
    def pick(col):
        z = F.zip_with(col, "ref_common", lambda a, r: F.struct(a.alias("a"), r.alias("r")))
        return F.transform(F.filter(z, lambda e: e["r"] >= COMMON * F.col("ref_words")), lambda e: e["a"])
    def whole(a, n):
        return F.concat(a, F.array(n - F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)))
    j = j.withColumn("p", whole(pick("common"), F.col("n_words"))).withColumn("q", whole(pick("ref_common"), F.col("ref_words")))
    n_chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda x, y: x + y)
    ref_chars = F.aggregate("ref_classes", F.lit(0).cast("bigint"), lambda x, y: x + y)
    guard = F.col("ref_words") >= MIN_LANG_WORDS
    char_js = F.when(guard & (n_chars >= MIN_CHARS), _js(F.col("classes"), F.col("ref_classes"), n_chars, ref_chars))
    word_js = F.when(guard & (F.col("n_words") >= MIN_WORDS) & (F.size("p") > 1),
                     _js(F.col("p"), F.col("q"), F.col("n_words"), F.col("ref_words")))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    out = j.select("doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   char_js.alias("char_js"), word_js.alias("word_js"), failed.alias("base_failed"))
    ok = F.coalesce(F.col("char_js") <= MAX_CHAR_JS, F.lit(True)) & F.coalesce(F.col("word_js") <= MAX_WORD_JS, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & ok)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Verdicts are joined by
    (doc_id, language, text fingerprint), on which they depend."""
    tagged = docs.select(F.col("doc_id").alias("_d"), F.coalesce(F.col("lang"), F.lit("")).alias("_l"), F.xxhash64("text").alias("_h"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    v = assess(docs).filter("kept").select("doc_id", "lang", "text_key")
    j = tagged.join(v, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_l") == F.col("lang")) & (F.col("_h") == F.col("text_key")), "left_semi")
    return j.select("_row.*")
