"""Benchmark decontamination: a BM25 inverted index of the test items, queried
by every passage of every document with block-max WAND; hits are verified by
the overlap with the item's question and answer.

* Statistics: number of items, mean and greatest length and the document frequency
  of every term are aggregates over all items, so a hit and its score do not
  depend on the order of the items nor on how they are cut into blocks.
* Index: the items (the small side) in blocks of at most ``BLOCK_ITEMS``; ``PASS``
  blocks' indexes are the broadcast of one pass over the documents, so its size
  is bounded and more items mean more passes. Scores are shares of the item's
  score with itself, so one ``THRESHOLD`` serves all items.
* Passages: 2 S tokens every S tokens, S the longest of all items; every
  occurrence of an item lies whole in some passage. They are bounded ``CELLS``
  numbers at a time, however long the document.
* Skipping: in each chunk an item's terms are taken from the rarest there until
  the others together weigh less than ``REST``. What a passage holds of these,
  plus REST at most, bounds its score with the item; passages that reach the
  threshold with no item are left out before the index is walked. The bound is
  exact and drops no hit. The passages left walk
  the postings with block-max WAND and get *all* items above the threshold.
* Verification: 5-token shingles. A hit is an item of which the passage holds
  at least ``OVERLAP`` of the question and of the answer (the last sentence), or of
  both together.

Tokens are runs of letters, digits and non-ASCII characters, ASCII capitals
folded, so punctuation, line breaks and case do not hide a copy. Null and empty
texts and items have no hits; an item of fewer than five tokens is one shingle.
Repeated items are items of their own; repeated rows are searched each for
itself. Empty tables give empty results. Long documents are searched whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
BLOCK_ITEMS, POSTING_BLOCK, REST, PASS, CELLS = 2000, 64, 0.1, 4, 1 << 22


def _tokens(text: str) -> np.ndarray:
    return T.Tokens(next(T.chunks(pa.array([text], pa.string())))).h if text else np.zeros(0, np.uint64)


def _shingles(h: np.ndarray) -> tuple[np.ndarray, int]:
    """(distinct shingles, their width)."""
    k = min(SHINGLE, max(1, len(h)))
    return np.unique(T.Rolling(h).windows(k)), k


def _overlap(part: tuple[np.ndarray, int], h: np.ndarray) -> float:
    """Share of a part's shingles that stand in a passage; 1 for an empty part."""
    shingles, k = part
    return float(np.isin(shingles, T.Rolling(h).windows(k)).mean()) if len(shingles) else 1.0


def question_answer(text: str) -> tuple[str, str]:
    """An item's last sentence or line is its answer, what stands before it its
    question; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) < 2:
        return text, text
    at = text.rindex(parts[-1])
    return text[:at], text[at:]


class Index:
    """Inverted index of one block of items, as arrays. ``corpus``: (items, mean
    length, greatest length, terms in order, their document frequencies) of all
    items; without it the block is all there is."""

    def __init__(self, items: list[tuple[int, str]], corpus: tuple | None = None):
        toks = [(i, t, _tokens(t)) for i, t in items if t]
        toks = [x for x in toks if len(x[2])]
        self.ids = [x[0] for x in toks]
        self.size = len(toks)
        self.width = max([32, *(len(x[2]) for x in toks)] if corpus is None else [32, corpus[2]])
        if not toks:
            return
        self.parts = []
        for _, text, h in toks:
            q, a = question_answer(text)
            self.parts.append((_shingles(_tokens(q)), _shingles(_tokens(a)), _shingles(h)))
        h = np.concatenate([x[2] for x in toks])
        item = np.repeat(np.arange(self.size), [len(x[2]) for x in toks])
        self.vocab, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * self.size + item, return_counts=True)
        self.term, self.item = pair // self.size, pair % self.size  # by term, then item
        length = np.bincount(item, minlength=self.size)
        if corpus is None:
            n, mean, df = self.size, length.mean(), np.bincount(self.term, minlength=len(self.vocab))
        else:
            n, mean, df = corpus[0], corpus[1], corpus[4][np.searchsorted(corpus[3], self.vocab)]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        w = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item] / mean))
        self.w = w / np.bincount(self.item, weights=w, minlength=self.size)[self.item]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocab) + 1))

    def essential(self, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flag of each posting, mass of each item outside its flagged ones):
        per item the rarest terms until the rest weighs less than ``REST``."""
        order = np.lexsort((freq[self.term], self.item))
        w, item = self.w[order], self.item[order]
        run = np.cumsum(w)
        start = np.searchsorted(item, np.arange(self.size))
        before = run - w - (run - w)[start][item]
        flag = np.zeros(len(w), bool)
        flag[order] = before <= 1 - REST + 1e-9
        rest = 1 - np.bincount(self.item[flag], weights=self.w[flag], minlength=self.size)
        return flag, rest

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score with these distinct terms reaches the threshold."""
        cur = []  # [item, at, end, greatest weight, term]
        for t in terms:
            a, b = int(self.first[t]), int(self.first[t + 1])
            cur.append([int(self.item[a]), a, b, float(self.w[a:b].max())])
        out = []
        while cur:
            cur.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                bound += c[3]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            goal = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == goal:
                pivot += 1
            # block maxima of the lists up to the pivot, where the goal would stand
            tight, upto = 0.0, None
            for c in cur[:pivot + 1]:
                at = c[1] + int(np.searchsorted(self.item[c[1]:c[2]], goal))
                stop = min(c[2], at + POSTING_BLOCK)
                if at < c[2]:
                    tight += float(self.w[at:stop].max())
                    last = int(self.item[stop - 1])
                    upto = last if upto is None else min(upto, last)
            if tight >= THRESHOLD - 1e-9:
                score, goto = 0.0, goal + 1
                for c in cur[:pivot + 1]:
                    at = c[1] + int(np.searchsorted(self.item[c[1]:c[2]], goal))
                    if at < c[2] and self.item[at] == goal:
                        score += float(self.w[at])
                if score >= THRESHOLD - 1e-9:
                    out.append((goal, score))
            else:
                # no item up to the nearest end of these blocks can do better
                goto = goal + 1 if upto is None else upto + 1
                if pivot + 1 < len(cur):
                    goto = min(goto, cur[pivot + 1][0])
                goto = max(goto, goal + 1)
            left = []
            for c in cur:
                if c[0] < goto:
                    at = c[1] + int(np.searchsorted(self.item[c[1]:c[2]], goto))
                    if at >= c[2]:
                        continue
                    c[0], c[1] = int(self.item[at]), at
                left.append(c)
            cur = left
        return out

    def search(self, c: T.Chunk) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """(document of the chunk, item) -> (score, question overlap, answer
        overlap, first token of the best passage) of the verified hits."""
        tok = T.Tokens(c)
        at = np.minimum(np.searchsorted(self.vocab, tok.h), len(self.vocab) - 1)
        pos = np.flatnonzero(self.vocab[at] == tok.h)
        tid = at[pos]
        if not len(pos):
            return {}
        flag, rest = self.essential(np.bincount(tid, minlength=len(self.vocab)))
        n_tok = np.diff(tok.off)
        n_pas = np.maximum(1, -(-n_tok // self.width) - 1)
        pas_off = np.zeros(c.n + 1, np.int64)
        np.cumsum(n_pas, out=pas_off[1:])
        # flagged postings by term
        ft, fi, fw = self.term[flag], self.item[flag], self.w[flag]
        ffirst = np.searchsorted(ft, np.arange(len(self.vocab) + 1))
        deg = np.diff(ffirst)
        sel = deg[tid] > 0
        p, t = pos[sel], tid[sel]
        if not len(p):
            return {}
        doc = tok.doc[p]
        j = (p - tok.off[doc]) // self.width
        here, prev = pas_off[doc] + np.minimum(j, n_pas[doc] - 1), pas_off[doc] + j - 1
        two = (j > 0) & (prev != here)
        pas, t = np.concatenate([here, prev[two]]), np.concatenate([t, t[two]])
        pt = np.unique(pas * len(self.vocab) + t)
        pas, t = pt // len(self.vocab), pt % len(self.vocab)
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for q in self._open(pas, t, int(pas_off[-1]), deg, ffirst, fi, fw, rest):
            d = int(np.searchsorted(pas_off, q, side="right")) - 1
            a = int(tok.off[d]) + (q - int(pas_off[d])) * self.width
            b = min(a + 2 * self.width, int(tok.off[d + 1]))
            if q == pas_off[d + 1] - 1:
                b = int(tok.off[d + 1])
            lo, hi = np.searchsorted(pos, [a, b])
            for item, score in self.wand(np.unique(tid[lo:hi])):
                share = [_overlap(part, tok.h[a:b]) for part in self.parts[item]]
                if (share[0] >= OVERLAP and share[1] >= OVERLAP) or share[2] >= OVERLAP:
                    old = found.get((d, item))
                    if old is None or (share[2], score) > (old[4], old[0]):
                        found[d, item] = (score, share[0], share[1], a - int(tok.off[d]), share[2])
        return {k: v[:4] for k, v in found.items()}


    def _open(self, pas, t, n_pas, deg, ffirst, fi, fw, rest):
        """The passages that may reach the threshold with some item, in order; the
        bounds of some passages with all items are held at once."""
        step = max(1, CELLS // self.size)
        for p0 in range(0, n_pas, step):
            lo, hi = np.searchsorted(pas, [p0, p0 + step])
            rep = deg[t[lo:hi]]
            base = np.repeat(ffirst[t[lo:hi]] - np.concatenate([[0], np.cumsum(rep)[:-1]]), rep) + np.arange(rep.sum()) if hi > lo else np.zeros(0, np.int64)
            bound = np.bincount(np.repeat(pas[lo:hi] - p0, rep) * self.size + fi[base], weights=fw[base], minlength=min(step, n_pas - p0) * self.size)
            yield from (p0 + np.flatnonzero((bound.reshape(-1, self.size) + rest >= THRESHOLD - 1e-9).any(axis=1))).tolist()


SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_token bigint"


def _hits(indexes: list[Index]):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for c in T.chunks(b.column("text")):
                for index in indexes:
                    for (d, item), (score, q, a, at) in sorted(index.search(c).items()):
                        rows.append((ids[c.rows.start + d], index.ids[item], score, q, a, at))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in SCHEMA.split(", ")], r)) for r in rows],
                                                 schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                                                                   ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
                                                                   ("first_token", pa.int64())]))
    return run


def _clean(indexes: list[Index], column: str):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for c in T.chunks(b.column(column)):
                for index in indexes:
                    for d, _ in index.search(c):
                        keep[c.rows.start + d] = False
            yield b.filter(pa.array(keep))
    return run


ITEMS = "item_id bigint, text string, n_tokens bigint, terms array<bigint>"


def _item_terms(batches):
    for b in batches:
        texts = b.column("text").fill_null("").to_pylist()
        tok = [_tokens(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in tok], pa.int64()),
                                          pa.array([np.unique(x).view(np.int64).tolist() for x in tok], pa.list_(pa.int64()))],
                                         names=["item_id", "text", "n_tokens", "terms"])


def passes(items: DataFrame, block: int | None = None, at_once: int = PASS):
    """The indexes, ``at_once`` blocks of at most ``block`` items at a time. Items come to
    the driver one block at a time, with the document frequencies of their terms."""
    block = block or BLOCK_ITEMS
    rows = T.strip_columns(items, "item_id", "text").mapInArrow(_item_terms, ITEMS).filter("n_tokens > 0")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate-items")
    n, mean, longest = rows.agg(F.count(F.lit(1)), F.avg("n_tokens"), F.max("n_tokens")).first()
    term = rows.select("row", F.explode("terms").alias("term"))
    df = term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    per = term.join(df, "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("df"))  # an item's distinct terms
    per = materialize(rows.select("row", "item_id", "text").join(per, "row").orderBy("row"), "decontaminate-frequencies")
    held, known, out = [], {}, []

    def index():
        terms = np.array(list(known), np.int64).view(np.uint64)
        order = np.argsort(terms)
        return Index(held, (n, mean, longest, terms[order], np.array(list(known.values()), np.int64)[order]))
    for r in per.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        known.update((x["term"], x["df"]) for x in r["df"])
        if len(held) == block:
            out.append(index())
            held, known = [], {}
            if len(out) == at_once:
                yield out
                out = []
    if held:
        out.append(index())
    if out:
        yield out


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (document, item) hit."""
    d = T.strip_columns(docs, "doc_id", "text")
    out = None
    for some in passes(items):
        part = d.mapInArrow(_hits(some), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, all columns."""
    at = docs.columns.index("text")
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for some in passes(items):
        out = out.mapInArrow(_clean(some, f"c{at}"), out.schema)
    return out.toDF(*docs.columns)
