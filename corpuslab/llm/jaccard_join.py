"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles
is at least ``THRESHOLD`` (0.8).

* Equal texts are one node; only different texts are compared.
* Forest: each text has a signature of ``DEPTH`` 16-bit MinHash values in each of
  ``TREES`` trees. The signatures of all trees are sorted (range-partitioned), so a
  sorted run is a prefix trie; a text's longest common prefix with its neighbours
  there is the depth at which it has company in the tree.
* Prefixes are shortened level by level, from ``DEPTH`` down by ``STEP``. At each level
  the texts under a common prefix are candidates and are verified at once. A text
  is settled, and asks for no shorter prefix, when the links found so far show that
  the recall aimed at is reached: a link as weak as its weakest one less ``MARGIN``
  would have been found with probability ``RECALL`` by the prefixes searched. Others
  (all texts without a link among them) go on to the level at which a pair at the
  threshold itself is found with that probability (``floor_depth``: 4 for these
  constants). Pairs of two settled texts are skipped; all others of the level are not.
* Candidates are texts that share a trie node. A pair that meets in several trees
  is treated in the first one only, and at one level only. A node with many texts is
  cut into blocks of about ``BLOCK`` and pairs of blocks, each a small task of its own,
  so no node is gathered whole and candidate pairs are never rows.
* Verification: the shingle sets go to the blocks in which a text has a
  candidate, once for each; intersections are exact. A block answers with one
  row a text: its number of links, the weakest of them and its component there.
* Classes: connected components of the links by alternating large-star and
  small-star steps, each written to the shared folder.

Result: one row per input row: doc_id, class_id (smallest doc_id of the class),
text_id (smallest doc_id with the same text), n_copies (rows with that text) and
n_links (different texts linked to it).

Words are runs of bytes other than 0x20 and 0x09-0x0D; a text of fewer than five
words is one shingle; texts without words link to nothing but their equals. Null
texts count as empty, a null doc_id as the largest id (and is returned as
null). Very long texts are compared whole; other columns, whatever their names,
are not read by the join. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import repeats as R
from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH, STEP, MARGIN, BLOCK, MATRIX = 16, 8, 2, 0.05, 512, 4096
SET_BYTES = 1 << 16
_rng = np.random.default_rng(71)
_MUL = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * T.U(2) + T.U(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def reached(depth: int, similarity: float) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity ** depth) ** TREES


def floor_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with
    probability ``recall``; no text needs a shorter one."""
    return next((n for n in range(DEPTH, 1, -1) if reached(n, threshold) >= recall), 1)


def levels(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """Prefix lengths in the order searched, longest first."""
    low = floor_depth(threshold, recall)
    return [*range(DEPTH, low, -STEP), low]


def settling(depth: int, recall: float = RECALL) -> float:
    """A text whose weakest link is at least this similar has reached the recall
    with prefixes of ``depth`` values."""
    return (1 - (1 - recall) ** (1 / TREES)) ** (1 / depth) + MARGIN


def shingles(c: T.Chunk, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, document) of all shingles of a chunk, by document."""
    c.words()
    roll = T.Rolling(c.word_hashes())
    h = roll.windows(width)
    at = np.flatnonzero(c.wdoc[:len(h)] == c.wdoc[width - 1:]) if len(h) else np.zeros(0, np.int64)
    n = np.diff(c.woff)
    short = np.flatnonzero((n > 0) & (n < width))
    g = np.concatenate([h[at], roll.spans(c.woff[short], c.woff[short + 1])])
    doc = np.concatenate([c.wdoc[at], short])
    order = np.argsort(doc, kind="stable")
    return g[order], doc[order]


def signatures(g: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, TREES, DEPTH) 16-bit MinHash values of shingle runs beginning at ``start``."""
    out = np.zeros((len(start), TREES * DEPTH), np.uint16)
    for i in range(TREES * DEPTH):
        out[:, i] = T.mix(np.minimum.reduceat(g * _MUL[i] + _ADD[i], start)) >> T.U(48)
    return out.reshape(-1, TREES, DEPTH)


def _forest(batches):
    """Documents -> their signatures in all trees, tree by tree (null without words)."""
    for b in batches:
        out = [None] * b.num_rows
        for c in T.chunks(b.column("text")):
            g, doc = shingles(c)
            if not len(g):
                continue
            start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for row, d in zip(signatures(g, start), doc[start].tolist()):
                out[c.rows.start + d] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(x) for x in ("d", "k", "h1", "h2")] + [pa.array(out, pa.binary())],
                                         names=["d", "k", "h1", "h2", "label"])


def _company(floor: int):
    """Signatures sorted by tree -> the rows with a neighbour that shares ``floor``
    values or more, and how many (``deep``). The neighbours of a partition's first and
    last row stand elsewhere, so these two are taken to have full company."""
    def depths(t: pa.Table, lead: int) -> np.ndarray:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, DEPTH)
        tree = np.asarray(t.column("tree"))
        same = np.zeros((t.num_rows - 1, DEPTH + 1), bool)
        same[:, :DEPTH] = (sig[1:] == sig[:-1]) & (tree[1:] == tree[:-1])[:, None]
        return np.append(lead, np.argmin(same, axis=1))  # common values with the row before

    def rows(t: pa.Table, deep: np.ndarray):
        t = t.select(["d", "k", "tree"]).append_column("deep", pa.array(deep.astype(np.int32)))
        return t.filter(pa.array(deep >= floor)).to_batches()

    def run(batches):
        held, lead = None, DEPTH
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            before = depths(t, lead)
            yield from rows(t.slice(0, t.num_rows - 1), np.maximum(before[:-1], before[1:]))
            held, lead = t.slice(t.num_rows - 1).to_batches()[0], int(before[-1])
        if held is not None:
            yield from rows(pa.Table.from_batches([held]), np.array([DEPTH]))
    return run


KEY = ("tree", "prefix", "low", "high")


def whole_groups(batches, key=KEY):
    """Batches sorted by ``key``, recut so that none splits a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for name in key:
            col = np.asarray(b.column(name))
            same &= col == col[-1]
        first = b.num_rows - (int(np.argmin(same[::-1])) if not same.all() else b.num_rows)
        if same.all() and held and all(b.column(n)[0] == held[-1].column(n)[-1] for n in key):
            held.append(b)
            continue
        ready = [*held, b.slice(0, first)]
        if sum(x.num_rows for x in ready):
            yield pa.Table.from_batches(ready).combine_chunks()
        held = [b.slice(first)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def prefix_keys(labels: np.ndarray, depth: int) -> np.ndarray:
    """One number for the first ``depth`` values of each signature in each tree."""
    words, key = labels.view(np.uint64), T.U(0)
    for w in range(-(-depth // 4)):
        have = min(4, depth - 4 * w)
        key = T.mix(key * T.U(31) + (words[:, :, w] & T.U((1 << 16 * have) - 1)))
    return key


def candidate_pairs(t: pa.Table, depths: list[int]):
    """Pairs (rows i, j) of whole nodes at the last of ``depths`` that are to be
    treated here: they meet here first of all trees, were not treated at a longer
    prefix and are not both settled. In a node of one block all pairs, else the
    pairs across its two blocks. Small nodes of one size go together."""
    cols = [np.asarray(t.column(n)) for n in KEY]
    block, state = np.asarray(t.column("block")), np.asarray(t.column("state"))
    labels = np.frombuffer(b"".join(t.column("label").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
    keys = [prefix_keys(labels, n) for n in depths]
    settled = [(state >> level & 1).astype(bool) for level in range(len(depths))]

    def due(i, j):
        both = keys[-1][i] == keys[-1][j]
        ok = both[np.arange(len(i)), cols[0][i]] & (np.argmax(both, axis=1) == cols[0][i])
        for key, done in zip(keys[:-1], settled):
            ok &= ~(key[i] == key[j]).any(axis=1) | (done[i] & done[j])
        return ok

    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, t.num_rows))
    for m in np.unique(size[size > 1]).tolist():
        i0, j0 = np.triu_indices(m, 1)
        step = max(1, 400_000 // len(i0))
        mine = start[size == m]
        for a in range(0, len(mine), step):
            at = mine[a:a + step]
            i, j = (at[:, None] + i0).ravel(), (at[:, None] + j0).ravel()
            use = ((cols[2][i] == cols[3][i]) | (block[i] != block[j])) & ~(settled[-1][i] & settled[-1][j])
            i, j = i[use], j[use]
            here = [due(i[x:x + 65536], j[x:x + 65536]) for x in range(0, len(i), 65536)]
            if here:
                here = np.concatenate(here)
                yield i[here], j[here]


CARRIED = ("block", "d", "k", "label", "state")
PLACED = "tree int, prefix bigint, low int, high int, block int, d bigint, k int, label binary, state int"


def _needed(depths: list[int]):
    """Trie nodes' blocks -> the rows that have a candidate there."""
    def run(batches):
        for t in whole_groups(batches):
            use = np.zeros(t.num_rows, bool)
            for i, j in candidate_pairs(t, depths):
                use[i] = use[j] = True
            if use.any():
                yield from t.select([*KEY, *CARRIED]).filter(pa.array(use)).to_batches()
    return run


def _sets(batches):
    """Documents with the blocks that need them -> a row for each block."""
    for b in batches:
        for c in T.chunks(b.column("text"), SET_BYTES):  # a set is sent once a block, so batches stay small
            g, doc = shingles(c)
            part = b.slice(c.rows.start, c.n)
            sets = []
            for d, (x, z) in enumerate(zip(np.searchsorted(doc, np.arange(c.n)), np.searchsorted(doc, np.arange(c.n), "right"))):
                sets.append(np.unique(g[x:z]).tobytes())
            places = part.column("places")
            row = np.repeat(np.arange(c.n), np.asarray(pc.list_value_length(places)))
            flat = places.flatten()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field(n) for n in (*KEY, "block")] + [part.column(n).take(take) for n in CARRIED[1:]] + [pa.array(sets, pa.binary()).take(take)],
                names=[*KEY, *CARRIED, "shingles"])


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    values = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    u, inv, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # only shared shingles count
    keep = n[inv] > 1
    col, owner = shared[inv[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, MATRIX):
        lo, hi = np.searchsorted(col, [a, a + MATRIX])
        m = np.zeros((len(used), MATRIX), np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1
        total += m @ m.T
    return total[place[i], place[j]].astype(np.int64)


LINKED = "d bigint, k int, n_links bigint, weakest double, root_d bigint, root_k int"


def _verify(threshold: float, depths: list[int]):
    """Shingle sets by block -> for each text with links there: their number, the
    weakest and the smallest row of its component in the block. So what leaves a block grows
    with its texts, not with its pairs."""
    def run(batches):
        for t in whole_groups(batches):
            d, k = np.asarray(t.column("d")), np.asarray(t.column("k"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets])
            count, root, weakest = np.zeros(len(n), np.int64), np.arange(len(n)), np.ones(len(n))
            for i, j in candidate_pairs(t, depths):
                # sets too unequal in size cannot reach the threshold
                fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                for x in _by_nearness(i):
                    both = intersections(sets, i[x], j[x])
                    union = n[i[x]] + n[j[x]] - both
                    ok = both >= threshold * union - 1e-9
                    a, b = i[x][ok], j[x][ok]
                    count += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
                    for side in (a, b):
                        np.minimum.at(weakest, side, both[ok] / union[ok])
                    root = unite(root, a, b)
            linked = np.flatnonzero(count)
            if len(linked):
                r = root[linked]
                yield pa.RecordBatch.from_arrays([pa.array(d[linked]), pa.array(k[linked]), pa.array(count[linked]), pa.array(weakest[linked]),
                                                  pa.array(d[r]), pa.array(k[r])], names=["d", "k", "n_links", "weakest", "root_d", "root_k"])
    return run


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components (smallest member of each) after adding the edges a-b."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _by_nearness(i: np.ndarray):
    """Slices of the pairs whose first rows lie close together, so a matrix
    never spans many small groups."""
    if not len(i):
        return
    order = np.argsort(i, kind="stable")
    cut = np.flatnonzero(np.diff(i[order] // (2 * BLOCK))) + 1
    yield from np.split(order, cut)


def settled_state(found: list[DataFrame], depths: list[int], recall: float) -> DataFrame:
    """d, k, state: bit n is set if the links found before level n settled the text."""
    all_of = reduce(DataFrame.union, [f.select("d", "k", "weakest", F.lit(n).alias("at")) for n, f in enumerate(found)])
    bit = [F.when(F.min(F.when(F.col("at") < n, F.col("weakest"))) >= settling(depths[n - 1], recall), 1 << n).otherwise(0) for n in range(1, len(found) + 1)]
    return all_of.groupBy("d", "k").agg(reduce(Column.__add__, bit).cast("int").alias("state")).filter("state > 0")


def _level(walk: DataFrame, texts: DataFrame, depths: list[int], threshold: float) -> DataFrame:
    """Links found under common prefixes of the last of ``depths``. ``walk``: d, k,
    label, state, trees (tree, deep) with company."""
    n, level = depths[-1], len(depths) - 1
    t = walk.select("d", "k", "label", "state", F.explode(F.filter("trees", lambda x: x["deep"] >= n)).alias("x"))
    t = t.select("d", "k", "label", "state", "x.tree", F.xxhash64(F.substring("label", F.col("x.tree") * 2 * DEPTH + 1, F.lit(2 * n))).alias("prefix"))
    live = F.shiftright("state", level).bitwiseAND(1) == 0
    nodes = t.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("count"), F.max(live).alias("live")).filter("count > 1 AND live")
    met = t.join(nodes.select("tree", "prefix", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), ["tree", "prefix"])
    met = met.withColumn("block", F.pmod(F.xxhash64("d", "k"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("tree", "prefix", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *CARRIED)
    need = met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_needed(depths), PLACED)
    need = materialize(need, "jaccard-blocks")
    places = need.groupBy("d", "k").agg(F.collect_list(F.struct(*KEY, "block")).alias("places"), F.first("label").alias("label"), F.first("state").alias("state"))
    sets = texts.join(places, ["d", "k"]).mapInArrow(_sets, PLACED + ", shingles binary")
    found = sets.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_verify(threshold, depths), LINKED)
    return materialize(found, "jaccard-links")


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows: d, k, first (d, k of the first equal text), copies of every document; linked: for texts with
    links, by level and block, their number, the weakest and a text of the same component)."""
    k = R.keyed(docs)
    forest = k.mapInArrow(_forest, "d bigint, k int, h1 bigint, h2 bigint, label binary")
    forest = materialize(forest, "jaccard-forest")
    nodes = forest.groupBy("h1", "h2").agg(F.min(F.struct("d", "k")).alias("first"), F.count(F.lit(1)).alias("copies"),
                                           F.first("label").alias("label"))
    nodes = materialize(nodes, "jaccard-nodes")
    rows = forest.select("d", "k", "h1", "h2").join(nodes.select("h1", "h2", "first", "copies"), ["h1", "h2"])
    depths = levels(threshold, recall)
    labels = nodes.filter(F.col("label").isNotNull()).select("first.d", "first.k", "label")
    trie = labels.select("d", "k", "label", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trie = trie.select("tree", F.substring("label", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("sig"), "d", "k")
    order = ("tree", "sig", "d", "k")  # texts of one signature may lie in several ranges
    company = trie.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_company(depths[-1]), "d bigint, k int, tree int, deep int")
    company = company.groupBy("d", "k").agg(F.collect_list(F.struct("tree", "deep")).alias("trees"))
    walk = materialize(labels.join(company, ["d", "k"]), "jaccard-walk")
    texts = k.select("d", "k", "text").join(walk.select("d", "k"), ["d", "k"], "left_semi").dropDuplicates(["d", "k"])
    texts = materialize(texts, "jaccard-texts")
    found: list[DataFrame] = []
    for level in range(len(depths)):
        at = walk.join(settled_state(found, depths, recall), ["d", "k"], "left") if found else walk.withColumn("state", F.lit(0))
        found.append(_level(at.withColumn("state", F.coalesce("state", F.lit(0))), texts, depths[:level + 1], threshold))
    return rows, reduce(DataFrame.union, found)


def components(edges: DataFrame) -> DataFrame:
    """a, root: the smallest node of the component of each linked node (nodes are
    structs), by alternating large-star and small-star steps."""
    e = materialize(edges.select("a", "b").distinct(), "components")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return e.select("a", F.col("b").alias("root"))
        state = tuple(now)
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        e = materialize(small.union(m).distinct(), "components")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """d, k, first, copies, n_links and root (d, k of the class's first text) of
    every row."""
    rows, found = links(docs, threshold, recall)
    node, root = F.struct("d", "k"), F.struct(F.col("root_d").alias("d"), F.col("root_k").alias("k"))
    roots = components(found.select(node.alias("a"), root.alias("b")).filter(F.col("a") != F.col("b")))
    count = found.groupBy(node.alias("a")).agg(F.sum("n_links").alias("n_links"))
    per = count.join(roots, "a", "left")  # a root has no edge to itself
    j = rows.withColumn("a", F.col("first")).join(per, "a", "left")
    return j.select("d", "k", "first", "copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("root", "a").alias("root"))


def join(docs: DataFrame) -> DataFrame:
    return classes(docs).select(R.doc_id().alias("doc_id"), R.doc_id("root.d", "root.k").alias("class_id"), R.doc_id("first.d", "first.k").alias("text_id"),
                                F.col("copies").alias("n_copies"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all columns, one of each class: its smallest doc_id."""
    heads = classes(docs).filter((F.col("root.d") == F.col("d")) & (F.col("root.k") == F.col("k"))).select("d", "k").distinct()
    kept = R.keyed(docs, whole=True).select("d", "k", "row").join(heads, ["d", "k"], "left_semi")
    return kept.dropDuplicates(["d", "k"]).select("row.*")
