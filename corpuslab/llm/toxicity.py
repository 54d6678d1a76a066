"""Toxicity: a convolutional text classifier in numpy.

A token's vector is the sum of hashed embeddings of the whole token and of its
first bytes (``PREFIXES``), so unseen inflections of a known stem still count.
Filters of several widths run over the vectors, each keeps its largest value in
the text (max pooling), and a logistic layer weighs these. Whole texts are read,
at every length.

Training: all labelled rows whose crc32(doc_id) mod 5 is not 0. Up to ``MAX_ROWS`` rows
and ``MAX_BYTES`` of text are fitted in one place. More are dealt out by a hash of the id
over shards of that size: in every epoch each shard's task goes over all its rows,
starting from the common parameters, and the changes are averaged (an embedding's over
the shards that met it). Residue 1 is kept back to
calibrate: the scores are shifted so that 0.5 separates best there, and each
language gets the threshold that separates best among its own rows (at least
``MIN_POSITIVE`` positives, else 0.5); over shards, all these rows are counted in steps
of 1 / ``GRID`` of a logit. A score depends on the text alone; the
language only picks the threshold of ``flagged``.

Scoring is one pass over the documents with the model (about 4 MB, fixed) in the
closure; no shuffle. Null and empty texts get the score of no evidence. With no
labelled rows of either class every score is the base rate. A null doc_id is
never held out. Repeated rows score alike. Empty tables give empty results.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import key_filter, materialize, own_shuffles

MAX_ROWS, MAX_BYTES = 6_000, 24_000_000
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 16, 16, (1, 2, 3), (5, 7)
EPOCHS, BATCH, RATE, MIN_POSITIVE = 12, 32, 0.05, 10
#: Least epochs over shards; rows of a block of changed parameters; steps of a logit when thresholds are counted.
PASSES, ROWS, GRID = 6, 1024, 256


def token_ids(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the tokens: whole, prefixes; the tokens' offsets by document)."""
    tok = T.Tokens(c)
    roll = T.Rolling(T._TABLE[T._FOLD[c.data]])
    cols = [tok.h] + [roll.spans(tok.s, np.minimum(tok.s + p, tok.e)) ^ T.U(p) for p in PREFIXES]
    return np.stack([(T.mix(h) % T.U(BUCKETS)).astype(np.int32) for h in cols], axis=1), tok.off


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.emb = np.concatenate([r.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.conv = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.shift = 0.0
        self.thresholds: dict[str, float] = {}

    def padded(self, ids: np.ndarray, off: np.ndarray):
        """Each text followed by blank tokens, so no window spans two texts.
        Returns ids, first place of each text, places that begin a window."""
        n = np.diff(off)
        gap = max(WIDTHS) - 1
        room = np.maximum(n, 1) + gap
        start = np.cumsum(room) - room
        full = np.full((int(room.sum()), ids.shape[1]), BUCKETS, np.int32)
        where = np.repeat(start - off[:-1], n) + np.arange(len(ids))
        full[where] = ids
        live = np.ones(len(full), bool)
        for g in range(gap):
            live[start + room - 1 - g] = False
        return full, start, live

    def forward(self, full: np.ndarray, start: np.ndarray, live: np.ndarray):
        x = self.emb[full[:, 0]]
        for j in range(1, full.shape[1]):
            x += self.emb[full[:, j]]
        maps, pooled = [], []
        for conv, bias in zip(self.conv, self.bias):
            z = x @ conv[0]
            for j in range(1, len(conv)):
                z[:-j] += x[j:] @ conv[j]
            z += bias
            z[~live] = -np.inf
            maps.append(z)
            pooled.append(np.maximum.reduceat(z, start, axis=0))
        return x, maps, pooled

    def logits(self, pooled) -> np.ndarray:
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.base

    def score(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros(0)
        _, _, pooled = self.forward(*self.padded(ids, off))
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled).astype(np.float64) - self.shift, -30, 30)))

    def step(self, ids, off, y, weight, mem) -> None:
        """One Adagrad step on some texts."""
        full, start, live = self.padded(ids, off)
        x, maps, pooled = self.forward(full, start, live)
        feat = np.maximum(np.concatenate(pooled, axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(feat @ self.out + self.base, -30, 30)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        dfeat = d[:, None] * self.out * (feat > 0)
        doc = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(full))))

        def move(name, param, grad):
            m = mem.setdefault(name, np.full(param.shape, 1e-6, np.float32))
            m += grad * grad
            param -= RATE * grad / np.sqrt(m)
        rows, grads = [], []
        for k, (conv, z, top) in enumerate(zip(self.conv, maps, pooled)):
            at, f = np.nonzero(z == top[doc])
            _, first = np.unique(doc[at] * FILTERS + f, return_index=True)
            at, f = at[first], f[first]  # the leftmost largest window of each text and filter
            g = dfeat[doc[at], k * FILTERS + f]
            used = g != 0
            at, f, g = at[used], f[used], g[used]
            dconv, dbias = np.zeros_like(conv), np.bincount(f, g, FILTERS).astype(np.float32)
            for j in range(len(conv)):
                np.add.at(dconv[j].T, f, g[:, None] * x[at + j])
                rows.append(full[at + j].ravel())
                grads.append(np.repeat(g[:, None] * conv[j][:, f].T, full.shape[1], axis=0))
            move(f"conv{k}", conv, dconv)
            move(f"bias{k}", self.bias[k], dbias)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        u, inv = np.unique(rows, return_inverse=True)
        total = np.zeros((len(u), DIM), np.float32)
        np.add.at(total, inv, grads)
        real = u < BUCKETS
        u, total = u[real], total[real]
        m = mem.setdefault("emb", np.full(self.emb.shape, 1e-6, np.float32))
        m[u] += total * total
        self.emb[u] -= RATE * total / np.sqrt(m[u])
        move("out", self.out, feat.T @ d)
        move("base", self.base, np.array([d.sum()], np.float32))


def best_cut(score: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float:
    """The threshold with the best F1, midway between the scores beside it. With
    ``count``, each score stands for that many rows, ``y`` of them positive."""
    order = np.argsort(-score)
    s, hit = score[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1) if count is None else np.cumsum(count[order])
    f1 = 2 * hit / (n + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1  # a cut lies between different scores only
    k = int(np.argmax(f1))
    low = s[k + 1] if k + 1 < len(s) else s[k] / 2
    return float((s[k] + low) / 2)


def _ids_of(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for c in T.chunks(pa.array(texts, pa.string())):
        ids, off = token_ids(c)
        out += [ids[off[d]:off[d + 1]] for d in range(c.n)]
    return out


def _join(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    return (np.concatenate(items) if items else np.zeros((0, 1 + len(PREFIXES)), np.int32)), off


def fit(texts: list[str | None], toxic: list[int], langs: list[str | None], calibrate: list[bool], epochs: int = EPOCHS) -> Network:
    net = Network()
    y = np.asarray(toxic, dtype=np.float32)
    held = np.asarray(calibrate, dtype=bool)
    if not held.any() or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    rate = float(y[train].mean()) if len(train) else 0.0
    net.base[:] = np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
    if len(train) == 0 or rate in (0.0, 1.0):
        net.out[:] = 0
        return net
    ids = _ids_of(texts)
    weight = np.where(y == 1, min(5.0, (1 - rate) / rate), 1.0).astype(np.float32)
    r, mem = np.random.default_rng(11), {}
    for _ in range(max(epochs, -(-300 * BATCH // len(train)))):  # at least 300 steps
        order = r.permutation(train)
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            flat, off = _join([ids[i] for i in pick])
            net.step(flat, off, y[pick], weight[pick], mem)
    known = np.flatnonzero(held) if held.any() else train
    score = np.concatenate([net.score(*_join([ids[i] for i in known[a:a + 256]])) for a in range(0, len(known), 256)])
    cut = np.clip(best_cut(score, y[known]), 1e-9, 1 - 1e-9)
    net.shift = float(np.log(cut / (1 - cut)))
    logit = np.log(np.clip(score, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(score, 1e-12, 1 - 1e-12)) - net.shift
    score = 1 / (1 + np.exp(-logit))
    lang = np.asarray([x or "" for x in langs], dtype=object)[known]
    for name in sorted(set(lang)):
        own = lang == name
        if y[known][own].sum() >= MIN_POSITIVE and (y[known][own] == 0).any():
            net.thresholds[name] = best_cut(score[own], y[known][own])
    return net


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def known_labels(labels: DataFrame) -> tuple[DataFrame, int]:
    """(a label for each id to learn from; the number of labelled ids). They are stored, so
    that under ``key_filter`` only texts that have one are shuffled."""
    lab = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = materialize(lab, "toxicity-labels")
    return lab.filter(fold(F.col("doc_id")) != 0), lab.count()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network:
    spark = docs.sparkSession
    lab, known = known_labels(labels)
    d = T.strip_columns(docs, "doc_id", "lang", "text")
    with own_shuffles(spark), key_filter(spark, known):
        size = d.select("doc_id", F.octet_length("text").alias("size")).join(lab, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
        t = d.join(lab, "doc_id").select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic"), (fold(F.col("doc_id")) == 1).alias("held"))
        shards = max(1, -(-size["n"] // max_rows), -(-(size["bytes"] or 0) // max_bytes))
        if shards > 1:
            shard = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(shards)).cast("int")
            rows = materialize(t.withColumn("shard", shard), "toxicity-rows")
        else:
            rows = t.orderBy("doc_id", "text").toArrow()
    if shards > 1:
        return fit_shards(rows, shards)
    return fit(*(rows.column(n).to_pylist() for n in ("text", "toxic", "lang", "held")))


def _parameters(net: Network) -> dict[str, np.ndarray]:
    """The network's arrays, by the names of ``Network.step``, as matrices of rows that change together."""
    out = {"emb": net.emb, "out": net.out.reshape(-1, 1), "base": net.base.reshape(-1, 1)}
    for k, (conv, bias) in enumerate(zip(net.conv, net.bias)):
        out |= {f"conv{k}": conv.reshape(-1, 1), f"bias{k}": bias.reshape(-1, 1)}
    return out


def _memory(net: Network) -> dict[str, np.ndarray]:
    shapes = {"emb": net.emb, "out": net.out, "base": net.base}
    shapes |= {f"{n}{k}": x for n, xs in (("conv", net.conv), ("bias", net.bias)) for k, x in enumerate(xs)}
    return {n: np.full(x.shape, 1e-6, np.float32) for n, x in shapes.items()}


CHANGES = "shard int, name string, block int, rows binary, change binary"


def _epoch(here, epoch: int, heavy: float):
    """One epoch over a shard's rows -> the rows of the parameters that it changed, by block."""
    def run(t: pa.Table) -> pa.Table:
        net, mem = copy.deepcopy(here.value)
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        shard, ids = t.column("shard")[0].as_py(), _ids_of(t.column("text").to_pylist())
        y = np.asarray(t.column("toxic"), dtype=np.float32)
        weight = np.where(y == 1, heavy, 1.0).astype(np.float32)
        order = np.random.default_rng([11, epoch, shard]).permutation(len(ids))
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            net.step(*_join([ids[i] for i in pick]), y[pick], weight[pick], mem)
        old, old_mem, out = _parameters(here.value[0]), here.value[1], []
        for name, now in _parameters(net).items():
            change = np.concatenate([now - old[name], (mem[name] - old_mem[name]).reshape(now.shape)], axis=1)
            rows = np.flatnonzero(change.any(axis=1))
            for k in np.unique(rows // ROWS).tolist():
                mine = rows[rows // ROWS == k]
                out.append((shard, name, k, mine.astype(np.int64).tobytes(), change[mine].astype(np.float32).tobytes()))
        names = [x.split()[0] for x in CHANGES.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(zip(names, kinds))})
    return run


def _mean(t: pa.Table) -> pa.Table:
    """A block's changes, each row's averaged over the shards that have it."""
    block, total, n = t.column("block")[0].as_py(), None, np.zeros(ROWS)
    for rows, change in zip(*(t.sort_by("shard").column(c).to_pylist() for c in ("rows", "change"))):
        at = np.frombuffer(rows, np.int64) - block * ROWS
        change = np.frombuffer(change, np.float32).reshape(len(at), -1)
        total = np.zeros((ROWS, change.shape[1])) if total is None else total
        total[at] += change  # a shard has a row once
        n[at] += 1
    at = np.flatnonzero(n)
    mean = (total[at] / n[at, None]).astype(np.float32)
    return pa.table({"shard": pa.array([0], pa.int32()), "name": t.column("name").slice(0, 1), "block": t.column("block").slice(0, 1),
                     "rows": pa.array([(at + block * ROWS).tobytes()], pa.binary()), "change": pa.array([mean.tobytes()], pa.binary())})


def _logits(here):
    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            for c in T.chunks(b.column("text")):
                score[c.rows] = here.value.score(*token_ids(c))
            score = np.clip(score, 1e-12, 1 - 1e-12)
            step = np.rint(GRID * (np.log(score) - np.log1p(-score))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(step)], names=["lang", "toxic", "step"])
    return run


def fit_shards(rows: DataFrame, shards: int, epochs: int = EPOCHS, passes: int = PASSES) -> Network:
    """``fit`` over all of a stored table (doc_id, text, lang, toxic, held, shard). As many
    epochs as give a shard 300 steps, between ``passes`` and ``epochs``."""
    spark = rows.sparkSession
    sc, net = spark.sparkContext, Network()
    seen = {(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    apart = len({y for held, y in seen if held}) == 2
    known = rows.filter("held") if apart else rows
    own = rows.filter("not held") if apart else rows
    n = [sum(c for (held, y), c in seen.items() if y == v and not (apart and held)) for v in (0, 1)]
    rate = n[1] / max(1, sum(n))
    net.base[:] = np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
    if not all(n):
        net.out[:] = 0
        return net
    mem = _memory(net)
    for epoch in range(min(epochs, max(passes, -(-300 * BATCH * shards // sum(n))))):
        here = sc.broadcast((net, mem))
        with own_shuffles(spark):
            changes = own.select("doc_id", "text", "toxic", "shard").groupBy("shard").applyInArrow(_epoch(here, epoch, min(5.0, (1 - rate) / rate)), CHANGES)
            got = changes.groupBy("name", "block").applyInArrow(_mean, CHANGES).collect()  # at most the network
        here.destroy()
        net, mem = copy.deepcopy((net, mem))
        now = _parameters(net)
        for r in got:
            at, param = np.frombuffer(r["rows"], np.int64), now[r["name"]]
            change = np.frombuffer(r["change"], np.float32).reshape(len(at), -1)
            param[at] += change[:, :param.shape[1]]
            mem[r["name"]].reshape(param.shape)[at] += change[:, param.shape[1]:]
    steps = known.select("lang", "toxic", "text").mapInArrow(_logits(sc.broadcast(net)), "lang string, toxic int, step int")
    with own_shuffles(spark):
        got = steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")).collect()  # steps of the grid a language
    lang = np.array([r["lang"] or "" for r in got], dtype=object)
    step, n, hits = (np.array([r[c] for r in got], dtype=np.float64) for c in ("step", "n", "hits"))

    def cut(mine: np.ndarray, shift: float) -> float:
        at, which = np.unique(step[mine], return_inverse=True)
        return best_cut(1 / (1 + np.exp(shift - at / GRID)), np.bincount(which, weights=hits[mine]), np.bincount(which, weights=n[mine]))
    at = np.clip(cut(np.ones(len(n), bool), 0.0), 1e-9, 1 - 1e-9)
    net.shift = float(np.log(at / (1 - at)))
    for name in sorted(set(lang)):
        mine = lang == name
        if hits[mine].sum() >= MIN_POSITIVE and (hits[mine] < n[mine]).any():
            net.thresholds[name] = cut(mine, net.shift)
    return net


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, threshold double, flagged boolean"


def _score(net: Network):
    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            for c in T.chunks(b.column("text")):
                score[c.rows] = net.score(*token_ids(c))
            cut = np.array([net.thresholds.get(x or "", 0.5) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut, pa.float64()),
                 pa.array(score >= cut)], names=[x.split()[0] for x in SCHEMA.split(", ")])
    return run


def classify(docs: DataFrame, net: Network) -> DataFrame:
    d = T.strip_columns(docs, "doc_id", "lang", "text")
    d = d.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    return d.mapInArrow(_score(net), SCHEMA)
