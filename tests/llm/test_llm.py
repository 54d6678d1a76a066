"""The operators of the training-data pipeline: SQL twins, brute force on whole
tables, invariants, and hard cases (nulls, empty, long, ties, repeated rows,
empty tables, clashing column names)."""

import contextlib
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

import corpus_pipeline
from corpuslab.llm import (decontaminate, jaccard_join, license_scan, packing, quality, queries, repeats, secret_scan, sharding,
                           source_audit, sql, substring_dedup, suffix_dedup, suffix_family, token_counts, toxicity, whitening)
from corpuslab.llm import textarrays as T
from corpuslab.session import key_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SCHEMA = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()),
                       S.StructField("source", S.StringType()), S.StructField("n_chars", S.LongType()),
                       # names that the operators use inside
                       *[S.StructField(n, S.StringType()) for n in ("d", "k", "g", "h", "size", "label", "places", "row", "kept", "score", "range", "tree")]])


def _row(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text)) + ("x",) * 12


LONG = " ".join(f"word{i % 9973}x{i * i % 77}" for i in range(60_000))
BASE = " ".join(f"alpha{i}" for i in range(90))
HARD = [_row(1, BASE), _row(2, BASE), _row(2, BASE), _row(3, BASE + " tail of another kind"), _row(4, None), _row(5, ""), _row(6, " \n\t "),
        _row(None, "no id here " + BASE), _row(7, "one"), _row(8, "a b c d e"), _row(9, LONG), _row(10, "x" * 5000), _row(11, "é" * 300 + " ñandú " * 40),
        _row(12, None, None), _row(13, "token = abcdef password: x1 AKIA" + "A" * 20 + " " + "0f" * 14), _row(8, "another text under the same id " * 9),
        _row(14, "Licensed under CC BY-NC 4.0."), _row(15, BASE[:300], None)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pdocs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def rows(df):
    return [tuple(r) for r in df.collect()]


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("key", sorted(sql.SQL))
def test_sql_twin(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(sql.SQL[key])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = queries.QUERIES[key](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(norm(x) for x in r) for r in rows(got.select(*sorted(cols)))), key=repr) == want


# --- textarrays -------------------------------------------------------------

def test_words_and_minimizers():
    import pyarrow as pa
    texts = ["a bb  c\n", None, "", "\x0b x\x1fy é", "q " * 50]
    c = next(T.chunks(pa.array(texts, pa.string())))
    c.words()
    got = [[bytes(c.data[s:e]) for s, e in zip(c.ws[a:z], c.we[a:z])] for a, z in zip(c.woff, c.woff[1:])]
    assert got == [WORD.findall((t or "").encode()) for t in texts]
    r = np.random.default_rng(1)
    h, group = r.integers(0, 9, 300).astype(np.uint64), np.repeat([0, 1, 2], 100)
    m, s = T.minimizers(h, group, 16)
    want = [(i + int(np.argmin(h[i:i + 16])), i) for i in range(285) if group[i] == group[i + 15]]
    assert list(zip(m.tolist(), s.tolist())) == want


# --- 1 ----------------------------------------------------------------------

def brute_links(texts):
    sh = {}
    for t in texts:
        w = WORD.findall(t.encode())
        sh[t] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    out = []
    for i, a in enumerate(texts):
        for b in texts[:i]:
            u = len(sh[a] | sh[b])
            if u and len(sh[a] & sh[b]) >= 0.8 * u:
                out.append((a, b))
    return out


def test_jaccard_hard(hard, none):
    got = {(r["doc_id"], r["n_copies"]): r for r in jaccard_join.join(hard).collect()}
    assert len(jaccard_join.join(hard).collect()) == len(HARD)
    texts = sorted({r[1] or "" for r in HARD})
    n = Counter(x for pair in brute_links(texts) for x in pair)
    for r in HARD:
        copies = sum((q[1] or "") == (r[1] or "") for q in HARD)
        assert got[(r[0], copies)]["n_links"] == n[r[1] or ""]
    assert got[(2, 3)]["class_id"] == got[(3, 1)]["class_id"] == got[(None, 1)]["class_id"] == 1
    assert jaccard_join.join(none).collect() == []
    assert jaccard_join.keep_one(none).collect() == []
    kept = jaccard_join.keep_one(hard)
    assert kept.columns == hard.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[None] == ids[2] == ids[3] == 0 and ids[4] == 1 and ids[5] == ids[12] == 0 and ids[8] == 2


def test_jaccard_large_group_and_recall(spark):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(700):  # more than a block
        w = list(base)
        for p in r.integers(0, 120, r.integers(1, 4)):
            w[p] = f"z{i}_{p}"
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(116)} for t in texts]
    want = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want[i] += 1
                want[j] += 1
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.join(df).collect()}
    assert sum(got.values()) >= 0.998 * sum(want.values())
    assert all(got[i] <= want[i] for i in got)


def test_jaccard_recall_on_a_table(spark):
    """Links found against the exact ones of the SQL twin, ten times the other tests' rows."""
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, n_links, class_id FROM ({sql.OP1})").df().set_index("doc_id")
    got = queries.QUERIES["op1_jaccard_join"](spark, sf).toPandas().set_index("doc_id").loc[want.index]
    recall = got.n_links.sum() / want.n_links.sum()
    print(f"op1 recall of links: {recall:.6f} of {want.n_links.sum()}")
    assert (got.n_links <= want.n_links).all() and recall >= 0.999
    assert (got.class_id != want.class_id).mean() <= 0.001


def test_prefix_lengths():
    """The last level finds a pair at the threshold as often as asked; a text that
    is settled earlier has links which that level finds as often, with a margin."""
    assert jaccard_join.levels() == [8, 6, 4]
    for threshold in (0.5, 0.8, 0.95):
        for recall in (0.9, 0.999):
            steps = jaccard_join.levels(threshold, recall)
            assert steps == sorted(set(steps), reverse=True) and (steps[-1] == 1 or jaccard_join.reached(steps[-1], threshold) >= recall)
            for n in steps:
                assert jaccard_join.reached(n, jaccard_join.settling(n, recall) - jaccard_join.MARGIN) == pytest.approx(recall)


def test_company_in_sorted_tries():
    r = np.random.default_rng(8)
    rows = sorted((int(t), bytes(r.integers(0, 2, jaccard_join.DEPTH, dtype=np.uint16).tobytes())) for t in r.integers(0, 3, 60))
    cols = [pa.array(range(60), pa.int64()), pa.array([0] * 60, pa.int32()), pa.array([t for t, _ in rows], pa.int32()), pa.array([x for _, x in rows])]
    whole = pa.RecordBatch.from_arrays(cols, names=["d", "k", "tree", "sig"])

    def shared(a, b):
        same = [x == y for x, y in zip(*(np.frombuffer(q[1], np.uint16) for q in (a, b)))]
        return (same + [False]).index(False) if a[0] == b[0] else 0
    want = {i: max(shared(rows[i - 1], rows[i]), shared(rows[i], rows[i + 1])) for i in range(1, 59)}
    want |= {0: jaccard_join.DEPTH, 59: jaccard_join.DEPTH}
    for cut in (60, 7, 1):
        out = jaccard_join._company(3)(whole.slice(a, cut) for a in range(0, 60, cut))
        assert {d: n for b in out for d, n in zip(b["d"].to_pylist(), b["deep"].to_pylist())} == {i: n for i, n in want.items() if n >= 3}


def test_pairs_are_treated_once():
    """Over all levels and trees: a pair is treated at the first level where it
    meets and is not of two settled texts, in one tree."""
    r = np.random.default_rng(4)
    n, steps = 40, jaccard_join.levels()
    labels = np.where(r.random((n, jaccard_join.TREES, jaccard_join.DEPTH)) < 0.75, 7, r.integers(0, 1 << 16, (n, jaccard_join.TREES, jaccard_join.DEPTH))).astype(np.uint16)
    bits = np.concatenate([np.zeros((1, n), bool), r.random((len(steps) - 1, n)) < 0.5])
    seen = Counter()
    for level, depth in enumerate(steps):
        state = (bits[:level + 1] << np.arange(level + 1)[:, None]).sum(axis=0)
        rows = sorted((t, hash(labels[i, t, :depth].tobytes()), i) for t in range(jaccard_join.TREES) for i in range(n))
        ids = np.array([x[2] for x in rows])
        t = pa.table({"tree": pa.array([x[0] for x in rows], pa.int32()), "prefix": [x[1] for x in rows], "low": [0] * len(rows), "high": [0] * len(rows),
                      "block": [0] * len(rows), "label": [labels[i].tobytes() for i in ids], "state": pa.array(state[ids], pa.int32())})
        for i, j in jaccard_join.candidate_pairs(t, steps[:level + 1]):
            seen.update((min(a, b), max(a, b), level) for a, b in zip(ids[i].tolist(), ids[j].tolist()))
    want = Counter()
    for a in range(n):
        for b in range(a + 1, n):
            meets = [any((labels[a, t, :d] == labels[b, t, :d]).all() for t in range(jaccard_join.TREES)) for d in steps]
            level = next((x for x in range(len(steps)) if meets[x] and not (bits[x, a] and bits[x, b])), None)
            if level is not None:
                want[(a, b, level)] = 1
    assert seen == want and len({x[2] for x in want}) == len(steps)


# --- 2 ----------------------------------------------------------------------

def toks(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())


def brute_hits(docs, items):
    def sh(x):
        k = min(5, max(1, len(x)))
        return {tuple(x[i:i + k]) for i in range(len(x) - k + 1)}, k
    width = max([32, *(len(toks(t)) for _, t in items)])
    parts = [(i, [sh(toks(x)) for x in (*decontaminate.question_answer(t), t)]) for i, t in items if toks(t)]
    out = set()
    for d, t in docs:
        w = toks(t)
        for a in range(0, max(1, len(w)), width):
            pas = w[a:a + 2 * width]
            grams = {k: {tuple(pas[i:i + k]) for i in range(len(pas) - k + 1)} for k in range(1, 6)}
            for i, three in parts:
                q, an, al = (len(s & grams[k]) / len(s) if s else 1.0 for s, k in three)
                if (q >= 0.8 and an >= 0.8) or al >= 0.8:
                    out.add((d, i))
    return out


def test_decontaminate_brute_force(spark, pdocs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = brute_hits(list(zip(pdocs.doc_id, pdocs.text)), list(zip(items.item_id, items.text)))
    got = queries.op2_decontaminate(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and want


def test_decontaminate_hard(spark, hard, none):
    items = spark.createDataFrame([(1, "What is it? It is " + BASE[:200]), (2, None), (3, ""), (4, "one"), (4, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(hard, items).collect()}
    assert (7, 4) in got and not any(i in (2, 3) for _, i in got)
    assert decontaminate.find(none, items).collect() == []
    assert decontaminate.find(hard, items.limit(0)).collect() == []
    kept = decontaminate.remove(hard, items)
    assert kept.columns == hard.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in HARD} - {d for d, _ in got}


def test_wand_is_exhaustive():
    r = np.random.default_rng(2)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 60, 12))) for i in range(300)]
    ix = decontaminate.Index(items)
    for _ in range(40):
        terms = np.unique(r.integers(0, len(ix.vocab), 25))
        score = np.zeros(ix.size)
        for t in terms:
            a, b = ix.first[t], ix.first[t + 1]
            score[ix.item[a:b]] += ix.w[a:b]
        assert {i for i, _ in ix.wand(terms)} == set(np.flatnonzero(score >= decontaminate.THRESHOLD - 1e-9).tolist())


# --- 3, 5 -------------------------------------------------------------------

def test_substring_hard(hard, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(hard).collect())
    order = sorted(HARD, key=lambda r: 1 << 63 if r[0] is None else r[0])
    first: dict = {}
    for r in order:
        w = WORD.findall((r[1] or "").encode())
        for s in range(len(w) - 19):
            x = (r[0] if r[0] is not None else 1 << 63, s)
            first[tuple(w[s:s + 20])] = min(x, first.get(tuple(w[s:s + 20]), x))
    want = Counter()
    for r in HARD:
        w = WORD.findall((r[1] or "").encode())
        gone = set()
        for s in range(len(w) - 19):
            if (r[0] if r[0] is not None else 1 << 63, s) > first[tuple(w[s:s + 20])]:
                gone |= set(range(s, s + 20))
        want[(r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())] += 1
    assert got == want
    assert substring_dedup.digest(none).collect() == []


def test_suffix_hard(hard, none, monkeypatch):
    seen = Counter()
    for r in HARD:
        b = (r[1] or "").encode()
        seen.update(b[s:s + 200] for s in range(len(b) - 199))
    want = Counter()
    for r in HARD:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s:s + 200]] > 1:
                gone[s:s + 200] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        want[(r[0], len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1

    def result():
        return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(hard).collect())
    assert result() == want
    monkeypatch.setattr(suffix_dedup, "HOT", 1)  # every seed with two contexts is dealt out
    assert result() == want
    assert suffix_dedup.digest(none).collect() == []


def test_family_merges_geometrically():
    r = np.random.default_rng(0)
    keys = r.integers(0, 400, 640).astype(np.uint64)
    f = suffix_dedup.Family()
    for a in range(0, 640, 20):
        f.add(keys[a:a + 20], np.zeros(20, np.uint64))
    n = Counter(keys.tolist())
    assert f.matched[:f.rows].tolist() == [n[x] > 1 for x in keys.tolist()]
    assert len(f.levels) == 1  # 32 batches: one level of generation 5
    f.add(keys[:20], np.zeros(20, np.uint64))
    assert len(f.levels) == 2 and f.matched[:f.rows][-20:].all()


def _suffix_batches(seed):
    """Batches of strings cut from a few long ones, some with a changed byte: lists of
    (bytes, starts of suffixes of ``depth`` bytes), and the depth."""
    r = np.random.default_rng(seed)
    depth = int(r.integers(8, 41))
    pool = [r.integers(97, 97 + int(r.integers(1, 4)), 80, dtype=np.uint8) for _ in range(4)]
    out = []
    for _ in range(int(r.integers(1, 10))):
        strings = []
        for _ in range(int(r.integers(0, 6))):
            a = int(r.integers(0, 30))
            x = pool[r.integers(4)][a:int(r.integers(a + depth, 81))].copy()
            x[r.integers(len(x))] ^= int(r.integers(0, 2))
            strings.append(x)
        off = np.cumsum([0, *map(len, strings)])
        starts = [np.arange(o, o + len(x) - depth + 1) for o, x in zip(off, strings)]
        out.append((np.concatenate([np.zeros(0, np.uint8), *strings]), np.concatenate([np.zeros(0, np.int64), *starts])))
    return out, depth


@pytest.mark.parametrize("seed", range(30))
def test_suffix_family(seed):
    batches, depth = _suffix_batches(seed)
    keys = [[bytes(data[i:i + depth]) for i in starts] for data, starts in batches]
    seen = Counter(x for k in keys for x in k)
    f = suffix_family.SuffixFamily(depth)
    places = [f.add(data, starts) for data, starts in batches]
    for p, k in zip(places, keys):
        assert f.matched(p).tolist() == [seen[x] > 1 for x in k]
    # levels: each in byte order without equals, together every string once, generations falling
    held = [[bytes(f.data[p:p + depth]) for p in level] for _, level in f.levels]
    assert all(h == sorted(set(h)) for h in held) and Counter(x for h in held for x in h) == Counter(set(seen))
    gens = [g for g, _ in f.levels]
    assert gens == sorted(set(gens), reverse=True) and sum(2 ** g for g in gens) == sum(len(k) > 0 for k in keys)
    # all at once: the same marks
    one, off = suffix_family.SuffixFamily(depth), np.cumsum([0, *(len(d) for d, _ in batches)])
    p = one.add(np.concatenate([d for d, _ in batches]), np.concatenate([s + o for (_, s), o in zip(batches, off)]))
    assert one.matched(p).tolist() == [seen[x] > 1 for k in keys for x in k]


def test_suffix_array_order():
    r = np.random.default_rng(3)
    data = np.concatenate([r.integers(97, 99, 300, dtype=np.uint8), np.full(300, 97, np.uint8), np.array([0, 255] * 60, np.uint8)])
    for depth in (8, 9, 16, 100, 200):
        starts = np.arange(len(data) - depth + 1)
        order, new = suffix_family.suffix_array(data, starts, depth)
        keys = [bytes(data[i:i + depth]) for i in starts[order]]
        assert keys == sorted(keys) and new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    with pytest.raises(ValueError):
        suffix_family.SuffixFamily(7)


# --- 4 ----------------------------------------------------------------------

def test_toxicity_held_out():
    d = "/root/testdata/sf0.01"
    t = pd.read_parquet(f"{d}/documents.parquet").merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    fold = t.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)
    tr, te = t[fold != 0], t[fold == 0]
    net = toxicity.fit(tr.text.tolist(), tr.toxic.tolist(), tr.lang.tolist(), (fold[fold != 0] == 1).tolist())
    s = np.concatenate([net.score(*toxicity._join(toxicity._ids_of([x]))) for x in te.text])
    pos, neg = s[te.toxic == 1], s[te.toxic == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.8
    assert ((s >= 0) & (s <= 1)).all()


def test_toxicity_plain_forward_pass(spark, docs, pdocs):
    """Every document's score, one text at a time with plain loops."""
    net = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, net).collect()}
    for i, text in zip(pdocs.doc_id, pdocs.text):
        ids = toxicity._ids_of([text])[0]
        x = [sum(net.emb[b].astype(float) for b in token) for token in ids] or [np.zeros(toxicity.DIM)]
        x += [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        logit = float(net.base[0]) - net.shift
        for k, (conv, bias) in enumerate(zip(net.conv, net.bias)):
            top = np.max([sum(x[p + j] @ conv[j] for j in range(len(conv))) + bias for p in range(max(len(ids), 1))], axis=0)
            logit += np.maximum(top, 0) @ net.out[k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-4)


def test_toxicity_learns_from_all_shards(spark):
    """Forty bad words of which no hundred rows show all: every one is learned when the rows go over shards."""
    r, rows = np.random.default_rng(3), []
    for i in range(1500):
        words = [f"plain{k}" for k in r.integers(0, 60, 12)]
        if i % 3 == 0:
            words[int(r.integers(12))] = f"{'abcdefghij'[i % 10]}{'klmn'[i // 10 % 4]}{'vile'}"
        rows.append((i, " ".join(words), "en" if i % 2 else None, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), max_rows=100)
    got = {x["doc_id"]: x for x in toxicity.classify(df.select("doc_id", "text", "lang"), net).collect()}
    held = [x for x in rows if got[x[0]]["held_out"]]
    assert np.mean([got[x[0]]["predicted"] == x[3] for x in held if x[3]]) > 0.95
    assert np.mean([got[x[0]]["predicted"] == x[3] for x in held if not x[3]]) > 0.95
    assert set(net.thresholds) == {"", "en"}


def _shuffled(plan):
    """Rows that each exchange of an executed plan has written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _shuffled(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
    mine = [plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
    return mine + [n for i in range(plan.children().size()) for n in _shuffled(plan.children().apply(i))]


def test_toxicity_shuffles_labelled_texts_only(spark, tmp_path, monkeypatch):
    """Once labels outgrow a broadcast, a text without a label is not shuffled, and the network stays the same."""
    fit_shards = toxicity.fit_shards
    monkeypatch.setattr(toxicity, "fit_shards", lambda rows, shards: fit_shards(rows, shards, epochs=1))
    rows = [(i, f"plain{i % 7} " * 20 + "vile" * (i % 10 == 0), "en", int(i % 10 == 0)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = docs.filter("doc_id % 30 < 2").select("doc_id", "toxic")
    want = toxicity.train(docs.drop("toxic"), labels, max_rows=60)
    names = [f"spark.sql.optimizer.runtime.bloomFilter.{x}" for x in ("applicationSideScanSizeThreshold", "creationSideThreshold", "expectedNumItems", "numBits")]
    before, limit = [spark.conf.get(x) for x in names], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity.train(docs.drop("toxic"), labels, max_rows=60)
        assert [spark.conf.get(x) for x in names] == before
        lab, n = toxicity.known_labels(labels)
        assert n == 200
        most = []
        for items in (n, None):
            with key_filter(spark, items) if items else contextlib.nullcontext():
                joined = docs.select("doc_id", "text").join(lab, "doc_id")
                assert len(joined._jdf.collect()) == lab.count()
                most.append(max(_shuffled(joined._jdf.queryExecution().executedPlan())))
        assert most[0] <= 1.1 * n < 2000 < most[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for a, b in zip(toxicity._parameters(got).values(), toxicity._parameters(want).values()):
        np.testing.assert_array_equal(a, b)
    assert (got.shift, got.thresholds) == (want.shift, want.thresholds)


def test_toxicity_gradients():
    """The step's gradients against differences of the weighted log-loss."""
    r = np.random.default_rng(2)
    net = toxicity.Network()
    net.emb, net.conv, net.bias = net.emb.astype(float), [c.astype(float) for c in net.conv], [b.astype(float) + 0.05 for b in net.bias]
    net.out, net.base = net.out.astype(float), net.base.astype(float)
    ids, off = r.permutation(toxicity.BUCKETS)[:3 * 20].reshape(20, 3).astype(np.int32), np.array([0, 6, 7, 20])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 2.0])
    params = {"out": net.out, "base": net.base, "emb": net.emb} | {f"conv{k}": c for k, c in enumerate(net.conv)} | {f"bias{k}": b for k, b in enumerate(net.bias)}

    def loss():
        p = net.score(ids, off)
        return (-weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
    spots, slopes = [], []
    for name, param in params.items():
        for _ in range(6):
            at = (int(r.choice(ids.ravel())), int(r.integers(toxicity.DIM))) if name == "emb" else tuple(int(r.integers(m)) for m in param.shape)
            old = param[at]
            param[at] = old + 1e-5
            up = loss()
            param[at] = old - 1e-5
            slopes.append((up - loss()) / 2e-5)
            param[at] = old
            spots.append((name, at))
    before, mem = {k: v.copy() for k, v in params.items()}, {}
    net.step(ids, off, y, weight, mem)
    for (name, at), slope in zip(spots, slopes):
        grad = (before[name][at] - params[name][at]) * math.sqrt(mem[name][at]) / toxicity.RATE
        assert grad == pytest.approx(slope, abs=1e-5, rel=1e-3)


def test_toxicity_hard(spark, hard, none):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 16)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    net = toxicity.train(hard, labels)
    got = toxicity.classify(hard, net).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by_text = {}
    for r in toxicity.classify(hard.withColumn("lang", F.lit("zz")), net).join(hard.select("doc_id", "text"), "doc_id").collect():
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    for r in got:  # the language has no say in the score
        if r["doc_id"] is not None:
            assert r["score"] in by_text[r["doc_id"]]
    assert toxicity.classify(none, net).collect() == []
    assert toxicity.train(none, labels.limit(0)).score(*toxicity._join([])).tolist() == []


# --- 6 ----------------------------------------------------------------------

def test_quality_hard(hard, none):
    got = {}
    for r in quality.assess(hard).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in HARD:
        w = WORD.findall((r[1] or "").encode())
        n8 = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if n8[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x.encode())]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(rep))
        assert want in {(x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got[r[0]]}
    assert quality.assess(none).collect() == []
    kept = quality.keep_good(hard)
    assert kept.columns == hard.columns and kept.count() == sum(r["kept"] for x in got.values() for r in x)
    assert quality.keep_good(none).collect() == []


# --- 7 ----------------------------------------------------------------------

def check_shards(got, data, shards, slack):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    size = Counter()
    for s in {r["shard"] for r in got}:
        assert 0 <= s < shards
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        size[s] = sum(r["size"] for r in mine)
    mean, largest = sum(size.values()) / shards, max(r["size"] for r in got)
    assert all(abs(size[s] - mean) <= largest + slack * mean for s in range(shards))


def test_sharding(spark, docs, pdocs, hard, none):
    check_shards(sharding.shard(docs).collect(), list(zip(pdocs.doc_id, pdocs.text)), 16, 0.02)
    got = sharding.shard(hard, shards=3).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in HARD)
    assert sharding.shard(none).collect() == []


def test_sharding_hot_text(spark):
    data = [(i, "the same text" if i % 3 else f"text {i} " * (i % 7)) for i in range(6000)] + [(i, "") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    check_shards(sharding.shard(df, shards=16, ranges=1024, sample=8192).collect(), data, 16, 0.05)


# --- 8 ----------------------------------------------------------------------

def check_pack(got, data, seq_len):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in data:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), seq_len)):
            x = ids[a:a + seq_len]
            want[(i, p, a, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= seq_len
    total = sum(r["length"] for r in got)
    assert len(seq) <= 1.03 * -(-total // seq_len) + 1


def test_packing(docs, pdocs, hard, none):
    check_pack(packing.pack(docs).collect(), list(zip(pdocs.doc_id, pdocs.text)), 2048)
    got = packing.pack(hard, seq_len=128).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in HARD)
    assert packing.pack(none).collect() == []


def test_word_encoder_equals_tokenizer():
    enc = packing.WordEncoder(packing.default_tokenizer())
    for t in ("It's I'LL ''s ... !? a.b,c", "Ñandú ÉTÉ, straße; ΣΟΦΟΣ İstanbul", "<|endoftext|> x<|startoftext|>y", " a b\x1cć é", "１２3 ４a_b-c"):
        assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


# --- 9 ----------------------------------------------------------------------

A = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in A.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


TRICKY = ["password: secret=abcdefgh", "TOKEN='x' token=\"abcdef\"", "api_key = passwd:abcdef", "ſecret=abcdef Kelvin toKen=abcdef", "é token=abcdef ñ" + "0f" * 12,
          "AKIAAKIA" + "Z" * 16, "token=tokentoken=abcdefg", "a" * 23 + " " + "a" * 24, "apikey==abcdef", "secret:    \n abcdef"]


def test_secrets(spark, pdocs, hard, none):
    data = list(zip(pdocs.doc_id, pdocs.text)) + [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for r, (i, t) in zip(sorted(secret_scan.digest(df).collect()), sorted(data)):
        say = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(t)]
        assert (r["doc_id"], r["base_sha256"]) == (i, hashlib.sha256(",".join(say).encode()).hexdigest())
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(say)
        assert [x for x in r["spans"].split(",") if x and x.split(":")[0] in secret_scan.BASE_KINDS] == say
    assert len(secret_scan.digest(hard).collect()) == len(HARD)
    assert secret_scan.digest(none).collect() == []
    out = secret_scan.redact(hard)
    assert out.columns == hard.columns
    red = {r["doc_id"]: r for r in out.collect()}
    assert "abcdef" not in red[13]["text"] and "AKIA" not in red[13]["text"] and red[13]["n_chars"] == len(red[13]["text"])
    assert red[4]["text"] is None and red[1]["text"] == BASE


def test_secret_checksums():
    body = b"0123456789abcdefghijABCDEFGHIJ"
    good = b"ghp_" + body + secret_scan.checksum62(body)
    assert [k for _, k, _ in secret_scan.scan_bytes(b"x " + good + b" y")] == [3]
    assert secret_scan.scan_bytes(b"x " + good[:-1] + (b"0" if good[-1:] != b"0" else b"1")) == []


# --- 10 ---------------------------------------------------------------------

def test_licenses(spark, hard, none):
    data = [(1, "Intro.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
            (3, "LICENSED   under cc by-nc 4.0!\nReleased under the MIT License."), (4, "no licence at all"), (5, None)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(1, 6)] == ["MIT", "Apache-2.0", "MIT,CC-BY-NC-4.0", "", ""]
    assert got[3]["verdict"] == "noncommercial" and got[2]["n_sentences"] == 2 and got[4]["verdict"] == "none"
    assert len(license_scan.scan(hard).collect()) == len(HARD) and license_scan.scan(none).collect() == []


def test_licenses_over_lines(spark):
    """Sentences wrapped over lines or padded beyond any length."""
    apache = "Licensed under the Apache License, Version 2.0."
    data = [(1, "Released under the\nMIT License."), (2, " * Licensed under the Apache\r\n * License, Version 2.0.\r\n *\r\n * Next"),
            (3, "Released under the" + " " * 900 + "MIT License."), (4, "/" + "*" * 900 + " " + apache + " " + "=" * 900),
            (5, "# Released under\n# the\n# MIT License.\n" + apache), (6, "Licensed under the\n\nApache License, Version 2.0."),
            (7, "It is not\nreleased under the MIT License and\nmore"), (8, "x\nAll rights\n# reserved.")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i]["sentence_ids"] for i in range(1, 9)] == ["mit-notice", "apache-notice", "mit-notice", "apache-notice", "mit-notice,apache-notice", "", "", "reserved"]


APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) [year] [fullname]

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD3 = """Copyright (c) [year], [fullname]

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_license_texts(spark):
    """The published texts and headers, wrapped, unwrapped and as comments."""
    bsd2 = re.sub(r"3\. Neither.*?permission\.\n\n", "", BSD3, flags=re.S)
    agpl, lgpl = GPL3.replace("General Public", "Affero General Public"), GPL3.replace("General Public", "Lesser General Public").replace("program", "library")
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0": GPL3, "GPL-2.0": GPL3.replace("version 3", "version 2"), "AGPL-3.0": agpl, "LGPL-3.0": lgpl,
             "BSD-3-Clause": BSD3, "BSD-2-Clause": bsd2}
    data, want = [], []
    for name, t in texts.items():
        for v in (t, " ".join(t.split()), "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */", "".join(f"# {x}\r\n" for x in t.split("\n")),
                  BASE + "\n\n" + t.replace("Neither the name of the copyright holder", "Neither the name of Example Inc.") + BASE):
            data.append((len(data), v))
            want.append(name)
    for name, v in (("MIT", "// SPDX-License-Identifier: MIT"), ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0\nInternational License."),
                    ("CC-BY-NC-4.0", "This dataset is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License (CC BY-NC 4.0)."),
                    ("Apache-2.0", "Apache License\n      Version 2.0, January 2004\n   http://www.apache.org/licenses/\n"),
                    ("MIT", "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details."),
                    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy")):
        data.append((len(data), v))
        want.append(name)
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_license_names(spark):
    data = [("License: MIT", "MIT"), ("MIT Licensed", "MIT"), ("Licensed under MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"),
            ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
            ("This work is licensed under CC BY 3.0.", "CC-BY-3.0"), ("Released under CC0.", "CC0-1.0"), ("Released under the Unlicense.", "Unlicense"),
            ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
            ("Available under the Eclipse Public License 2.0.", "EPL-2.0"), ("Dual licensed under the MIT and GPL licenses.", "MIT,GPL"),
            ("# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND Unknown-1.0", "GPL-2.0,BSD-3-Clause"),
            ("Licensed under either the Apache License, Version 2.0 or the MIT license.", "Apache-2.0,MIT"), ("Licensed under the Apache License 2.0 or the MIT license.", "Apache-2.0,MIT"),
            ("SPDX-License-Identifier: MIT-0", "MIT-0"), ("SPDX-License-Identifier: GPL-3.0-or-later\nOther text", "GPL-3.0"), ("Licence: GPLv3", "GPL-3.0"),
            ("None of this is licensed under the MIT License.", ""), ("Nothing here is released under CC0.", ""), ("It is not licensed under MIT.", ""),
            ("This is not MIT licensed", ""), ("The committee met under the gpl 3 tree", ""), ("License:\n", ""), ("SPDX-License-Identifier:", "")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    got = sorted(tuple(norm(x) for x in r) for r in license_scan.scan(frame).collect())
    by_name = {t: sorted(x.split(",")) for (t, _), x in zip(data, [r[3] for r in got])}
    assert by_name == {t: sorted(x.split(",")) for t, x in data}
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    cols = ["doc_id", "n_sentences", "sentence_ids", "licenses", "verdict"]
    assert sorted(tuple(norm(x) for x in r) for r in con.sql(f"SELECT {','.join(cols)} FROM ({sql.OP10})").fetchall()) == got


def test_license_sentences_alone(spark):
    """Identifying sentences alone or apart, and reserved notices."""
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."
    data = [("All rights reserved.", "All-Rights-Reserved", "reserved"), ("Copyright (c) 2020 Example Inc. All rights\nreserved.", "All-Rights-Reserved", "reserved"),
            ("All rights reserved.\n" + BSD3, "BSD-3-Clause", "permissive"), (free, "GPL", "copyleft"), (free + " All rights reserved. " + GPL3, "GPL-3.0", "copyleft"),
            ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", "GPL", "copyleft"),
            ("You should have received a copy of the GNU General Public License along with this program.", "GPL", "copyleft"),
            ("The MIT License", "MIT", "permissive"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "MIT", "permissive"),
            ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "BSD", "permissive"),
            ("This software is provided by the copyright holders and contributors as is.", "BSD", "permissive"),
            ("You may not use this file except in compliance with the License.", "Unspecified", "unspecified"),
            ("You may obtain a copy of the License at\nhttp://x.org/MPL", "Unspecified", "unspecified"),
            ("The software is provided as is, without warranty of any kind, express or implied.", "Unspecified", "unspecified"),
            (APACHE.replace("You may obtain", "All rights reserved. You may obtain"), "Apache-2.0", "permissive"), ("Nothing is licensed here.", "", "none")]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(data)], "doc_id long, text string")).collect()
    assert [(r["licenses"], r["verdict"]) for r in sorted(got)] == [x[1:] for x in data]
    known = {i for i in license_scan.SENTENCES} | {i for i, _ in license_scan.TEXTS} | {f"{i}-spdx" for i in license_scan.NAMES}
    assert known == {i for _, _, run in license_scan.ALL_RULES + license_scan.FALLBACK_RULES if len(run) == 1 for i in run}


# --- pipeline ---------------------------------------------------------------

def test_pipeline_by_stage(spark, docs, tmp_path):
    """Each stage against its brute-force version on its own input."""
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    d = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = d.toPandas()
        stage(spark, d, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        after = out.toPandas()
        if name == "quality":
            con = duckdb.connect()
            con.register("documents", before)
            keep = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.SQL['op6_quality_rules']}) WHERE kept").fetchall()}
            assert set(after.doc_id) == keep and len(after) == len(keep)
        if name == "near_duplicates":
            first = {}
            for i, t in sorted(zip(before.doc_id, before.text)):
                first.setdefault(t, i)
            root = {t: t for t in first}

            def find(t):
                while root[t] != t:
                    t = root[t]
                return t
            for a, b in brute_links(sorted(first)):
                a, b = find(a), find(b)
                if a != b:
                    a, b = sorted((a, b), key=lambda t: first[t])
                    root[b] = a
            assert set(after.doc_id) == {first[find(t)] for t in first}
        if name == "decontamination":
            gone = {x for x, _ in brute_hits(list(zip(before.doc_id, before.text)), list(zip(items.item_id, items.text)))}
            assert set(after.doc_id) == set(before.doc_id) - gone and gone
        if name == "secrets":
            text = dict(zip(after.doc_id, after.text))
            for i, t in zip(before.doc_id, before.text):
                assert (text[i] == t) == (not base_spans(t)) and not any(t[s:e] in text[i] for s, _, e in base_spans(t))
        if name == "packing":
            check_pack(out.collect(), list(zip(before.doc_id, before.text)), 2048)
        d = out


@pytest.mark.parametrize("table", ["hard", "none"])
def test_pipeline_hard(spark, table, request):
    d = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert (d.count() > 0) == (table == "hard")


# --- 11 ---------------------------------------------------------------------

def brute_audit(rows, min_docs=10, top=10):
    """lang -> everything, in plain Python integers."""
    docs = [(r[2] or "", r[3] or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").encode().lower())) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, ts in mine:
            count[s].update(t for t in ts if t in kept)
        whole = sum(count.values(), Counter())

        def share(c, n):
            return 1 + 10**9 * (c + 2) // (n + 2 * len(kept))

        def far(p, q):
            return (p - q) ** 2 // (p + q)
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in count.items()}
        q = {t: share(whole[t], whole.total()) for t in kept}
        for s in p:
            for part, found in (("pair", [(sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s]),
                                ("term", [(far(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]])):
                found.sort(key=lambda x: (-x[0], x[1]))
                for rank, (v, item) in enumerate(found if part == "pair" else found[:top], 1):
                    out.add((lang, s, part, item.decode(), v, rank))
    return out


def audit_rows(df):
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_source_audit_hard(spark, hard, none):
    data = [_row(i, f"Alpha beta{i % 3} gamma GAMMA Été {'delta ' * (i % 4)}", ["en", "fr", None][i % 3])[:3] + (["a", "b", None, "é"][i % 4],) for i in range(60)]
    data += [(100, "no kept term here", "xx", "only"), (101, None, "xx", "other"), (102, "", "yy", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    assert audit_rows(source_audit.audit(df)) == brute_audit(data)
    # tiny stripes: every document is sent on for itself, many shares, one share
    assert audit_rows(source_audit.audit(df, spill=1)) == brute_audit(data)
    assert audit_rows(source_audit.audit(df, min_docs=2, top=3, parts=1)) == brute_audit(data, 2, 3)
    assert audit_rows(source_audit.audit(hard, min_docs=2)) == brute_audit(HARD, 2)
    assert source_audit.audit(none).collect() == []


def test_source_audit_blocks_of_sources(spark, monkeypatch):
    r = np.random.default_rng(4)
    data = [(i, " ".join(f"t{chr(97 + x)}" for x in r.integers(0, 26, 12)), "en", f"s{i % 23}") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(source_audit, "SIDE", 5)
    monkeypatch.setattr(source_audit, "CELLS", 64)
    t = pa.table({"term": ["x", "y", "z"], "sources": [["a", "b"], ["c"], ["a", "c"]], "counts": [[3, 4], [5], [1, 2]]})
    known, norm = pa.array(["a", "b", "c"]), np.array([14, 14, 17])
    got = {(int(i), int(j)): int(v) for a, b, f in source_audit._pairs(t, known, norm) for i, j, v in zip(a, b, f)}
    n = [[3, 0, 1], [4, 0, 0], [0, 5, 2]]
    p = [[1 + 10**9 * (c + 2) // m for c in row] for row, m in zip(n, (14, 14, 17))]
    assert got == {(i, j): sum((x - y) ** 2 // (x + y) for x, y in zip(p[i], p[j])) for i in range(3) for j in range(i + 1, 3)}
    assert audit_rows(source_audit.audit(df)) == brute_audit(data)


def test_shares_are_exact():
    for c, n in ((0, 7), (5, 11), (9 * 10**14, 9 * 10**14 + 5), (123456789012, 3 * 10**14)):
        assert int(source_audit.shares(np.array([c]), np.array([n]))[0]) == 1 + 10**9 * (c + 2) // n


# --- 12 ---------------------------------------------------------------------

def test_token_counts_whole_table(spark, pdocs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    want = Counter((i, len((t or "").encode()), n, n > 1024) for i, t, n in (
        (i, t, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(pdocs.doc_id, pdocs.text)))
    assert Counter(map(tuple, queries.op12_token_counts(spark, SF).collect())) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, token_counts.count_tokens(docs, batch_bytes=500, piece_bytes=50).collect())) == want


def test_token_counts_hard(spark, hard, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    extra = ["a<|endoftext|>b <|endoftext|>", "it's 12ab34 we'll  \t\n x\u00a0y\u3000z", "\u0301e\u4e2d\u6587" * 50, "\r\n\r\n a1b2'c3", "'s1't2 're",
             "a\u00a0 b\u2003  c\u0085\nd\x0b e\x1c f\u200b g\u180e h \ufeff i", "x  \u00a0   y", "\u00e9t\u00e9 o\u00f9\t\u4e2d\n\n\u6587 \U0001f600 \U0001f600\n"]
    rows = [(r[0], r[1]) for r in HARD] + [(100 + i, x * k) for i, x in enumerate(extra) for k in (1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for size in (1, 7, 64, 1 << 16):
        assert Counter(tuple(r)[:3] for r in token_counts.count_tokens(df, piece_bytes=size).collect()) == want
    assert token_counts.count_tokens(hard).count() == len(HARD)
    c = token_counts.Counter(token_counts.default_tokenizer())
    r = np.random.default_rng(6)
    alphabet = list(" \t\n\r\x0b\x0c\x1c\x85\u00a0\u1680\u180e\u2003\u2028\u200b\u3000\ufeffabA1'.s\u00e9\u4e2d") + ["'re", "<|endoftext|>", "  "]
    texts = ["".join(alphabet[k] for k in r.integers(0, len(alphabet), 12)) for _ in range(20000)]
    assert c.totals(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(none).collect() == []
    assert token_counts.count_tokens(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), limit=1).first()["over_limit"]


def test_token_counts_of_other_tokenizers(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    texts = ["Hello there, 12 apples", "x" * 3000, "  spaced   out  " * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, model, piece_bytes=10).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    words = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(words)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, words, piece_bytes=10).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- 13 ---------------------------------------------------------------------

def check_whitening(df, vectors, limit=32):
    """vectors: the remaining (id, entries)."""
    c = np.array([v for _, v in vectors], np.float64)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    far = n * x - total
    cov = (far / n).T @ (far / n) / n
    e = np.sort(np.linalg.eigvalsh(cov))[::-1][:limit]
    e = e[e > 1e-9 * e[0]]
    got = df.orderBy("vec_id", "component").toPandas()
    assert len(got) == n * len(e) and (got.n == n).all()
    order = np.argsort([i for i, _ in vectors], kind="stable")
    y = got.whitened.to_numpy().reshape(n, len(e))
    assert (got.component.to_numpy().reshape(n, -1) == np.arange(1, len(e) + 1)).all()
    assert got.deviation.to_numpy().reshape(n, -1)[:, 0].tolist() == (far * far).sum(axis=1)[order].tolist()
    np.testing.assert_allclose(got.explained.to_numpy()[:len(e)], e / np.trace(cov), rtol=1e-6)
    far = (far / n)[order]
    np.testing.assert_allclose(y.T @ y / n, np.eye(len(e)), atol=1e-8)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    u = far.T @ y / n / np.sqrt(e)  # the axes that y implies: unit eigenvectors of the covariance
    np.testing.assert_allclose(u.T @ u, np.eye(len(e)), atol=1e-8)
    np.testing.assert_allclose(cov @ u, u * e, atol=1e-8 * e[0])


def test_whitening_whole_table(spark):
    p = pd.read_parquet(f"{SF}/embeddings.parquet")
    check_whitening(queries.op13_whitening(spark, SF), list(zip(p.vec_id, p.embedding)))


def test_whitening_hard(spark, monkeypatch):
    r = np.random.default_rng(5)
    good = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(7, r.normal(size=6).tolist())] + [(1000 + i, [0.5] * 6) for i in range(150)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [0.0] * 5 + [float("-inf")])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in good + bad], "vec_id long, embedding array<double>, label string, ids string")
    check_whitening(whitening.whiten(df.filter("vec_id <> 7").repartition(3)), [g for g in good if g[0] != 7])
    assert whitening.whiten(df).filter("vec_id = 7").count() == 2 * 6  # repeated ids are rows of their own
    # small blocks, several column blocks and many row blocks give the same
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 40)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    check_whitening(whitening.whiten(df.filter("vec_id <> 7").repartition(3), components=4), [g for g in good if g[0] != 7], 4)
    # shorter vectors are filled up, equal vectors and empty tables give nothing, a null id stays
    short = [(i, v[: 4 + i % 3]) for i, v in good[:300] if i != 7]
    full = [(i, v + [0.0] * (6 - len(v))) for i, v in short]
    check_whitening(whitening.whiten(spark.createDataFrame(short, "vec_id long, embedding array<double>")), full)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.limit(0)).collect() == []
    null = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {x["vec_id"] for x in whitening.whiten(null).collect()} == {None, 1, 2}


def test_deviations_beyond_64_bits():
    assert whitening.deviations(np.array([[3, 4], [0, 0]])) == [25, 0]
    assert whitening.deviations(np.array([[1 << 31, 0], [1 << 32, 1 << 32]])) == [1 << 62, None]


# --- rows without or with one id --------------------------------------------

def test_keys_of_many_texts_without_id(spark):
    """300,000 different texts without an id, twice each, stay 300,000 keys."""
    n = 300_000
    df = spark.range(2 * n).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % n).alias("text"))
    k = repeats.keyed(df)
    assert k.select("d", "k").distinct().count() == n and k.count() == 2 * n
    assert jaccard_join.keep_one(df).count() == n


def test_largest_id_is_not_null(spark):
    top = (1 << 63) - 1
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(top, words), (None, words + " end"), (top, "other"), (None, "other"), (1, words)], "doc_id long, text string")
    for got in (substring_dedup.digest(df), suffix_dedup.digest(df), jaccard_join.join(df)):
        assert Counter(r["doc_id"] for r in got.collect()) == Counter([top, None, top, None, 1])
    got = {(r["doc_id"], r["n_links"]): r for r in jaccard_join.join(df).collect()}
    assert got[(top, 0)]["class_id"] == got[(top, 0)]["text_id"] == top and got[(None, 1)]["class_id"] == 1


def test_sharding_of_identical_rows(spark):
    for doc in ("null", "7"):
        df = spark.range(200_000).selectExpr(f"cast({doc} as bigint) as doc_id", "'one text' as text").unionByName(
            spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text"))
        got = sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"),
                                                      F.max("slot").alias("hi"), F.count_distinct("slot").alias("slots")).collect()
        assert len(got) == 16 and sum(r["n"] for r in got) == 200_500
        assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["slots"] == r["n"] for r in got)
        mean = sum(r["bytes"] for r in got) / 16
        assert all(abs(r["bytes"] - mean) < 0.02 * mean for r in got)


def test_decontaminate_whatever_the_blocks(spark, monkeypatch):
    """Hits and scores are those of one index for any order and cut of the items."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = spark.range(300).select((F.col("id") + 10_000).alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id") % k) for w, k in
                                   (("quark", 7), ("lemma", 11), ("glyph", 13), ("node", 300), ("arc", 5), ("ring", 300))]).alias("text"))
    items = items.unionByName(more).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        more.filter("item_id % 50 = 0").select(F.col("item_id").alias("doc_id"), "text"), allowMissingColumns=True)

    def hits():
        return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontaminate.find(docs, items).collect())
    want = hits()
    assert len(want) >= 6
    for block, order in ((7, "item_id"), (64, "text"), (100, F.col("item_id").desc())):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        items = items.orderBy(order)
        assert hits() == want


def test_decontaminate_bounds_in_slices(monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(50)]
    text = " ".join(f"noise{k} word{k}" for k in range(3000)) + " " + items[17][1] + " " + " ".join(f"more{k}" for k in range(500))
    c = next(T.chunks(pa.array([text])))
    want = decontaminate.Index(items).search(c)
    monkeypatch.setattr(decontaminate, "CELLS", 60)
    assert decontaminate.Index(items).search(c) == want and {i for _, i in want} == {17}
