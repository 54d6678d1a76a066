"""What a pass, a count and a look-up cost: records of many rows, dense columns, n-grams of all words at once."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab import session
from corpuslab.functions import text as X
from corpuslab.operators import linear as L
from corpuslab.operators import neardup as ND
from corpuslab.operators import sparse as SP


def _lists(spark, rows):
    return spark.createDataFrame(rows, "label_idx int, idx array<int>, tf array<int>")


def test_records_hold_the_rows(spark):
    r = np.random.default_rng(2)
    rows = [(int(k % 3), sorted(r.choice(100_000, int(r.integers(0, 60)), replace=False).tolist()), None) for k in range(300)]
    rows = [(a, i, r.integers(1, 500, len(i)).tolist()) for a, i, _ in rows] + [(0, [], []), (1, [0], [1]), (2, [99_999], [70_000]), (0, [0], [3])]
    df = _lists(spark, rows).repartition(3)
    made = SP.packed(df, ["label_idx"], "tf", 500)
    assert made.columns == ["rows"] and 10 < made.count() < 60
    batches = [pa.RecordBatch.from_arrays([pa.array([bytes(x["rows"]) for x in made.collect()], pa.binary())], names=["rows"])]
    got = [tuple(x.values()) for b in SP.unpacked(batches, ["label_idx"], "tf") for x in b.to_pylist()]
    assert sorted(got) == sorted(rows)


def test_a_fit_reads_records_and_leaves_none(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(L, "store", lambda df, path, **how: (kept.append(path), session.store(df, path, **how)))
    df = _lists(spark, [(k % 2, [k % 2, 2 + k % 5], [1, 2]) for k in range(60)])
    w, _ = L.fit_svm(df, 7, 2, scale=SP.Scale([np.ones(7)]))
    assert len(kept) == 1 and (w[0, 0] > 0) and (w[1, 1] > 0)
    with pytest.raises(Exception):
        spark.read.parquet(kept[0])


@pytest.mark.parametrize("rows", [1, 40])
def test_dense_columns_change_no_margin_or_gradient(rows):
    r = np.random.default_rng(3)
    features, problems = 200, L.MANY
    each = r.integers(0, 30, rows)
    row = np.repeat(np.arange(rows), each)
    idx = np.concatenate([np.sort(np.minimum(199, r.geometric(0.05, n) - 1)) for n in each]).astype(np.int64)  # some twice
    w, weights, pull = r.random(len(row)), r.normal(size=(features + 1, problems)), r.normal(size=(rows, problems))
    plain, parted = L.Rows(row, idx, w, rows), L.Rows(row, idx, w, rows, features, problems)
    assert plain.dense is None and (rows == 1 or len(parted.idx) < len(idx))
    np.testing.assert_allclose(plain.margins(weights), parted.margins(weights), atol=1e-12)
    a, b = (x.pulled(pull, np.zeros(weights.shape[::-1])) for x in (plain, parted))
    np.testing.assert_allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("lo,hi", [(1, 2), (2, 4), (3, 5), (5, 7)])
@pytest.mark.parametrize("words", [[], ["a"], ["é😀b", "abcdefgh", "ab", "x" * 40], ["a\0", "\0", "b\0c"], [chr(0x4E00 + k) + chr(0x4E00 + 7 * k) for k in range(1, 3000)]])
def test_character_grams_of_all_words_at_once(words, lo, hi):
    spec = SP.CharWb("t", lo, hi)
    size, code, names = spec._coded(pa.array(words, pa.string()))
    names, ends = names.to_pylist(), np.append(0, np.cumsum(size))
    assert len(set(names)) == len(names)
    for k, w in enumerate(words):
        assert sorted(names[c] for c in code[ends[k]:ends[k + 1]]) == sorted(spec._of(w))


def test_character_grams_take_no_step_a_word():
    r = np.random.default_rng(5)
    words = pa.array(["".join(x) for x in r.choice(list("abcdefghij"), (30_000, 8))])
    spec = SP.CharWb("t", 3, 5)
    t = time.time()
    spec._coded(words)
    fast, t = time.time() - t, time.time()
    pa.array([g for w in words.to_pylist() for g in spec._of(w)]).dictionary_encode()
    assert fast < time.time() - t


def test_words_are_split_alike_in_any_script(spark):
    texts = ["a\x0bb \x85c\xa0d", "x y　z w", "  lead and trail \n", "", None, "é\x1cb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["w"] for r in df.select(X.ws_words(F.col("t")).alias("w")).collect()]
    assert got == [None if t is None else t.split() for t in texts]


def test_buckets_are_runs_of_rows_and_not_groups(spark, monkeypatch):
    """Bucket rows reach the proposals as they lie in the batches: a key may go on in the next one."""
    r = np.random.default_rng(6)
    n, width = 400, 64
    key, side = np.sort(r.integers(0, 60, n)), r.random(n) < 0.5
    bits = r.integers(0, 2, (n, width)).astype(np.uint8)
    near = np.packbits(np.where(r.random((n, width)) < 0.1, 1 - bits[key], bits[key]).astype(np.uint8), axis=1)
    h = pa.StructArray.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n))], names=["a", "b"])
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), h, pa.array([x.tobytes() for x in near], pa.binary())], names=["key", "side", "h", "bits"])
    most, probes = 20, 3
    want = set()
    for k in set(key.tolist()):
        t, m = np.flatnonzero((key == k) & side), np.flatnonzero((key == k) & ~side)
        for i in t:
            far = np.bitwise_count(near[i] ^ near[m]).sum(axis=1)
            want |= {(int(i), int(m[j])) for j in np.argsort(far, kind="stable")[:probes] if far[j] <= most}
    for size in (1, 7, 1000):
        batches = [whole.slice(a, size) for a in range(0, n, size)]
        got = [(x["t"]["a"], x["r"]["a"]) for b in ND._propose(most, probes)(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == sorted(want) and len(want) > 20


def test_pairs_carry_bytes(spark):
    df = spark.createDataFrame([(1, [3, 9, 2], [1, 2, 3]), (2, [], []), (3, [7], [70_000])], "k long, idx array<int>, tf array<int>")
    rows = df.select(F.struct(F.col("k").alias("a"), F.col("k").alias("b")).alias("h"), "idx", "tf").coalesce(1)
    flat = rows.mapInArrow(ND._flat("tf"), "h struct<a:bigint,b:bigint>, idx binary, tf binary").toArrow().combine_chunks()
    for part in (flat, flat.slice(1)):
        for c in ("idx", "tf"):
            x = part.column(c)
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            assert ND._list(x, np.int32).to_pylist() == [r[c] for r in df.collect()][flat.num_rows - part.num_rows:]
