"""Work that has to stay small on large tables: no counted tables, no shuffle files left, no shuffled pairs."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslab import session
from corpuslab.functions import text as X
from corpuslab.operators import linear as L
from corpuslab.operators import neardup as ND
from corpuslab.operators import profile as PR
from corpuslab.operators import relate as RL
from corpuslab.operators import sparse as SP
from corpuslab.plans import q_features as QF
from corpuslab.plans import q_train as QT
from corpuslab.sources import io as IO

SF = "/root/testdata/sf0.001"


def _texts(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 30, int(r.integers(0, 40))))) for i in range(200)] + [(200, None), (201, ""), (201, "twice twice")]
    return spark.createDataFrame(rows, "doc long, text string").repartition(3)


def test_one_step_forms_equal_the_counted_ones(spark, monkeypatch):
    df = _texts(spark)
    for spec in (SP.Words("text", 1, 2), SP.CharWb("text", 2, 4)):
        rows = SP.counted(df, spec)
        want = sorted(map(tuple, SP.term_stats(rows).collect()))
        assert want == sorted(map(tuple, SP.text_stats(df, spec).collect())) == sorted(map(tuple, SP.text_stats(df, spec, 50).collect()))
        v = SP.Vectorizer.fit(rows, 60)
        a, b = (sorted(map(str, x.collect())) for x in (v.rows(rows), SP.scaled(v.known(df, spec, ["doc"]), v.scale)))
        assert a == b
        a, b = (sorted(map(str, x.collect())) for x in (v.weights(v.rows(rows)), v.text_weights(df, spec)))
        assert a == b


def test_no_counted_or_weighted_tables_are_stored(spark):
    for key in ("tfidf_union", "linear_svc", "near_dup_lsh"):
        E.queries()[key](spark, SF).count()
    mine = {k[1]: path for k, (_, path) in session._TABLES.items() if k[2] == SF}
    assert mine and not any(k.startswith("counted-") for k in mine)
    for path in mine.values():
        assert not {"terms", "w"} & set(spark.read.parquet(path).columns)


def test_blocks_are_equal_by_weights_and_by_counts(spark):
    scale, known = QF.near_dup_known(spark, SF)
    rows = QF.near_dup_features(spark, SF)
    for how in (ND.max_sims, lambda x, n, scale=None: ND.lsh(x, n, 0.9, scale=scale)):
        a, b = ({r["doc"]: r["max_sim"] for r in x.collect()} for x in (how(rows, QF.NEAR_MAX), how(known, QF.NEAR_MAX, scale=scale)))
        assert a and set(a) == set(b) and all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_softmax_gradient_and_optimum(spark):
    r = np.random.default_rng(0)
    n, v, k = 200, 40, 3
    row, idx, w = np.repeat(np.arange(n), 6), r.integers(0, v, 6 * n), r.random(6 * n)
    label = r.integers(-1, k, n)
    x, d = r.normal(size=(v + 1, k)) * 0.1, r.normal(size=(v + 1, k))
    up, down = (L.softmax(row, idx, w, label, x + e * d)[0][0] for e in (1e-6, -1e-6))
    np.testing.assert_allclose((up - down) / 2e-6, (L.softmax(row, idx, w, label, x)[1] * d).sum(), rtol=1e-4)
    df = spark.createDataFrame([(int(label[i]), idx[6 * i:6 * i + 6].tolist(), w[6 * i:6 * i + 6].tolist()) for i in range(n)], "label_idx int, idx array<int>, w array<double>")
    got, _ = L.fit_softmax(df.repartition(3), v, k, max_iter=300, tol=1e-6)
    loss, grad = L.softmax(row, idx, w, label, got)
    decay = np.ones((v + 1, 1))
    decay[-1] = 0  # the biases are free
    assert np.abs(decay * got + grad).max() < 1e-3 * np.abs(L.softmax(row, idx, w, label, 0 * got)[1]).max()


def test_passes_leave_no_shuffle_files(spark):
    v, known = QT.corpus_known(spark, SF)
    rows = known.select((F.col("doc") % 2).alias("label_idx"), "idx", "tf")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum(disk.getAllFiles().apply(i).getName().startswith("shuffle") for i in range(disk.getAllFiles().size()))
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    _, passes = L.fit_svm(rows, len(v), 2, max_iter=8, tol=1e-9, scale=v.scale)
    for _ in range(20):  # files go in the background
        if files() <= before:
            break
        time.sleep(0.2)
    assert passes == 8 and files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_dealt_out_by_label(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(30)], "id long, label string")
    got = RL.encode(df, RL.build_dimension(df, ["label"]), ["label"])
    assert "BroadcastHashJoin" in _plan(got) and "hashpartitioning(label" not in _plan(got)
    assert {(r["label"], r["label_label"]) for r in got.collect()} == {("a", 0), ("b", 1), (None, None)}


def test_histogram_reads_the_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 2 == 0).alias("g"), (F.col("id") % 7).alias("x"))
    got = PR.histogram(df, "x", 3, by="g")
    assert "Range (" not in _plan(got) and "SortMergeJoin" not in _plan(got.select("mean"))
    want = {(g, b): sum(1 for i in range(100) if (i % 2 == 0) == g and min(i % 7 // 2, 2) == b) for g in (True, False) for b in range(3)}
    assert {(r["g"], r["bin"]): r["n"] for r in got.collect()} == want
    assert all(r["mean"] == round(sum(i % 7 for i in range(100) if (i % 2 == 0) == r["g"]) / 50, 6) for r in got.collect())


def test_predictions_travel_by_id(spark, tmp_path):
    rows = {m: [(f"i{k}" if k else None, t, k, k + len(m)) for k in range(6) for t in ("l1", "l2", None)] for m in ("a", "bb")}
    rows["bb"].append(("i3", "l2", 3, 9))  # a key that comes twice
    for m, x in rows.items():
        IO.save_predictions(spark.createDataFrame(x, "id string, task string, true_id long, pred_id long"), m, str(tmp_path / "p"))
    got = IO.load_predictions(spark, str(tmp_path / "p"), ["a", "bb"])
    assert "hashpartitioning(id" in _plan(got) and "task" not in "".join(x.split("\n")[0] for x in _plan(got).split("hashpartitioning")[1:])
    want = sorted((i, t, c, p, q) for i, t, c, p in rows["a"] for j, u, _, q in rows["bb"] if i and t and (i, t) == (j, u))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 11


def test_a_task_holds_few_terms_whatever_the_texts():
    made = []

    def batches():
        for k in range(8):
            words = [[f"w{k}x{i}x{j}" for j in range(1000)] for i in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], names=["_tok"])
            made.append(k)
    got = SP._tally(SP.Words("text", 1, 2), SP.TALLY)(batches())
    next(got)
    assert len(made) <= 2  # terms go on before all texts are read


def test_normaliser_steps_are_skipped_only_where_they_change_nothing(spark):
    texts = ["á B \u0085 c", "أًة  X y", "  z\x1c\x1d w", "É A\t\r\n b ", "“Q” 　 r", "", None]
    c = X.null_guard(F.col("t"))
    plain = F.trim(F.regexp_replace(X.lower_latin(X.alef(X.strip_diacritics(X.nfc(c)))), X.WHITESPACE_RUN, " "))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.normalize_text(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == "á b c"
