"""Bootstrap, McNemar, running means, splits and streams away from the SQL twins."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import hierarchy as H
from corpuslab.operators import metrics as M
from corpuslab.operators import ranking as R
from corpuslab.operators import stats as S
from corpuslab.plans import q_stream as QS
from corpuslab.plans.views import predictions

SF = "/root/testdata/sf0.001"


def macro_f1(true, pred, w):
    labels = sorted(set(true[w > 0]) | set(pred[w > 0]))
    out = []
    for c in labels:
        tp, p, t = w[(true == c) & (pred == c)].sum(), w[pred == c].sum(), w[true == c].sum()
        out.append(2 * tp / (p + t) if p + t else 0.0)
    return np.mean(out)


def test_bootstrap_on_cells_agrees_with_rows(spark):
    """1,000 replicates from cells against 400 drawn row by row: mean and
    interval ends within 0.004."""
    p = predictions(spark, SF, salts=["42", "123"]).filter("task = 'l1'").cache()
    got = {r["salt"]: r for r in S.bootstrap_f1(p, "salt", 1000, 7).collect()}
    rng = np.random.default_rng(1)
    for salt in ("42", "123"):
        x = p.filter(F.col("salt") == salt).select("true_id", "pred_id").toPandas().to_numpy()
        f = [macro_f1(x[:, 0], x[:, 1], rng.poisson(1, len(x))) for _ in range(400)]
        assert got[salt]["reps"] == 1000
        assert abs(got[salt]["mean"] - np.mean(f)) < 0.004
        assert abs(got[salt]["ci_low"] - np.quantile(f, 0.025)) < 0.004 and abs(got[salt]["ci_high"] - np.quantile(f, 0.975)) < 0.004
    again = {r["salt"]: r for r in S.bootstrap_f1(p.repartition(7), "salt", 1000, 7).collect()}
    assert again == got  # seeded by cell, however the rows lie


def test_kde_integrates_to_one(spark):
    p = predictions(spark, SF, salts=["42", "123"]).filter("task = 'l1'")
    k = S.kde(S.replicate_f1(p, "salt", 1000, 7), "salt", "macro_f1", 50).orderBy("salt", "gi").toPandas()
    for _, g in k.groupby("salt"):
        area = np.trapezoid(g.density, g.x)
        assert len(g) == 50 and 0.97 < area < 1.01


@pytest.mark.parametrize("b,c", [(22, 27), (0, 5), (1, 9), (40, 41), (300, 420)])
def test_mcnemar_p(b, c):
    k, n = min(b, c), b + c
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
    assert abs(S._half_beta(n, k) - want) < 1e-9
    if (b, c) == (22, 27):
        assert round(S._half_beta(n, k), 6) == 0.568172


def test_mcnemar_large_counts():
    assert S._half_beta(2_000_000_000, 1_000_000_000) == 1.0
    p = S._half_beta(2_000_000_000, 999_970_000)
    z = 2 * 0.5 * math.erfc((30_000 - 0.5) / math.sqrt(2_000_000_000 / 4) / math.sqrt(2))
    assert abs(p - z) < 1e-4


def test_running_mean_two_months_nulls_and_precision(spark):
    rows = [("a", dt.datetime(2024, 1, 31), 1, 1.0), ("a", dt.datetime(2024, 2, 1), 2, 3.0), ("a", dt.datetime(2024, 2, 2), 3, None),
            ("b", dt.datetime(2024, 1, 1), 4, None), ("b", dt.datetime(2024, 3, 1), 5, 1e-9), (None, dt.datetime(2024, 3, 1), 6, 2.0)]
    df = spark.createDataFrame(rows, "u string, ts timestamp, id long, v double")
    got = {r["id"]: r["running_mean"] for r in R.running_mean(df, ["u"], ["ts", "id"], "v", F.date_trunc("day", "ts")).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: None, 5: pytest.approx(1e-9, rel=1e-6), 6: 2.0}


def test_split_keeps_rows_without_label(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "x").alias("label"))
    out = R.stratified_split(df, "id", "label")
    assert out.count() == 100 and out.filter("label is null").count() == 50


def test_stream_dedup_bounds(spark):
    """No two kept rows of a key within the delay; every row later than its
    predecessor by more than twice the delay plus a batch's span is kept."""
    delay = dt.timedelta(hours=1)
    rows = QS.arriving_tickets(spark, SF).collect()
    kept = {r["ticket_id"] for r in QS._dedup(spark, SF).collect()}
    span = (max(r["ts"] for r in rows) - min(r["ts"] for r in rows)) / 4
    by = {}
    for r in sorted(rows, key=lambda r: r["ts"]):
        by.setdefault(r["text_key"], []).append(r)
    repeats = 0
    for seq in by.values():
        stay = [r for r in seq if r["ticket_id"] in kept]
        assert seq[0]["ticket_id"] in kept
        for a, b in zip(stay, stay[1:]):
            assert b["ts"] - a["ts"] > delay
        for a, b in zip(seq, seq[1:]):
            if b["ts"] - a["ts"] > 2 * delay + span:
                assert b["ticket_id"] in kept
        repeats += len(seq) - len(stay)
    assert repeats > 0


def test_stream_late_row_is_dropped(spark):
    """Three slices in order, then one row far behind the watermark."""
    from corpuslab.session import scratch_path
    from corpuslab.streaming import jobs as J
    path, sink, ckpt = (scratch_path(spark, x) for x in ("late_in", "late_out", "late_ckpt"))
    schema = "id long, ts timestamp, kind string"
    days = [[(1, dt.datetime(2024, 1, 1, 3), "x"), (2, dt.datetime(2024, 1, 1, 4), "x")], [(3, dt.datetime(2024, 1, 4), "x")],
            [(4, dt.datetime(2024, 1, 8), "x")], [(5, dt.datetime(2024, 1, 1, 5), "x"), (6, dt.datetime(2024, 1, 12), "x")]]
    for day in days:
        df = spark.createDataFrame(day, schema)
        df.write.mode("append").parquet(path)
        src = J.stream_source(spark, path, df.schema, max_files=100)
        J.run_to_parquet(J.stream_counts(src, "ts", ["kind"], "1 day", "1 day"), sink, ckpt)
    got = {r["window_start"].day: r["n"] for r in spark.read.parquet(sink).collect()}
    assert got == {1: 2, 4: 1, 8: 1}


def test_stream_score_replay_overwrites(spark, tmp_path):
    from corpuslab.streaming import jobs as J
    src_dir, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src_dir)
    for ckpt in ("a", "b"):  # a lost checkpoint replays batch 0
        J.stream_score(J.stream_source(spark, src_dir, spark.range(1).schema, 100), lambda b: b, sink, str(tmp_path / ckpt)).awaitTermination()
    assert spark.read.parquet(sink).count() == 10


def test_exact_quantiles(spark):
    from corpuslab.operators import profile as PR
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(0, 1, 501), "b": np.repeat([1.0, 2.0, 9.0], [300, 5, 7]), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    got = {r["k"]: r["q"] for r in PR.exact_quantiles(df, ["k"], "x", (0.1, 0.5, 0.975)).collect()}
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.975]).tolist())
    assert PR.exact_quantiles(df, [], "x", [0.5]).first()["q"][0] == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_hierarchical_last_parent_counts(spark):
    # leaf 7 stands under 9, then under 3: the last row counts, not the greatest parent
    train = spark.createDataFrame([(1, 0, 9, 7), (2, 1, 3, 7), (3, 1, 3, 8)], "seq int, l1 int, l2 int, l3 int")
    pw = spark.createDataFrame([(1, 7, 8), (2, 8, 8)], "id int, pred_l3 int, true_l3 int")
    got = H.hierarchical_f1(pw, train, order=["seq"]).collect()[0]
    assert (got["hP"], got["hR"]) == (round((2 / 3 + 1) / 2, 6),) * 2
    turned = train.withColumn("seq", -F.col("seq"))  # now 9 is the last parent of 7
    assert H.hierarchical_f1(pw, turned, order=["seq"]).collect()[0]["hP"] == 0.5


def test_report_rows(spark):
    # class 3 is only predicted, class 2 never; a null label is a class of its own
    rows = [("a", 1, 1), ("a", 1, 3), ("a", 2, 1), ("b", 5, 5), ("b", None, None)]
    p = spark.createDataFrame(rows, "task string, true_id int, pred_id int")
    got = {(r["task"], r["class"]): (r["precision"], r["recall"], r["f1_score"], r["support"]) for r in M.classification_report(p).collect()}
    assert got["a", "1"] == (0.5, 0.5, 0.5, 2.0) and got["a", "3"] == (0.0, 0.0, 0.0, 0.0) and got["a", "2"] == (0.0, 0.0, 0.0, 1.0)
    assert got["a", "accuracy"] == (0.3333,) * 4 and got["a", "macro avg"] == (0.1667, 0.1667, 0.1667, 3.0)
    assert got["a", "weighted avg"] == (0.3333, 0.3333, 0.3333, 3.0) and got["b", "macro avg"][3] == 2.0
    assert len(got) == 3 + 2 + 2 * 3 and ("b", None) in got


def test_bootstrap_draws_do_not_depend_on_batches(spark, monkeypatch):
    cells = spark.createDataFrame([(i, f"p{i % 3}", 1 + i % 5) for i in range(40)], "a int, b string, n long").coalesce(1)
    want = sorted(S.replicate_cells(cells, ["a", "b"], 20, 3).collect())
    monkeypatch.setattr(S, "DRAWN", 7)
    got = S.replicate_cells(cells.repartition(3), ["a", "b"], 20, 3).collect()
    assert sorted(got) == want and all(r["w"] > 0 and 1 <= r["rep"] <= 20 for r in want)
