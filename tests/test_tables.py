"""Shared tables follow their inputs; plans of the in-row features; streams resume."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslab import session
from corpuslab.plans import q_features as QF
from corpuslab.plans import q_stream as QS
from corpuslab.plans.views import tickets
from corpuslab.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    old: list[str] = []
    for n in (20, 200):
        docs.limit(n).write.mode("overwrite").parquet(f"{d}/documents.parquet")
        for key in ("tfidf", "class_separability", "nb_multinomial"):
            E.queries()[key](spark, d).count()
        assert QF.counted(spark, d, "word12", QF.SP.Words("text", 1, 2)).count() == n
        assert not any(os.path.exists(p) for p in old)  # tables of the state before are dropped
        mine = {k: v for k, v in session._TABLES.items() if k[2] == d}
        old = [p for _, p in mine.values()]
        assert old and all(os.path.exists(p) for p in old)
    for k in mine:
        session.remove_table(spark, session._TABLES.pop(k)[1])
    assert not any(os.path.exists(p) for _, p in mine.values())


def test_counts_and_norms_stay_in_the_row(spark, capsys):
    rows = QF.counted(spark, SF, "word12", QF.SP.Words("text", 1, 2))
    v = QF.vectorizer(spark, SF, "word12", rows, QF.WORD_MAX, QF.MIN_DF)
    v.weights(v.rows(rows)).explain()
    QF.SP.counted(QF.docs(spark, SF).drop("x"), QF.SP.CharWb()).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Window" not in plan
    assert "hashpartitioning(doc" not in plan and "hashpartitioning(term" not in plan


def test_stream_takes_more_tasks_and_resumes(spark, tmp_path):
    path, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def drain():
        src = tickets(spark, SF, J.stream_source(spark, path, docs.schema, max_bytes=1)).select("ticket_id", "title", "description")
        return QS.score_stream(spark, SF, src, sink, ckpt)
    docs.filter("doc_id % 2 = 0").repartition(3).write.mode("append").parquet(path)
    first = drain().count()
    assert first == docs.filter("doc_id % 2 = 0").count()
    docs.filter("doc_id % 2 = 1").repartition(2).write.mode("append").parquet(path)
    got = drain()
    batches = len([x for x in os.listdir(sink) if x.startswith("batch_id=")])
    assert batches == 5  # a batch of one file at a time: batches grow with the files
    want = E.queries()["stream_score"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_input_state_sees_names_and_sizes(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(p)
    a = session.input_state(spark, [p])
    assert a == session.input_state(spark, [p])
    spark.range(10).withColumn("id", F.col("id") + 1).write.mode("append").parquet(p)
    assert a != session.input_state(spark, [p])
