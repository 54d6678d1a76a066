"""§2.E classification-metric queries over the ``predictions`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import fmt_mean_std
from corpuslab.operators import metrics as M
from corpuslab.operators import profile as PR
from corpuslab.operators import vectors as VEC
from corpuslab.plans import sqlmetrics as SM
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import predictions, scores, table

SEEDS = ["42", "123", "456"]
MODELS = ["", "42", "123", "456"]


def P(s, d):
    return predictions(s, d)


def _train_labels(s, d):
    c = table(s, d, "customer").select("c_nationkey")
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.explode(F.array(
        F.struct(F.lit("l1").alias("task"), F.col("n_regionkey").cast("bigint").alias("label")),
        F.struct(F.lit("l2").alias("task"), F.col("c_nationkey").cast("bigint").alias("label")))).alias("r")) \
        .select("r.*").unionByName(table(s, d, "supplier").select(F.lit("l3").alias("task"), F.col("s_suppkey").cast("bigint").alias("label")))


def _seed_runs(s, d):
    return M.classification_metrics(predictions(s, d, salts=SEEDS), ["salt", "task"])


def seed_stats(runs, config="lineitem_model"):
    r4 = F.round(F.col("macro_f1"), 4)
    return runs.groupBy("task").agg(
        F.round(F.avg("macro_f1"), 4).alias("mean"), F.round(F.stddev_pop("macro_f1"), 4).alias("std"),
        F.round(F.min("macro_f1"), 4).alias("min"), F.round(F.max("macro_f1"), 4).alias("max"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.format_number(r4, 4))), ",").alias("values")) \
        .withColumn("config", F.lit(config))


def _seed_table(s, d):
    st = seed_stats(_seed_runs(s, d))
    return st.groupBy("config").pivot("task", ["l1", "l2", "l3"]) \
        .agg(F.first(fmt_mean_std(F.col("mean") * 100, F.col("std") * 100)))


def _model_compare(s, d):
    m = M.classification_metrics(predictions(s, d, salts=MODELS).filter("task = 'l1'"), ["salt"]) \
        .select(F.concat(F.lit("model_"), F.col("salt")).alias("model"), "macro_f1", "accuracy")
    return M.model_compare(m)


def _dup_flagged(s, d):
    """Line ids whose (order, line number) occurs more than once."""
    from corpuslab.plans.views import predictions_wide
    pw = predictions_wide(s, d)
    dup = pw.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return pw.join(dup, ["l_orderkey", "l_linenumber"], "left_semi").select("id")


def _hard_vs_full(s, d):
    p = P(s, d)
    flagged = _dup_flagged(s, d).withColumn("flagged", F.lit(True))
    tagged = p.join(flagged, "id", "left").withColumn("subset", F.explode(F.array(
        F.lit("full"), F.when(F.col("flagged").isNull(), F.lit("hard")))))
    m = M.classification_metrics(tagged.filter(F.col("subset").isNotNull()), ["subset", "task"])
    w = m.groupBy("task").pivot("subset", ["full", "hard"]).agg(
        F.first(F.round(F.col("macro_f1") * 100, 2)).alias("f1_pct"), F.first("n").alias("n"))
    return w.select("task", F.col("full_f1_pct").alias("f1_full_pct"), F.col("hard_f1_pct").alias("f1_hard_pct"),
                    F.col("full_n").alias("n_full"), F.col("hard_n").alias("n_hard"),
                    (F.col("full_n") - F.col("hard_n")).alias("n_removed"),
                    F.round(F.col("hard_f1_pct") - F.col("full_f1_pct"), 2).alias("delta_pct"))


def _latency(s, d):
    ev = table(s, d, "events")
    batches = ev.groupBy("event_type", F.date_trunc("hour", "ts").alias("batch")) \
        .agg(F.sum("value").alias("ms"), F.count(F.lit(1)).alias("n"))
    return batches.groupBy(F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_samples"),
        F.round(F.sum("ms") / F.sum("n"), 6).alias("ms_per_sample"))


QUERIES = {
    "confusion": lambda s, d: M.confusion(P(s, d)),
    "confusion_norm": lambda s, d: M.confusion_norm(P(s, d)),
    "metrics_macro": lambda s, d: M.classification_metrics(P(s, d)),
    "report_per_class": lambda s, d: M.classification_report(P(s, d)),
    "metrics_by_task": lambda s, d: M.metrics_by_task(P(s, d)),
    "level_decay": lambda s, d: M.level_decay(P(s, d)),
    "error_rate": lambda s, d: M.error_summary(P(s, d)),
    "error_rate_by_class": lambda s, d: M.errors_by_class(P(s, d)),
    "pred_vs_true_dist": lambda s, d: M.distribution_compare(P(s, d), _train_labels(s, d)),
    "confidence_hist": lambda s, d: PR.histogram(
        P(s, d).withColumn("correct", F.col("pred_id") == F.col("true_id")), "confidence", 30, by="correct"),
    "class_weak_list": lambda s, d: M.hardest_classes(P(s, d), 5),
    "cross_entropy": lambda s, d: VEC.log_loss(scores(s, d)),
    "seed_stats": lambda s, d: seed_stats(_seed_runs(s, d)),
    "seed_table": _seed_table,
    "model_compare": _model_compare,
    "hard_vs_full": _hard_vs_full,
    "latency_summary": _latency,
}

# ---------------------------------------------------------------- SQL twins
PV = V.with_(V.predictions("p"))
_cs = SM.class_stats("p", ["task"])
_rt = """SELECT task, label, support, predicted, tp, precision, recall, f1 FROM st"""

SQL = {
    "confusion": PV + "SELECT task, true_id, pred_id, count(*) AS n FROM p GROUP BY ALL",
    "confusion_norm": PV + """, c AS (SELECT task, true_id, pred_id, count(*) AS n FROM p GROUP BY ALL)
SELECT task, true_id, pred_id, n, round(n / sum(n) OVER (PARTITION BY task, true_id), 6) AS share FROM c""",
    "metrics_macro": V.with_(V.predictions("p"), SM.metrics("p", ["task"])) + "SELECT * FROM m",
    "report_per_class": V.with_(V.predictions("p"), _cs) + """, agg AS (
  SELECT task, sum(tp) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
    sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
    sum(f1 * support) / sum(support) AS wf, CAST(sum(support) AS DOUBLE) AS tot FROM st GROUP BY task),
u AS (SELECT task, CAST(label AS VARCHAR) AS class, precision, recall, f1 AS f1_score, CAST(support AS DOUBLE) AS support FROM st
  UNION ALL SELECT task, 'accuracy', acc, acc, acc, acc FROM agg
  UNION ALL SELECT task, 'macro avg', mp, mr, mf, tot FROM agg
  UNION ALL SELECT task, 'weighted avg', wp, wr, wf, tot FROM agg)
SELECT task, class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
  round(support, 4) AS support FROM u""",
    "metrics_by_task": V.with_(V.predictions("p"), SM.metrics("p", ["task"])) + """SELECT task, accuracy, macro_f1 FROM m
UNION ALL SELECT 'mean', round(avg(accuracy), 6), round(avg(macro_f1), 6) FROM m""",
    "level_decay": V.with_(V.predictions("p"), SM.metrics("p", ["task"])) + """SELECT
  max(CASE WHEN task = 'l1' THEN macro_f1 END) AS macro_f1_l1, max(CASE WHEN task = 'l2' THEN macro_f1 END) AS macro_f1_l2,
  max(CASE WHEN task = 'l3' THEN macro_f1 END) AS macro_f1_l3 FROM m""",
    "error_rate": PV + """SELECT task, n, n_errors, round(n_errors / n, 6) AS error_rate,
  round(n_errors * 100.0 / n, 2) AS error_pct FROM (SELECT task, count(*) AS n,
  CAST(sum(CASE WHEN pred_id <> true_id THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM p GROUP BY task)""",
    "error_rate_by_class": PV + """SELECT task, true_id, count(*) AS n_errors, row_number() OVER (PARTITION BY task
  ORDER BY count(*) DESC, true_id) AS rank FROM p WHERE pred_id <> true_id GROUP BY task, true_id""",
    "pred_vs_true_dist": PV + """, pp AS (SELECT * FROM p),
t AS (SELECT task, true_id AS label, count(*) AS n_true FROM pp GROUP BY ALL),
q AS (SELECT task, pred_id AS label, count(*) AS n_pred FROM pp GROUP BY ALL),
tr0 AS (SELECT 'l1' AS task, CAST(n.n_regionkey AS BIGINT) AS label FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT 'l2', CAST(c.c_nationkey AS BIGINT) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT 'l3', CAST(s_suppkey AS BIGINT) FROM supplier),
tr AS (SELECT task, label, count(*) AS n_train FROM tr0 GROUP BY ALL),
j AS (SELECT coalesce(t.task, q.task) AS task, coalesce(t.label, q.label) AS label, n_true, n_pred
      FROM t FULL OUTER JOIN q ON t.task = q.task AND t.label = q.label)
SELECT coalesce(j.task, tr.task) AS task, coalesce(j.label, tr.label) AS label, CAST(coalesce(n_true, 0) AS BIGINT) AS n_true,
  CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred, CAST(coalesce(n_train, 0) AS BIGINT) AS n_train
FROM j FULL OUTER JOIN tr ON j.task = tr.task AND j.label = tr.label""",
    "confidence_hist": PV + """, base AS (SELECT pred_id = true_id AS correct, CAST(confidence AS DOUBLE) AS x FROM p),
st AS (SELECT correct, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM base GROUP BY correct),
b AS (SELECT b.correct, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS BIGINT) END AS bin
      FROM base b JOIN st ON b.correct = st.correct),
c AS (SELECT correct, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT s.correct, s.bin, round(lo + s.bin * ((hi - lo) / 30), 6) AS bin_lo, round(lo + (s.bin + 1) * ((hi - lo) / 30), 6) AS bin_hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n, mean, median
FROM (SELECT range AS bin, * FROM st, range(0, 30)) s LEFT JOIN c ON s.bin = c.bin AND s.correct = c.correct""",
    "class_weak_list": V.with_(V.predictions("p"), _cs) + """SELECT task, rank, label, round(f1, 6) AS f1, support FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY f1, label) AS rank FROM st) WHERE rank <= 5""",
    "seed_stats": V.with_(V.predictions("p", salts=SEEDS), SM.metrics("p", ["salt", "task"])) + """SELECT task,
  round(avg(macro_f1), 4) AS mean, round(stddev_pop(macro_f1), 4) AS std, round(min(macro_f1), 4) AS min,
  round(max(macro_f1), 4) AS max, count(*) AS n,
  array_to_string(list_sort(list(printf('%.4f', round(macro_f1, 4)))), ',') AS values, 'lineitem_model' AS config
FROM m GROUP BY task""",
    "seed_table": V.with_(V.predictions("p", salts=SEEDS), SM.metrics("p", ["salt", "task"])) + """, st AS (
  SELECT task, round(avg(macro_f1), 4) AS mean, round(stddev_pop(macro_f1), 4) AS std FROM m GROUP BY task),
f AS (SELECT task, CASE WHEN mean IS NULL THEN '—' ELSE printf('%.2f ± %.2f', mean * 100, coalesce(std * 100, 0.0)) END AS cell FROM st)
SELECT 'lineitem_model' AS config, max(CASE WHEN task = 'l1' THEN cell END) AS l1,
  max(CASE WHEN task = 'l2' THEN cell END) AS l2, max(CASE WHEN task = 'l3' THEN cell END) AS l3 FROM f""",
    "model_compare": V.with_(V.predictions("p", salts=MODELS), "pl1 AS (SELECT * FROM p WHERE task = 'l1')",
                             SM.metrics("pl1", ["salt"])) + """SELECT 'model_' || salt AS model, macro_f1, accuracy,
  macro_f1 = (SELECT max(macro_f1) FROM m) AS is_best, round(macro_f1 - (SELECT max(macro_f1) FROM m), 6) AS delta_to_best FROM m""",
    "hard_vs_full": V.with_(V.predictions_wide("pw"), V.predictions("p", wide="pw"),
                            """dup AS (SELECT l_orderkey, l_linenumber FROM pw GROUP BY ALL HAVING count(*) > 1),
flagged AS (SELECT id FROM pw WHERE EXISTS (SELECT 1 FROM dup WHERE dup.l_orderkey = pw.l_orderkey AND dup.l_linenumber = pw.l_linenumber)),
tagged AS (SELECT 'full' AS subset, task, true_id, pred_id FROM p
  UNION ALL SELECT 'hard', task, true_id, pred_id FROM p WHERE id NOT IN (SELECT id FROM flagged))""",
                            SM.metrics("tagged", ["subset", "task"])) + """, f AS (SELECT * FROM m WHERE subset = 'full'),
h AS (SELECT * FROM m WHERE subset = 'hard')
SELECT f.task, round(f.macro_f1 * 100, 2) AS f1_full_pct, round(h.macro_f1 * 100, 2) AS f1_hard_pct, f.n AS n_full,
  h.n AS n_hard, f.n - h.n AS n_removed, round(round(h.macro_f1 * 100, 2) - round(f.macro_f1 * 100, 2), 2) AS delta_pct
FROM f JOIN h ON f.task = h.task""",
    "cross_entropy": V.with_(V.SCORES) + """, sm AS (SELECT id, true_id, class_id, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM scores),
pr AS (SELECT id, true_id, class_id, e / sum(e) OVER (PARTITION BY id) AS p FROM sm),
rw AS (SELECT id, -ln(sum(CASE WHEN class_id = true_id THEN p END)) AS l_label,
  -ln(sum(CASE WHEN class_id // 2 = true_id // 2 THEN p END)) AS l_parent FROM pr GROUP BY id, true_id)
SELECT 'label' AS task, round(avg(l_label), 6) AS mean_loss FROM rw
UNION ALL SELECT 'parent', round(avg(l_parent), 6) FROM rw
UNION ALL SELECT 'joint', round(avg((coalesce(l_label, 0.0) + coalesce(l_parent, 0.0)) / 2), 6) FROM rw""",
    "latency_summary": """SELECT event_type AS model, count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_samples,
  round(sum(ms) / sum(n), 6) AS ms_per_sample FROM (
  SELECT event_type, date_trunc('hour', ts) AS batch, sum(value) AS ms, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
}
