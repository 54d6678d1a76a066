"""§2.A scans, sources and sinks: each query writes Spark-derived data to the
shared folder, reads it back through the reader under test, and is compared
with the SQL that produces the same rows directly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as X
from corpuslab.operators import artefacts as A
from corpuslab.operators import hierarchy as H
from corpuslab.operators import metrics as M
from corpuslab.operators import ranking as R
from corpuslab.operators import relate as RL
from corpuslab.plans import q_hier, q_metrics, q_rank, q_relate
from corpuslab.plans import sqlmetrics as SM
from corpuslab.plans import sqlviews as V
from corpuslab.plans.q_text import s_norm
from corpuslab.plans.views import history, predictions, predictions_wide, table, taxonomy, tickets
from corpuslab.session import materialize, scratch_path
from corpuslab.sources import io as IO

SEEDS = ["42", "123", "456"]
TASKS5 = ["l1", "l2", "l3", "priority", "sentiment"]
REGISTRY = ["view", "click", "refund", "purchase", "signup"]


def _roundtrip(fmt):
    def q(s, d):
        path = scratch_path(s, f"tickets_{fmt}")
        IO.write_tickets(tickets(s, d), path, fmt)
        return IO.read_tickets(s, path, fmt=fmt)
    return q


def _report(s, d):
    path = scratch_path(s, "near_dup_report")
    IO.write_flag_report(q_relate._flag_exact(s, d), "ticket_id", 0.9, path)
    return IO.read_flagged(s, path)


def _metric_docs(s, d):
    m = M.classification_metrics(predictions(s, d, salts=SEEDS), ["salt", "task"])
    kv = F.explode(F.array(
        F.struct(F.concat(F.col("task"), F.lit("_macro_f1")).alias("k"), F.col("macro_f1").alias("v")),
        F.struct(F.concat(F.col("task"), F.lit("_accuracy")).alias("k"), F.col("accuracy").alias("v"))))
    docs = m.select(F.col("salt").cast("bigint").alias("seed"), kv.alias("e")) \
        .groupBy("seed").agg(F.map_from_entries(F.collect_list("e")).alias("metrics")) \
        .select(F.lit("lineitem_model").alias("config"), "seed", "metrics")
    return docs


def _glob(s, d):
    path = scratch_path(s, "run_metrics")
    IO.write_run_metrics(_metric_docs(s, d), path)
    runs = IO.read_run_metrics(s, path)
    return runs.select("config", "seed", F.explode(F.array(*[F.lit(t) for t in ("l1", "l2", "l3")])).alias("task"),
                       "metrics").select("config", "seed", "task",
                                         F.coalesce(*[F.when(F.col("task") == t, IO.extract_metric(F.col("metrics"), t))
                                                      for t in ("l1", "l2", "l3")]).alias("macro_f1"))


SHAPES = ['{"test_macro_f1_l1": %s}', '{"test": {"macro_f1_l1": %s}}', '{"test": {"l1": {"macro_f1": %s}}}',
          '{"l1_macro_f1": %s}', '{"macro_f1_l1": %s}', '{"l1": %s}', None, '{"l1_macro_f1": %s, "l1": 0.5}']


def _shapes(s, d):
    ev = table(s, d, "events")
    v = F.format_string("%.4f", F.col("value") / 100)
    sh = F.col("event_id") % len(SHAPES)
    doc = None
    for i, t in enumerate(SHAPES):
        body = F.col("props") if t is None else F.format_string(t, v)
        doc = F.when(sh == i, body) if doc is None else doc.when(sh == i, body)
    return ev.select("event_id", sh.alias("shape"), IO.extract_metric(doc, "l1").alias("macro_f1"))


LABELS = {"category_level_1": "label_l1", "category_level_2": "label_l2", "category_level_3": "label_l3",
          "priority": "label_priority", "sentiment": "label_sentiment"}
PREPARED = ["ticket_id", "text", "title", "description", *list(LABELS)[:3], "label_l1", "label_l2", "label_l3",
            "priority", "label_priority", "sentiment", "label_sentiment"]


def _splits(s, d):
    path = scratch_path(s, "splits")
    t = tickets(s, d)
    sp = R.stratified_split(t.select("ticket_id", "category_level_1"), "ticket_id", "category_level_1", 42)
    t = t.join(sp.select("ticket_id", "split"), "ticket_id").withColumn(
        "text", X.normalize_text(X.compose_text(F.col("title"), F.col("description"))))
    t = RL.encode(t, RL.build_dimension(t, list(LABELS)), list(LABELS), prefix="_id_")
    t = t.select("*", *[F.col(f"_id_{c}").alias(n) for c, n in LABELS.items()])
    IO.write_splits(t, path, PREPARED)
    return s.read.schema(t.select(*PREPARED, "split").schema).parquet(path)


def _json_result(s, d):
    """The whole consistency document, written as JSON and read back."""
    inc = H.inconsistency(predictions_wide(s, d), taxonomy(s, d))
    e = materialize(q_hier.effect(s, d), "correction-effect")

    def part(name, **cols):
        return F.struct(*[e.select(src).scalar().alias(n) for n, src in cols.items()]).alias(name)
    doc = inc.select(
        "n_test", F.struct(*[F.col(c) for c in inc.columns if c != "n_test"]).alias("inconsistency"),
        part("macro_f1_uncorrected", l1="f1_l1_before", l2="f1_l2_before", l3="f1_l3_before"),
        part("macro_f1_corrected", l2="f1_l2_after", l3="f1_l3_after", delta_l2="delta_l2", delta_l3="delta_l3"),
        part("post_correction_inconsistencies", l1_l2="post_l1_l2_invalid", l2_l3="post_l2_l3_invalid"))
    path = scratch_path(s, "consistency_result")
    doc.write.mode("overwrite").json(path)
    r = s.read.schema(doc.schema).json(path)
    return r.select("n_test", "inconsistency.full_count", "inconsistency.full_rate",
                    *[F.col(f"macro_f1_uncorrected.{x}").alias(f"f1_{x}") for x in ("l1", "l2", "l3")],
                    *[F.col(f"macro_f1_corrected.{x}").alias(n) for x, n in (("l2", "corrected_l2"), ("l3", "corrected_l3"),
                                                                             ("delta_l2", "delta_l2"), ("delta_l3", "delta_l3"))],
                    *[F.col(f"post_correction_inconsistencies.{x}").alias(f"post_{x}_invalid") for x in ("l1_l2", "l2_l3")])


COMPOSED = "trim(coalesce(title, '') || ' ' || coalesce(description, ''))"
REPORT_SCHEMA = T.StructType([T.StructField("task", T.StringType()), T.StructField("class", T.StringType())] +
                             [T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1_score", "support")])


def _metric_table(s, d):
    path = scratch_path(s, "report_table")
    IO.write_metrics_table(M.classification_report(predictions(s, d)), path)
    return IO.read_metrics_table(s, path, REPORT_SCHEMA)


def _pred_store(s, d):
    path = scratch_path(s, "pred_store")
    for m in ("42", "123"):
        IO.save_predictions(predictions(s, d, m).select("id", "task", "true_id", "pred_id"), f"m{m}", path)
    return IO.load_predictions(s, path, ["m42", "m123"])


def _run_log(s, d):
    path = scratch_path(s, "run_log")
    h = history(s, d).select("run", "epoch", F.lit("avg_value").alias("metric"), F.col("metric").alias("value"))
    IO.log_metrics(h.filter("epoch <= 15"), path, {"lr": "2e-5", "stage": "first"})
    IO.log_metrics(h.filter("epoch > 15"), path, {"lr": "2e-5", "stage": "second"})
    return s.read.parquet(path).select("run", "epoch", "metric", "value", F.col("params")["lr"].alias("lr"))


def _keys(s, d):
    """Artefact keys per model derived from events: task from the user, kind
    from the value (weights only where value ≥ 25)."""
    ev = table(s, d, "events")
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS5]), (F.col("user_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("value") >= 25, "weight").otherwise("bias")
    return ev.select(F.col("event_type").alias("model"), F.concat(task, F.lit(".1."), kind).alias("key")).distinct()


def _registry(s):
    return s.createDataFrame([(m,) for m in REGISTRY], "model string")


QUERIES = {
    "src_csv": _roundtrip("csv"),
    "src_jsonl": _roundtrip("json"),
    "src_json_report": _report,
    "src_metrics_glob": _glob,
    "metrics_extract": _shapes,
    "sink_splits": _splits,
    "sink_json_result": _json_result,
    "sink_metric_table": _metric_table,
    "pred_store": _pred_store,
    "run_log_append": _run_log,
    "artefact_status": lambda s, d: A.artefact_status(_registry(s), _keys(s, d).filter(F.col("model") != "signup")
                                                      .unionByName(_keys(s, d).filter((F.col("model") == "signup") & F.col("key").endswith(".bias")))),
    "artefact_key_check": lambda s, d: A.keys_equal(_keys(s, d), A.expected_keys(_keys(s, d).select("model").distinct(), TASKS5)),
}

# ---------------------------------------------------------------- SQL twins
_TK = ", ".join(f"{c}" for c in ["ticket_id", "title", "description", "category_level_1", "category_level_2",
                                  "category_level_3", "priority", "sentiment", "channel", "n_chars"])
_doc = "CASE " + " ".join(
    (f"WHEN event_id % {len(SHAPES)} = {i} THEN props" if t is None else
     f"WHEN event_id % {len(SHAPES)} = {i} THEN printf('{t}', printf('%.4f', value / 100))")
    for i, t in enumerate(SHAPES)) + " END"


def _sql_extract(doc, task):
    paths = IO.metric_paths(task)
    return "coalesce(" + ", ".join(f"TRY_CAST(json_extract_string({doc}, '{p}') AS DOUBLE)" for p in paths) + ")"


_TASK_SQL = ", ".join(f"('{t}')" for t in TASKS5)
KEYS = f"""k AS (SELECT DISTINCT event_type AS model,
  ['{"', '".join(TASKS5)}'][CAST(user_id % 5 + 1 AS INTEGER)] || '.1.' || CASE WHEN value >= 25 THEN 'weight' ELSE 'bias' END AS key
  FROM events)"""

SQL = {
    "src_csv": V.with_(V.TICKETS) + f"SELECT {_TK} FROM tickets",
    "src_jsonl": V.with_(V.TICKETS) + f"SELECT {_TK} FROM tickets",
    "src_json_report": """SELECT CAST(d.doc_id AS BIGINT) AS test_idx, CAST(0.9 AS DOUBLE) AS threshold,
  count(*) OVER () AS n_flagged_above_threshold FROM documents d
WHERE d.doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id % 2 = 0)""",
    "src_metrics_glob": V.with_(V.predictions("p", salts=SEEDS), SM.metrics("p", ["salt", "task"])) + """SELECT
  'lineitem_model' AS config, CAST(salt AS BIGINT) AS seed, task, macro_f1 FROM m""",
    "metrics_extract": f"""SELECT event_id, event_id % {len(SHAPES)} AS shape, {_sql_extract('doc', 'l1')} AS macro_f1
FROM (SELECT event_id, {_doc} AS doc FROM events)""",
    "sink_splits": V.with_(V.TICKETS, q_rank.SPLIT_SQL) + f"""SELECT ticket_id, {s_norm(COMPOSED)} AS text, title, description,
  t.category_level_1, t.category_level_2, t.category_level_3, priority, sentiment, """ + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (PARTITION BY {c} IS NULL ORDER BY CAST({c} AS VARCHAR)) - 1 END AS {n}"
        for c, n in {"t.category_level_1": "label_l1", "t.category_level_2": "label_l2", "t.category_level_3": "label_l3",
                     "priority": "label_priority", "sentiment": "label_sentiment"}.items()) + """, splits.split
FROM tickets t JOIN splits USING (ticket_id)""",
    "sink_json_result": q_hier.RESULT,
    "sink_metric_table": q_metrics.SQL["report_per_class"],
    "pred_store": V.with_(V.predictions("a", "42"), V.predictions("b", "123")) + """SELECT a.id, a.task, a.true_id,
  a.pred_id AS pred_m42, b.pred_id AS pred_m123 FROM a JOIN b ON a.id = b.id AND a.task = b.task""",
    "run_log_append": V.with_(V.HISTORY) + "SELECT run, epoch, 'avg_value' AS metric, metric AS value, '2e-5' AS lr FROM history",
    "artefact_status": V.with_(KEYS) + f""", kk AS (SELECT * FROM k WHERE model <> 'signup' OR key LIKE '%.bias'),
reg AS (SELECT * FROM (VALUES {", ".join(f"('{m}')" for m in REGISTRY)}) r(model)),
agg AS (SELECT model, array_to_string(list_sort(list(DISTINCT split_part(key, '.', 1))), ',') AS tasks,
  bool_or(key LIKE '%.weight') AS has_w FROM kk GROUP BY model)
SELECT reg.model, CASE WHEN has_w IS NULL THEN 'skipped_missing_checkpoint' WHEN has_w THEN 'ok'
  ELSE 'skipped_missing_heads' END AS status, tasks FROM reg LEFT JOIN agg ON reg.model = agg.model""",
    "artefact_key_check": V.with_(KEYS) + f""", e AS (SELECT m.model, t.task || '.1.' || kd.kind AS key
  FROM (SELECT DISTINCT model FROM k) m, (VALUES {_TASK_SQL}) t(task), (VALUES ('weight'), ('bias')) kd(kind)),
mi AS (SELECT model, count(*) AS n FROM (SELECT * FROM e EXCEPT SELECT * FROM k) GROUP BY model),
ex AS (SELECT model, count(*) AS n FROM (SELECT * FROM k EXCEPT SELECT * FROM e) GROUP BY model),
ms AS (SELECT model FROM k UNION SELECT model FROM e)
SELECT ms.model, coalesce(mi.n, 0) AS n_missing, coalesce(ex.n, 0) AS n_extra,
  coalesce(mi.n, 0) = 0 AND coalesce(ex.n, 0) = 0 AS keys_equal FROM ms LEFT JOIN mi USING (model) LEFT JOIN ex USING (model)""",
}
