"""§2.D joins / set operations and the §2.E queries built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import hierarchy as H
from corpuslab.operators import metrics as M
from corpuslab.operators import relate as RL
from corpuslab.plans import sqlmetrics as SM
from corpuslab.plans import sqlviews as V
from corpuslab.plans.q_hier import PAIRS, _valid
from corpuslab.plans.views import predictions, predictions_wide, table, taxonomy, tickets

ENC_TASKS = ["category_level_1", "category_level_2", "priority", "sentiment"]
XS_TASKS = ["category_level_1", "priority", "channel", "sentiment"]
HIDDEN = ("category_level_1", "de")          # label hidden from the training dimension
SEEDS = [42, 123, 456]
ORDER = ["view", "click", "refund", "purchase"]


def _src_no():
    return F.substring("category_level_2", 4, 10).cast("int")


def _xs(s, d):
    t = tickets(s, d)
    train, cross = t.filter(_src_no() < 15), t.filter(_src_no() >= 15)
    dim = RL.build_dimension(train, XS_TASKS).filter(~((F.col("task") == HIDDEN[0]) & (F.col("label") == HIDDEN[1])))
    return RL.known_labels(cross, dim, XS_TASKS, "ticket_id")


def names(s, d):
    """(task, label_id, name) of the three levels."""
    r = table(s, d, "region").select(F.lit("l1").alias("task"), F.col("r_regionkey").cast("bigint").alias("label_id"), F.col("r_name").alias("name"))
    n = table(s, d, "nation").select(F.lit("l2"), F.col("n_nationkey").cast("bigint"), F.col("n_name"))
    su = table(s, d, "supplier").select(F.lit("l3"), F.col("s_suppkey").cast("bigint"), F.col("s_name"))
    return r.unionByName(n.toDF("task", "label_id", "name")).unionByName(su.toDF("task", "label_id", "name"))


def _flag_exact(s, d):
    """Test tickets (odd ids) whose text equals a training ticket's (even ids)."""
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    train = docs.filter(F.col("doc_id") % 2 == 0).select("key").distinct()
    test = docs.filter(F.col("doc_id") % 2 == 1)
    return test.join(train, "key", "left_semi").select(F.col("doc_id").alias("ticket_id"))


def _runs(s, d):
    ev = table(s, d, "events")
    return ev.groupBy(F.col("event_type").alias("config"), F.col("user_id").alias("seed")).agg(
        F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7, 2)
        .alias("minutes"))


def _grid(s, d):
    return RL.grid(table(s, d, "events"), "event_type", SEEDS)


def _reference(s, d):
    multi = M.classification_metrics(predictions(s, d, salts=["42", "123"]).filter("task in ('l1', 'l2')"), ["salt", "task"]) \
        .groupBy("task").agg(F.avg("macro_f1").alias("value"))
    single = M.classification_metrics(predictions(s, d)).select("task", F.col("macro_f1").alias("value"))
    return RL.reference_metric(multi, single)


def _cross_delta(s, d):
    cross = M.classification_metrics(predictions(s, d).join(
        predictions_wide(s, d).filter("l_returnflag = 'R'").select("id"), "id", "left_semi"))
    return cross.select("task", F.col("macro_f1").alias("cross_f1")).join(_reference(s, d), "task") \
        .withColumn("delta", F.round(F.col("cross_f1") - F.col("reference_f1"), 6))


def _dup_ids(pw):
    dup = pw.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return pw.join(dup, ["l_orderkey", "l_linenumber"], "left_semi")


def _flag_check(s, d):
    pw = predictions_wide(s, d)
    flagged = _dup_ids(pw).select("id")
    listed = _dup_ids(pw).filter("l_returnflag = 'R'").select("id")     # the report lists only part
    expected = flagged.select(F.count(F.lit(1))).scalar()                # but announces the full count
    return RL.choose_source(listed, flagged, expected)


def _union(s, d):
    base = M.classification_metrics(predictions(s, d)).select(F.lit("baseline").alias("model"), "task", "accuracy", "macro_f1")
    other = M.classification_metrics(predictions(s, d, "42")).select(F.lit("model_42").alias("model"), "task", "macro_f1")
    return RL.union_results(base, other)


NAMES = """, names AS (
  SELECT 'l1' AS task, CAST(r_regionkey AS BIGINT) AS label_id, r_name AS name FROM region
  UNION ALL SELECT 'l2', CAST(n_nationkey AS BIGINT), n_name FROM nation
  UNION ALL SELECT 'l3', CAST(s_suppkey AS BIGINT), s_name FROM supplier)
"""


QUERIES = {
    "filter_errors": lambda s, d: RL.errors(predictions(s, d)).select("id", "task", "true_id", "pred_id"),
    "dedup_keep_first": lambda s, d: RL.dedup(tickets(s, d), ["title", "description"], "ticket_id", ["category_level_1"]),
    "align_predictions": lambda s, d: RL.align(predictions_wide(s, d, "42").select("id", "pred_l1", "pred_l3"),
                                               predictions_wide(s, d).select("id", "true_l1", "true_l3")),
    "encode_labels": lambda s, d: RL.encode(tickets(s, d), RL.build_dimension(tickets(s, d), ENC_TASKS), ENC_TASKS)
        .select("ticket_id", *[f"label_{t}" for t in ENC_TASKS]),
    "decode_labels": lambda s, d: RL.decode(predictions(s, d), names(s, d)).select("id", "task", "true_name", "pred_name"),
    "known_label_filter": lambda s, d: _xs(s, d)[1],
    "all_task_intersection": lambda s, d: _xs(s, d)[0].select("ticket_id"),
    "drop_flagged": lambda s, d: RL.drop_flagged(tickets(s, d).filter(F.col("ticket_id") % 2 == 1), _flag_exact(s, d),
                                                 "ticket_id").select("ticket_id"),
    "taxonomy_pairs": lambda s, d: H.taxonomy_pairs(taxonomy(s, d)),
    "pair_membership": lambda s, d: H.pair_valid(predictions_wide(s, d), taxonomy(s, d)).select("id", "l1_l2_valid", "l2_l3_valid"),
    "parent_lookup": lambda s, d: H.expand_path(
        table(s, d, "events").select("event_id", F.col("user_id").alias("leaf")), "leaf",
        taxonomy(s, d).select(F.col("l3").alias("child"), F.col("l2").alias("parent")).distinct(),
        taxonomy(s, d).select(F.col("l2").alias("child"), F.col("l1").alias("parent")).distinct()),
    "experiment_grid": _grid,
    "pending_runs": lambda s, d: RL.pending(_grid(s, d), _runs(s, d)),
    "run_outcomes": lambda s, d: RL.run_outcomes(_grid(s, d), _runs(s, d)),
    "fallback_metric": _reference,
    "union_models": _union,
    "ordered_subset": lambda s, d: RL.order_by_list(table(s, d, "events"), "event_type", ORDER),
    "cross_source_delta": _cross_delta,
    "flag_report_check": _flag_check,
}

# ---------------------------------------------------------------- SQL twins
T = V.with_(V.TICKETS)
SRC = "CAST(substr(category_level_2, 4, 10) AS INTEGER)"
_xs_long = lambda src: " UNION ALL ".join(
    f"SELECT ticket_id, '{t}' AS task, CAST({t} AS VARCHAR) AS label FROM {src}" for t in XS_TASKS)
XS = T + f""", tr AS (SELECT * FROM tickets WHERE {SRC} < 15), cr AS (SELECT * FROM tickets WHERE {SRC} >= 15),
dim AS (SELECT DISTINCT task, label FROM ({_xs_long('tr')}) WHERE label IS NOT NULL
  AND NOT (task = '{HIDDEN[0]}' AND label = '{HIDDEN[1]}')),
cl AS ({_xs_long('cr')})
"""
_enc_long = " UNION ALL ".join(f"SELECT '{t}' AS task, CAST({t} AS VARCHAR) AS label FROM tickets" for t in ENC_TASKS)
_enc_joins = "\n".join(f"LEFT JOIN dim d{i} ON d{i}.task = '{t}' AND d{i}.label = CAST(t.{t} AS VARCHAR)"
                       for i, t in enumerate(ENC_TASKS))
_enc_sel = ", ".join(f"d{i}.label_id AS label_{t}" for i, t in enumerate(ENC_TASKS))
RUNS = """runs AS (SELECT event_type AS config, user_id AS seed,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 2) AS minutes FROM events GROUP BY ALL),
grid AS (SELECT DISTINCT event_type AS config, CAST(s.seed AS BIGINT) AS seed FROM events, (VALUES (42), (123), (456)) s(seed))"""
REF = V.with_(V.predictions("pm", salts=["42", "123"]), "pm2 AS (SELECT * FROM pm WHERE task IN ('l1', 'l2'))",
              SM.metrics("pm2", ["salt", "task"], "mm"), V.predictions("p"), SM.metrics("p", ["task"], "ms"),
              """mult AS (SELECT task, avg(macro_f1) AS v FROM mm GROUP BY task),
ref AS (SELECT coalesce(ms.task, mult.task) AS task, round(coalesce(mult.v, ms.macro_f1), 6) AS reference_f1,
  CASE WHEN mult.v IS NOT NULL THEN 'multi_seed_summary_mean' WHEN ms.macro_f1 IS NOT NULL THEN 'checkpoint_test_metrics' END AS source
  FROM ms FULL OUTER JOIN mult ON ms.task = mult.task)""")
DUPS = """dup AS (SELECT l_orderkey, l_linenumber FROM pw GROUP BY ALL HAVING count(*) > 1),
flagged AS (SELECT pw.* FROM pw JOIN dup USING (l_orderkey, l_linenumber))"""

SQL = {
    "filter_errors": V.with_(V.predictions("p")) + "SELECT id, task, true_id, pred_id FROM p WHERE pred_id <> true_id",
    "dedup_keep_first": T + """SELECT ticket_id, category_level_1 FROM tickets
WHERE ticket_id IN (SELECT min(ticket_id) FROM tickets GROUP BY title, description)""",
    "align_predictions": V.with_(V.predictions_wide("a", "42"), V.predictions_wide("b")) + """SELECT a.id, a.pred_l1, a.pred_l3,
  b.true_l1, b.true_l3 FROM a JOIN b ON a.id = b.id""",
    "encode_labels": T + f""", dim AS (SELECT task, label, CAST(dense_rank() OVER (PARTITION BY task ORDER BY label) - 1 AS BIGINT) AS label_id
  FROM (SELECT DISTINCT task, label FROM ({_enc_long}) WHERE label IS NOT NULL))
SELECT t.ticket_id, {_enc_sel} FROM tickets t
{_enc_joins}""",
    "decode_labels": V.with_(V.predictions("p")) + NAMES + """SELECT p.id, p.task, a.name AS true_name, b.name AS pred_name FROM p
LEFT JOIN names a ON a.task = p.task AND a.label_id = p.true_id
LEFT JOIN names b ON b.task = p.task AND b.label_id = p.pred_id""",
    "known_label_filter": XS + """SELECT task, count(*) AS n_in, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM dim
  WHERE dim.task = cl.task AND dim.label = cl.label) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
  count(*) - CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM dim WHERE dim.task = cl.task AND dim.label = cl.label) THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
FROM cl GROUP BY task""",
    "all_task_intersection": XS + """SELECT ticket_id FROM cr WHERE ticket_id NOT IN (
  SELECT ticket_id FROM cl WHERE NOT EXISTS (SELECT 1 FROM dim WHERE dim.task = cl.task AND dim.label = cl.label))""",
    "drop_flagged": T + """SELECT ticket_id FROM tickets t WHERE ticket_id % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM documents d JOIN documents e ON d.text = e.text
  WHERE d.doc_id = t.ticket_id AND e.doc_id % 2 = 0)""",
    "taxonomy_pairs": V.with_(V.TAXONOMY, PAIRS) + "SELECT edge, parent, child FROM pairs",
    "pair_membership": V.with_(V.predictions_wide("pw"), V.TAXONOMY, PAIRS, _valid("pw", "pred_l1", "pred_l2", "pred_l3"))
        + "SELECT id, l1_l2_valid, l2_l3_valid FROM pv",
    "parent_lookup": V.with_(V.TAXONOMY) + """, m3 AS (SELECT DISTINCT l3 AS c, l2 AS p FROM taxonomy),
m2 AS (SELECT DISTINCT l2 AS c, l1 AS p FROM taxonomy)
SELECT e.event_id, e.user_id AS leaf, m3.p AS l2, m2.p AS l1,
  1 + CAST(m3.p IS NOT NULL AS INT) + CAST(m2.p IS NOT NULL AS INT) AS path_len
FROM events e LEFT JOIN m3 ON e.user_id = m3.c LEFT JOIN m2 ON m3.p = m2.c""",
    "experiment_grid": V.with_(RUNS) + "SELECT config, seed FROM grid",
    "pending_runs": V.with_(RUNS) + "SELECT config, seed FROM grid WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.config = grid.config AND runs.seed = grid.seed)",
    "run_outcomes": V.with_(RUNS) + """SELECT g.config, g.seed, CASE WHEN r.minutes IS NOT NULL THEN 'ok' ELSE 'no_metrics' END AS status,
  r.minutes FROM grid g LEFT JOIN runs r ON g.config = r.config AND g.seed = r.seed""",
    "fallback_metric": REF + "SELECT task, reference_f1, source FROM ref",
    "union_models": V.with_(V.predictions("p"), SM.metrics("p", ["task"], "m0"), V.predictions("q", "42"),
                            SM.metrics("q", ["task"], "m1")) + """SELECT 'baseline' AS model, task, accuracy, macro_f1 FROM m0
UNION ALL SELECT 'model_42', task, NULL, macro_f1 FROM m1""",
    "ordered_subset": """SELECT CAST(o.pos AS BIGINT) AS pos, o.config, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows, c.n IS NOT NULL AS present
FROM (VALUES """ + ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(ORDER)) + """) o(pos, config)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c ON c.event_type = o.config""",
    "cross_source_delta": REF + """, cp AS (SELECT * FROM p WHERE id IN (SELECT id FROM p_w WHERE l_returnflag = 'R')),
""" + SM.metrics("cp", ["task"], "mc") + """
SELECT mc.task, mc.macro_f1 AS cross_f1, ref.reference_f1, ref.source, round(mc.macro_f1 - ref.reference_f1, 6) AS delta
FROM mc JOIN ref ON mc.task = ref.task""",
    "flag_report_check": V.with_(V.predictions_wide("pw"), DUPS) + """, listed AS (SELECT id FROM flagged WHERE l_returnflag = 'R'),
use_re AS (SELECT (SELECT count(*) FROM flagged) > (SELECT count(*) FROM listed) AS v)
SELECT id, 'report_flagged_pairs' AS source FROM listed WHERE NOT (SELECT v FROM use_re)
UNION ALL SELECT id, 'recomputed' FROM flagged WHERE (SELECT v FROM use_re)""",
}
