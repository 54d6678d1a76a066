"""§2.F hierarchy queries: predictions_wide against the supplier taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators import hierarchy as H
from corpuslab.operators import metrics as M
from corpuslab.plans import sqlmetrics as SM
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import predictions_wide, taxonomy
from corpuslab.session import materialize, scratch_path


def _pw(s, d):
    return predictions_wide(s, d)


def effect(s, d):
    """One row: macro-F1 before and after the correction, its deltas, and the
    invalid pairs that remain. The corrected paths are written once."""
    c = materialize(H.correct_paths(_pw(s, d), taxonomy(s, d)), "corrected-paths")
    long = c.select(F.explode(F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.lit(lv).alias("task"), F.col(f"true_{lv}").alias("true_id"),
                 F.col(src).alias("pred_id"))
        for stage, lv, src in (("before", "l1", "pred_l1"), ("before", "l2", "pred_l2"), ("after", "l2", "corr_l2"),
                               ("before", "l3", "pred_l3"), ("after", "l3", "corr_l3"))])).alias("r")).select("r.*")
    m = M.classification_metrics(long, ["stage", "task"])
    w = m.select(F.concat(F.lit("f1_"), F.col("task"), F.lit("_"), F.col("stage")).alias("k"), "macro_f1") \
        .groupBy().pivot("k", ["f1_l1_before", "f1_l2_before", "f1_l2_after", "f1_l3_before", "f1_l3_after"]).agg(F.first("macro_f1"))
    post = H.pair_valid(c, taxonomy(s, d), "pred_l1", "corr_l2", "corr_l3").agg(
        F.sum((~F.col("l1_l2_valid")).cast("bigint")).alias("post_l1_l2_invalid"),
        F.sum((~F.col("l2_l3_valid")).cast("bigint")).alias("post_l2_l3_invalid"))
    w = w.withColumn("delta_l2", F.round(F.col("f1_l2_after") - F.col("f1_l2_before"), 6)) \
        .withColumn("delta_l3", F.round(F.col("f1_l3_after") - F.col("f1_l3_before"), 6))
    return w.select("*", *[post.select(x).scalar().alias(x) for x in post.columns])


def _from_report(s, d):
    """Write the consistency report as JSON to shared storage, read it back
    and derive consistency from it (no recomputation)."""
    rep = H.inconsistency(_pw(s, d), taxonomy(s, d))
    path = scratch_path(s, "consistency_report")
    rep.write.mode("overwrite").json(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rep.schema.fields])
    r = s.read.schema(schema).json(path)
    return r.select("n_test", (F.col("n_test") - F.col("full_count")).alias("consistent_count"),
                    F.round(F.lit(1.0) - F.col("full_rate"), 6).alias("consistency_rate"))


QUERIES = {
    "taxonomy_children": lambda s, d: H.children(taxonomy(s, d)),
    "taxonomy_parent": lambda s, d: H.parent_map(_pw(s, d), "pred_l3", "pred_l2", ["l_orderkey", "l_linenumber", "id"]),
    "inconsistency_rates": lambda s, d: H.inconsistency(_pw(s, d), taxonomy(s, d)),
    "path_consistency": lambda s, d: H.path_consistency(_pw(s, d), taxonomy(s, d)),
    "consistency_from_report": _from_report,
    "constraint_correction": lambda s, d: H.correct_paths(_pw(s, d), taxonomy(s, d))
        .select("id", "pred_l1", "pred_l2", "pred_l3", "corr_l2", "corr_l3"),
    "correction_effect": lambda s, d: effect(s, d).drop("f1_l1_before"),
    "hierarchical_prf": lambda s, d: H.hierarchical_f1(_pw(s, d), taxonomy(s, d)),
    "parent_accuracy": lambda s, d: H.parent_accuracy(_pw(s, d)),
}

PAIRS = """pairs AS (SELECT DISTINCT 'l1_l2' AS edge, l1 AS parent, l2 AS child FROM taxonomy
  UNION SELECT DISTINCT 'l2_l3', l2, l3 FROM taxonomy)"""


def _valid(src, a, b, c, name="pv"):
    return f"""{name} AS (SELECT s.*,
  EXISTS (SELECT 1 FROM pairs WHERE edge = 'l1_l2' AND parent = s.{a} AND child = s.{b}) AS l1_l2_valid,
  EXISTS (SELECT 1 FROM pairs WHERE edge = 'l2_l3' AND parent = s.{b} AND child = s.{c}) AS l2_l3_valid FROM {src} s)"""


BASE = V.with_(V.predictions_wide("pw"), V.TAXONOMY, PAIRS, _valid("pw", "pred_l1", "pred_l2", "pred_l3"))
_inc_parts = {"l1_l2": "NOT l1_l2_valid", "l2_l3": "NOT l2_l3_valid", "full": "NOT l1_l2_valid OR NOT l2_l3_valid"}
INC = BASE + ", inc AS (SELECT count(*) AS n_test, " + ", ".join(
    f"CAST(sum(CAST({c} AS INT)) AS BIGINT) AS {k}_count" for k, c in _inc_parts.items()) + " FROM pv)\n"
_inc_sel = ", ".join(["n_test"] + [x for k in _inc_parts for x in (
    f"{k}_count", f"round({k}_count / n_test, 6) AS {k}_rate", f"round({k}_count * 100.0 / n_test, 2) AS {k}_pct")])
CORR = BASE + """, first AS (SELECT edge, parent, min(child) AS fc FROM pairs GROUP BY ALL),
c1 AS (SELECT pw.*, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE edge = 'l1_l2' AND parent = pw.pred_l1 AND child = pw.pred_l2)
  THEN pred_l2 ELSE coalesce((SELECT fc FROM first WHERE edge = 'l1_l2' AND parent = pw.pred_l1), pred_l2) END AS corr_l2 FROM pw),
corr AS (SELECT c1.*, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE edge = 'l2_l3' AND parent = c1.corr_l2 AND child = c1.pred_l3)
  THEN pred_l3 ELSE coalesce((SELECT fc FROM first WHERE edge = 'l2_l3' AND parent = c1.corr_l2), pred_l3) END AS corr_l3 FROM c1)
"""
_long = """, lg AS (SELECT 'before' AS stage, 'l2' AS task, true_l2 AS true_id, pred_l2 AS pred_id FROM corr
  UNION ALL SELECT 'before', 'l1', true_l1, pred_l1 FROM corr
  UNION ALL SELECT 'after', 'l2', true_l2, corr_l2 FROM corr
  UNION ALL SELECT 'before', 'l3', true_l3, pred_l3 FROM corr
  UNION ALL SELECT 'after', 'l3', true_l3, corr_l3 FROM corr), """ + SM.metrics("lg", ["stage", "task"]) + ", " + \
    _valid("corr", "pred_l1", "corr_l2", "corr_l3", "pc") + "\n"


def _f1(task, stage):
    return f"max(CASE WHEN task = '{task}' AND stage = '{stage}' THEN macro_f1 END)"


_INC = ", inc AS (SELECT count(*) AS n_test, " + ", ".join(
    f"CAST(sum(CAST({c} AS INT)) AS BIGINT) AS {k}_count" for k, c in _inc_parts.items()) + " FROM pv)\n"
RESULT = CORR + _long[:-1] + _INC + f"""SELECT (SELECT n_test FROM inc) AS n_test, (SELECT full_count FROM inc) AS full_count,
  (SELECT round(full_count / n_test, 6) FROM inc) AS full_rate, {_f1('l1', 'before')} AS f1_l1, {_f1('l2', 'before')} AS f1_l2,
  {_f1('l3', 'before')} AS f1_l3, {_f1('l2', 'after')} AS corrected_l2, {_f1('l3', 'after')} AS corrected_l3,
  round({_f1('l2', 'after')} - {_f1('l2', 'before')}, 6) AS delta_l2, round({_f1('l3', 'after')} - {_f1('l3', 'before')}, 6) AS delta_l3,
  (SELECT CAST(sum(CAST(NOT l1_l2_valid AS INT)) AS BIGINT) FROM pc) AS post_l1_l2_invalid,
  (SELECT CAST(sum(CAST(NOT l2_l3_valid AS INT)) AS BIGINT) FROM pc) AS post_l2_l3_invalid FROM m"""

SQL = {
    "taxonomy_children": V.with_(V.TAXONOMY, PAIRS) + """SELECT edge, parent,
  array_to_string(list_transform(list_sort(list(child)), lambda x: CAST(x AS VARCHAR)), ',') AS children,
  CAST(count(*) AS BIGINT) AS n_children FROM pairs GROUP BY ALL""",
    "taxonomy_parent": V.with_(V.predictions_wide("pw")) + """SELECT pred_l3 AS child,
  max(CASE WHEN rn = 1 THEN pred_l2 END) AS parent, count(DISTINCT pred_l2) AS n_parents, count(DISTINCT pred_l2) > 1 AS conflict
FROM (SELECT *, row_number() OVER (PARTITION BY pred_l3 ORDER BY l_orderkey DESC, l_linenumber DESC, id DESC) AS rn FROM pw)
GROUP BY pred_l3""",
    "inconsistency_rates": INC + f"SELECT {_inc_sel} FROM inc",
    "path_consistency": BASE + """SELECT consistent_count, n - consistent_count AS inconsistent_count,
  round(consistent_count / n, 6) AS rate, round(consistent_count * 100.0 / n, 2) AS pct FROM (
  SELECT count(*) AS n, CAST(sum(CAST(l1_l2_valid AND l2_l3_valid AS INT)) AS BIGINT) AS consistent_count FROM pv)""",
    "consistency_from_report": INC + """SELECT n_test, n_test - full_count AS consistent_count,
  round(1.0 - round(full_count / n_test, 6), 6) AS consistency_rate FROM inc""",
    "constraint_correction": CORR + "SELECT id, pred_l1, pred_l2, pred_l3, corr_l2, corr_l3 FROM corr",
    "correction_effect": CORR + _long + """SELECT
  max(CASE WHEN task = 'l2' AND stage = 'before' THEN macro_f1 END) AS f1_l2_before,
  max(CASE WHEN task = 'l2' AND stage = 'after' THEN macro_f1 END) AS f1_l2_after,
  max(CASE WHEN task = 'l3' AND stage = 'before' THEN macro_f1 END) AS f1_l3_before,
  max(CASE WHEN task = 'l3' AND stage = 'after' THEN macro_f1 END) AS f1_l3_after,
  round(max(CASE WHEN task = 'l2' AND stage = 'after' THEN macro_f1 END) - max(CASE WHEN task = 'l2' AND stage = 'before' THEN macro_f1 END), 6) AS delta_l2,
  round(max(CASE WHEN task = 'l3' AND stage = 'after' THEN macro_f1 END) - max(CASE WHEN task = 'l3' AND stage = 'before' THEN macro_f1 END), 6) AS delta_l3,
  (SELECT CAST(sum(CAST(NOT l1_l2_valid AS INT)) AS BIGINT) FROM pc) AS post_l1_l2_invalid,
  (SELECT CAST(sum(CAST(NOT l2_l3_valid AS INT)) AS BIGINT) FROM pc) AS post_l2_l3_invalid FROM m""",
    "hierarchical_prf": V.with_(V.predictions_wide("pw"), V.TAXONOMY) + """, m3 AS (SELECT DISTINCT l3 AS c, l2 AS p FROM taxonomy),
m2 AS (SELECT DISTINCT l2 AS c, l1 AS p FROM taxonomy),
x AS (SELECT pw.pred_l3, pw.true_l3, t3.p AS t2, t2m.p AS t1, p3.p AS p2, p2m.p AS p1 FROM pw
  JOIN m3 t3 ON pw.true_l3 = t3.c JOIN m2 t2m ON t3.p = t2m.c
  LEFT JOIN m3 p3 ON pw.pred_l3 = p3.c LEFT JOIN m2 p2m ON p3.p = p2m.c),
r AS (SELECT CAST(pred_l3 = true_l3 AS INT) + coalesce(CAST(p2 = t2 AS INT), 0) + coalesce(CAST(p1 = t1 AS INT), 0) AS inter,
  1 + CAST(p2 IS NOT NULL AS INT) + CAST(p1 IS NOT NULL AS INT) AS plen FROM x),
a AS (SELECT avg(inter / plen) AS hP, avg(inter / CAST(3 AS DOUBLE)) AS hR FROM r),
b AS (SELECT *, coalesce(2 * hP * hR / nullif(hP + hR, 0), 0.0) AS hF FROM a)
SELECT round(hP, 6) AS hP, round(hR, 6) AS hR, round(hF, 6) AS hF, round(hP * 100, 2) AS hP_pct,
  round(hR * 100, 2) AS hR_pct, round(hF * 100, 2) AS hF_pct FROM b""",
    "parent_accuracy": V.with_(V.predictions_wide("pw")) + """SELECT n_eval, round(a * 100.0 / n_eval, 2) AS l2_parent_accuracy_pct,
  round(b * 100.0 / n_eval, 2) AS l3_parent_accuracy_pct, round(c * 100.0 / n_eval, 2) AS full_parent_chain_accuracy_pct FROM (
  SELECT count(*) AS n_eval, sum(CAST(pred_l1 = true_l1 AS INT)) AS a, sum(CAST(pred_l2 = true_l2 AS INT)) AS b,
  sum(CAST(pred_l1 = true_l1 AND pred_l2 = true_l2 AS INT)) AS c FROM pw)""",
}
