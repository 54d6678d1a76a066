"""§2.G ranking / windows, §2.I vectors and statistics: queries + SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.hashing import h32_sql
from corpuslab.operators import metrics as M
from corpuslab.operators import ranking as R
from corpuslab.operators import relate as RL
from corpuslab.operators import stats as S
from corpuslab.operators import vectors as VEC
from corpuslab.plans import q_relate as QR
from corpuslab.plans import sqlmetrics as SM
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import history, predictions, scores, table, tickets

TOPK = (3, 5)


def _ranked_with_parent(s, d):
    sc = scores(s, d)
    rk = VEC.true_rank(sc)
    pp = VEC.softmax(sc).groupBy("id", VEC.parent_of(F.col("class_id")).alias("parent")).agg(F.sum("p").alias("pp"))
    ppred = pp.groupBy("id").agg(F.max_by("parent", F.struct(F.col("pp"), -F.col("parent"))).alias("pred_parent"))
    return rk.join(ppred, "id").withColumn("parent_ok", F.col("pred_parent") == VEC.parent_of(F.col("true_id")))


def _topk(cols):
    return lambda s, d: R.topk_metrics(_ranked_with_parent(s, d), TOPK, "parent_ok").select(*cols)


_g = ["n_eval"] + [f"global_top_{k}_{x}" for k in TOPK for x in ("count", "rate", "pct")]
_pc = ["n_eval", "n_parent_correct"] + [f"top_{k}_with_correct_parent_{x}" for k in TOPK for x in ("count", "rate", "pct")]
_gp = ["n_parent_correct"] + [f"top_{k}_given_parent_correct_{x}" for k in TOPK for x in ("rate", "pct")]


def _weights(s, d):
    """Nearest-centroid heads from even vec_ids: W = centroids, b = -|c|²/2."""
    e = table(s, d, "embeddings").filter(F.col("vec_id") % 2 == 0)
    pe = e.select(F.explode(F.array(F.struct(F.lit("label").alias("task"), F.col("label").cast("bigint").alias("class_id")),
                                    F.struct(F.lit("parent").alias("task"), F.floor(F.col("label") / 2).cast("bigint").alias("class_id"))))
                  .alias("t"), "embedding").select("t.*", F.posexplode("embedding").alias("pos", "v"))
    c = pe.groupBy("task", "class_id", "pos").agg(F.avg("v").alias("c"))
    vecs = c.groupBy("task", "class_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("cs")) \
        .select("task", "class_id", F.transform("cs", lambda x: x["c"]).alias("w"))
    vecs = vecs.withColumn("b", -0.5 * F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    return vecs.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("class_id", "w", "b"))).alias("rows")) \
        .select("task", F.transform("rows", lambda r: r["w"]).alias("W"), F.transform("rows", lambda r: r["b"]).alias("b"))


def _logits(s, d):
    odd = table(s, d, "embeddings").filter(F.col("vec_id") % 2 == 1) \
        .select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return VEC.score_heads(odd, _weights(s, d), ["label", "parent"])


def _linear_heads(s, d):
    return _logits(s, d).select("id", "task", F.posexplode("logits").alias("class_id", "logit")) \
        .select("id", "task", F.col("class_id").cast("bigint"), F.round("logit", 6).alias("logit"))


def _nested(s, d):
    p = VEC.to_predictions(_logits(s, d))
    return p.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "task", F.struct(F.col("pred_id").alias("label"), F.col("confidence").alias("confidence"))))))).alias("predictions"))


def _pair(s, d):
    return tuple(predictions(s, d, salts=[x]).filter("task = 'l1'") for x in ("42", "123"))


REPLICATES = 1000


def _boot(s, d):
    p = predictions(s, d, salts=["42", "123"]).filter("task = 'l1'")
    return S.bootstrap_f1(p, "salt", REPLICATES, 7)


def _kde(s, d):
    p = predictions(s, d, salts=["42", "123"]).filter("task = 'l1'")
    return S.kde(S.replicate_f1(p, "salt", REPLICATES, 7), "salt", "macro_f1", 50)


QUERIES = {
    "argmax_class": lambda s, d: VEC.argmax_class(scores(s, d)),
    "topk_global": _topk(_g),
    "topk_parent_correct": _topk(_pc),
    "topk_given_parent": _topk(_gp),
    "top_conf_errors": lambda s, d: R.top_errors(predictions(s, d), 10, ["id", "task", "true_id", "pred_id", "confidence"]),
    "sample_errors": lambda s, d: RL.decode(R.sample_errors(predictions(s, d), 8, 42), QR.names(s, d))
        .select("task", "rank", "id", "true_id", "true_name", "pred_id", "pred_name"),
    "best_model": lambda s, d: M.classification_metrics(predictions(s, d, salts=["", "42", "123", "456"])
                                                        .filter("task = 'l1'"), ["salt"])
        .agg(F.max_by(F.concat(F.lit("model_"), F.col("salt")), "macro_f1").alias("best_model"),
             F.max("macro_f1").alias("macro_f1")),
    "stratified_split": lambda s, d: R.stratified_split(tickets(s, d).select("ticket_id", "category_level_1"),
                                                        "ticket_id", "category_level_1", 42),
    "best_checkpoint": lambda s, d: R.best_epoch(history(s, d)),
    "early_stop": lambda s, d: R.early_stop(history(s, d), 2),
    "running_loss": lambda s, d: R.running_mean(table(s, d, "events").select("event_id", "user_id", "ts", "value"),
                                                ["user_id"], ["ts", "event_id"], "value", F.date_trunc("day", F.col("ts")))
        .select("event_id", "user_id", F.round("running_mean", 6).alias("running_mean")),
    "batch_assign": lambda s, d: R.assign_batches(tickets(s, d).select("ticket_id"), ["ticket_id"], 64,
                                                  F.floor(F.col("ticket_id") / 1024)),
    "pool_mean": lambda s, d: VEC.mean_pool(table(s, d, "embeddings").withColumn("mask", (F.col("vec_id") % 4 != 0).cast("int")),
                                            ["label"], "embedding", "mask"),
    "pool_first": lambda s, d: VEC.first_pool(table(s, d, "embeddings"), ["label"], "embedding", "vec_id"),
    "linear_heads": _linear_heads,
    "softmax_conf": lambda s, d: VEC.to_predictions(_logits(s, d)),
    "predict_nested": _nested,
    "mcnemar": lambda s, d: S.mcnemar(*_pair(s, d)),
    "bootstrap_ci": _boot,
    "kde_grid": _kde,
}

# ---------------------------------------------------------------- SQL twins
SMX = """sm AS (SELECT id, true_id, class_id, score, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM scores),
pr AS (SELECT id, true_id, class_id, score, e / sum(e) OVER (PARTITION BY id) AS p FROM sm)"""
RANKED = V.with_(V.SCORES, SMX, """rk AS (SELECT id, true_id, rn AS true_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class_id DESC) AS rn FROM scores) WHERE class_id = true_id),
pp AS (SELECT id, class_id // 2 AS parent, sum(p) AS pp FROM pr GROUP BY ALL),
ppred AS (SELECT id, parent AS pred_parent FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pp DESC, parent ASC) AS rn FROM pp) WHERE rn = 1),
r AS (SELECT rk.*, ppred.pred_parent = rk.true_id // 2 AS parent_ok FROM rk JOIN ppred USING (id)),
agg AS (SELECT count(*) AS n_eval, CAST(sum(CAST(parent_ok AS INT)) AS BIGINT) AS n_parent_correct,""" + ",".join(
    f"""
  CAST(sum(CAST(true_rank <= {k} AS INT)) AS BIGINT) AS global_top_{k}_count,
  CAST(sum(CAST(true_rank <= {k} AND parent_ok AS INT)) AS BIGINT) AS top_{k}_with_correct_parent_count""" for k in TOPK)
    + " FROM r)")


def _rate(c, d, digits, pct=False):
    num = f"{c} * 100.0" if pct else c
    return f"round(coalesce({num} / nullif({d}, 0), 0.0), {digits})"


_gsql = ", ".join(["n_eval"] + [x for k in TOPK for x in (
    f"global_top_{k}_count", _rate(f"global_top_{k}_count", "n_eval", 6) + f" AS global_top_{k}_rate",
    _rate(f"global_top_{k}_count", "n_eval", 2, True) + f" AS global_top_{k}_pct")])
_pcsql = ", ".join(["n_eval", "n_parent_correct"] + [x for k in TOPK for x in (
    f"top_{k}_with_correct_parent_count",
    _rate(f"top_{k}_with_correct_parent_count", "n_eval", 6) + f" AS top_{k}_with_correct_parent_rate",
    _rate(f"top_{k}_with_correct_parent_count", "n_eval", 2, True) + f" AS top_{k}_with_correct_parent_pct")])
_gpsql = ", ".join(["n_parent_correct"] + [x for k in TOPK for x in (
    _rate(f"top_{k}_with_correct_parent_count", "n_parent_correct", 6) + f" AS top_{k}_given_parent_correct_rate",
    _rate(f"top_{k}_with_correct_parent_count", "n_parent_correct", 2, True) + f" AS top_{k}_given_parent_correct_pct")])

SPLIT_SQL = f"""sp_x AS (SELECT ticket_id, category_level_1 AS label, {h32_sql("'42|' || CAST(ticket_id AS VARCHAR)")} AS key FROM tickets),
sp_c AS (SELECT label, count(*) AS n FROM sp_x GROUP BY label),
sp_t AS (SELECT sum(n) AS tot, CAST(ceil(sum(n) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS n_temp FROM sp_c),
sp_q1 AS (SELECT sp_c.label, sp_c.n, sp_t.n_temp, (sp_c.n * sp_t.n_temp) // sp_t.tot AS base, (sp_c.n * sp_t.n_temp) % sp_t.tot AS rem FROM sp_c, sp_t),
sp_q1b AS (SELECT *, n_temp - sum(base) OVER () AS left_, row_number() OVER (ORDER BY rem DESC, label) AS ord FROM sp_q1),
sp_q1c AS (SELECT label, n, n_temp, base + CASE WHEN ord <= left_ THEN 1 ELSE 0 END AS tmp,
  CAST(ceil(n_temp * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n_test FROM sp_q1b),
sp_q2 AS (SELECT *, (tmp * n_test) // n_temp AS base, (tmp * n_test) % n_temp AS rem FROM sp_q1c),
sp_q2b AS (SELECT *, n_test - sum(base) OVER () AS left_, row_number() OVER (ORDER BY rem DESC, label) AS ord FROM sp_q2),
sp_q AS (SELECT label, n - tmp AS tr, tmp - (base + CASE WHEN ord <= left_ THEN 1 ELSE 0 END) AS va FROM sp_q2b),
sp_rr AS (SELECT sp_x.*, row_number() OVER (PARTITION BY label ORDER BY key, ticket_id) AS r FROM sp_x),
splits AS (SELECT sp_rr.ticket_id, sp_rr.label AS category_level_1,
  CASE WHEN sp_rr.r <= sp_q.tr THEN 'train' WHEN sp_rr.r <= sp_q.tr + sp_q.va THEN 'val' ELSE 'test' END AS split
  FROM sp_rr JOIN sp_q USING (label))"""

FLAGS = """fl AS (SELECT *, metric > greatest(coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved FROM history)"""

WEIGHTS = """ev AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings),
cen AS (SELECT task, class_id, pos, avg(v) AS c FROM (
  SELECT 'label' AS task, CAST(label AS BIGINT) AS class_id, pos, v FROM ev WHERE vec_id % 2 = 0
  UNION ALL SELECT 'parent', CAST(label // 2 AS BIGINT), pos, v FROM ev WHERE vec_id % 2 = 0) GROUP BY ALL),
bias AS (SELECT task, class_id, -0.5 * sum(c * c) AS b FROM cen GROUP BY ALL),
lg AS (SELECT t.vec_id AS id, c.task, c.class_id, sum(t.v * c.c) + any_value(b.b) AS logit
  FROM ev t JOIN cen c ON t.pos = c.pos JOIN bias b ON b.task = c.task AND b.class_id = c.class_id
  WHERE t.vec_id % 2 = 1 GROUP BY ALL),
sp AS (SELECT id, task, class_id, logit, max(logit) OVER (PARTITION BY id, task) AS mx FROM lg),
pred AS (SELECT id, task, CAST(arg_min(class_id, CASE WHEN logit = mx THEN class_id ELSE 1e9 END) AS BIGINT) AS pred_id,
  round(1.0 / sum(exp(logit - mx)), 4) AS confidence FROM sp GROUP BY id, task)"""

PAIR = V.with_(V.predictions("p", salts=["42", "123"]), "pl AS (SELECT * FROM p WHERE task = 'l1')")

SQL = {
    "argmax_class": V.with_(V.SCORES) + """SELECT id, true_id, class_id AS pred_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class_id ASC) AS rn FROM scores) WHERE rn = 1""",
    "topk_global": RANKED + f"SELECT {_gsql} FROM agg",
    "topk_parent_correct": RANKED + f"SELECT {_pcsql} FROM agg",
    "topk_given_parent": RANKED + f"SELECT {_gpsql} FROM agg",
    "top_conf_errors": V.with_(V.predictions("p")) + """SELECT id, task, true_id, pred_id, confidence FROM p
WHERE pred_id <> true_id ORDER BY confidence DESC, id, task LIMIT 10""",
    "sample_errors": V.with_(V.predictions("p")) + QR.NAMES + """SELECT e.task, rank, id, true_id, a.name AS true_name, pred_id, b.name AS pred_name FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42' || id), id) AS rank FROM p WHERE pred_id <> true_id) e
LEFT JOIN names a ON a.task = e.task AND a.label_id = true_id LEFT JOIN names b ON b.task = e.task AND b.label_id = pred_id
WHERE rank <= 8""",
    "best_model": V.with_(V.predictions("p", salts=["", "42", "123", "456"]), "pl AS (SELECT * FROM p WHERE task = 'l1')",
                          SM.metrics("pl", ["salt"])) + "SELECT arg_max('model_' || salt, macro_f1) AS best_model, max(macro_f1) AS macro_f1 FROM m",
    "stratified_split": V.with_(V.TICKETS, SPLIT_SQL) + "SELECT * FROM splits",
    "best_checkpoint": V.with_(V.HISTORY, FLAGS) + """SELECT run, max(CASE WHEN improved THEN epoch END) AS best_epoch,
  arg_max(metric, CASE WHEN improved THEN epoch END) AS best_metric, CAST(sum(CAST(improved AS INT)) AS BIGINT) AS n_saves
FROM fl GROUP BY run""",
    "early_stop": V.with_(V.HISTORY, FLAGS) + """, g AS (SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM fl),
s AS (SELECT run, epoch, metric, improved, CAST(CASE WHEN grp = 0 THEN rn ELSE rn - 1 END AS BIGINT) AS since FROM (
  SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) AS rn FROM g)),
st AS (SELECT *, min(CASE WHEN since >= 2 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM s)
SELECT run, epoch, metric, improved, since, stop_epoch, stop_epoch IS NULL OR epoch <= stop_epoch AS ran FROM st""",
    "running_loss": """SELECT event_id, user_id, round(CAST(sum(CAST(value AS DECIMAL(38, 15))) OVER w AS DOUBLE)
  / count(value) OVER w, 6) AS running_mean FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "batch_assign": V.with_(V.TICKETS) + """SELECT ticket_id, batch, CAST(least(64, n - batch * 64) AS BIGINT) AS batch_size FROM (
  SELECT ticket_id, CAST((row_number() OVER (ORDER BY ticket_id) - 1) // 64 AS BIGINT) AS batch, count(*) OVER () AS n FROM tickets)""",
    "pool_mean": """SELECT label, pos, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS value FROM (
  SELECT label, CAST(CAST(vec_id % 4 <> 0 AS INT) AS DOUBLE) AS m, unnest(embedding) AS v,
    unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings) GROUP BY ALL""",
    "pool_first": """SELECT label, pos, round(CAST(v AS DOUBLE), 6) AS value FROM (
  SELECT label, unnest(emb) AS v, unnest(generate_series(0, len(emb) - 1)) AS pos FROM (
  SELECT label, arg_min(embedding, vec_id) AS emb FROM embeddings GROUP BY label))""",
    "linear_heads": V.with_(WEIGHTS) + "SELECT id, task, class_id, round(logit, 6) AS logit FROM lg",
    "softmax_conf": V.with_(WEIGHTS) + "SELECT id, task, pred_id, confidence FROM pred",
    "predict_nested": V.with_(WEIGHTS) + """SELECT id, CAST(to_json(map_from_entries(list_sort(list((task,
  {'label': pred_id, 'confidence': confidence}))))) AS VARCHAR) AS predictions FROM pred GROUP BY id""",
    "mcnemar": PAIR + """, j AS (SELECT a.pred_id = a.true_id AS a_ok, b.pred_id = b.true_id AS b_ok
  FROM (SELECT * FROM pl WHERE salt = '42') a JOIN (SELECT * FROM pl WHERE salt = '123') b ON a.id = b.id),
t AS (SELECT count(*) AS n, CAST(sum(CAST(a_ok AND b_ok AS INT)) AS BIGINT) AS both_correct,
  CAST(sum(CAST(a_ok AND NOT b_ok AS INT)) AS BIGINT) AS a_only, CAST(sum(CAST(NOT a_ok AND b_ok AS INT)) AS BIGINT) AS b_only,
  CAST(sum(CAST(NOT a_ok AND NOT b_ok AS INT)) AS BIGINT) AS both_wrong FROM j),
pv AS (SELECT *, a_only + b_only AS m, least(a_only, b_only) AS k FROM t)
SELECT n, both_correct, a_only, b_only, both_wrong,
  round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + m * ln(0.5))))) END, 6) AS p_value,
  round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + m * ln(0.5))))) END, 6) < 0.05 AS significant FROM pv""",
}
