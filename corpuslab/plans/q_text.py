"""§2.C normalisation and formatting queries, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.functions import text as X
from corpuslab.operators import normalize as N
from corpuslab.plans import sqlviews as V
from corpuslab.plans.edge_rows import edge_df, edge_sql
from corpuslab.plans.views import history, predictions, table, tickets

# Fixed model ids the slug rule is exercised on (families of the reference).
MODEL_FAMILIES = ["UBC-NLP/MARBERTv2", "aubmindlab/bert-base-arabertv2", "local/EgyBERT-base",
                  "google/byt5-small", "org/Custom-Model"]


def texts(spark, sf_dir):
    return tickets(spark, sf_dir).select("ticket_id", "title", "description").unionByName(edge_df(spark))


def _one(fn):
    return lambda s, d: texts(s, d).select("ticket_id", fn(X.null_guard(F.col("title"))).alias("out"))


def _models(s, d):
    fam = F.array(*[F.lit(m) for m in MODEL_FAMILIES])
    p = table(s, d, "part").select("p_partkey", F.concat(
        F.element_at(fam, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("-"), F.col("p_brand")).alias("model_id"))
    slug = X.model_slug(F.col("model_id"))
    return p.select("p_partkey", "model_id", slug.alias("slug"), X.is_byte_level(F.col("model_id")).alias("byte_level"),
                    F.concat(slug, F.lit("_l1_l2_l3_best")).alias("out_name"))


def _fmt(s, d):
    g = history(s, d).groupBy("run").agg(F.avg("metric").alias("m"), F.stddev_pop("metric").alias("sd"))
    return g.select("run", X.fmt_mean_std(F.col("m"), F.col("sd")).alias("cell"))


def _round(s, d):
    acc = predictions(s, d).groupBy("task").agg(F.count(F.lit(1)).alias("n"),
                                                F.avg((F.col("pred_id") == F.col("true_id")).cast("double")).alias("acc"))
    return acc.select("task", "n", F.round("acc", 6).alias("acc_6"), F.round("acc", 4).alias("acc_4"),
                      F.round(F.col("acc") * 100.0, 2).alias("acc_pct"))


QUERIES = {
    "norm_null_guard": lambda s, d: texts(s, d).select("ticket_id", X.null_guard(F.col("description")).alias("out")),
    "norm_nfc": _one(X.nfc),
    "norm_diacritics": _one(X.strip_diacritics),
    "norm_alef": _one(X.alef),
    "norm_teh_marbuta": _one(X.teh_marbuta),
    "norm_latin_lower": _one(X.lower_latin),
    "norm_whitespace": _one(X.collapse_ws),
    "normalize_corpus": lambda s, d: N.normalize(texts(s, d), ["title", "description"]),
    "norm_impact": lambda s, d: N.normalize_impact(texts(s, d), "title"),
    "compose_text": lambda s, d: N.compose(texts(s, d)).select("ticket_id", "text"),
    "excerpt": lambda s, d: N.compose(texts(s, d)).select("ticket_id", X.excerpt(F.col("text"), 300).alias("excerpt")),
    "label_to_string": lambda s, d: table(s, d, "part").select(F.col("p_size").cast("string").alias("label")).distinct()
        .select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("label_id")),
    "model_slug": _models,
    "fmt_mean_std": _fmt,
    "round_policy": _round,
}

# ---------------------------------------------------------------- SQL twins
DIA, WS = X.DIACRITICS_CLASS, X.WHITESPACE_RUN


def s_guard(x):
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def s_nfc(x):
    return f"nfc_normalize({x})"


def s_dia(x):
    return f"regexp_replace({x}, '{DIA}', '', 'g')"


def s_alef(x):
    return f"translate({x}, '{X.ALEF_FROM}', '{X.ALEF_TO}')"


def s_teh(x):
    return f"translate({x}, '{X.TEH_FROM}', '{X.TEH_TO}')"


def s_lower(x):
    return f"translate({x}, '{X.UPPER_ASCII}', '{X.LOWER_ASCII}')"


def s_ws(x):
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def s_norm(x):
    return s_ws(s_lower(s_alef(s_dia(s_nfc(s_guard(x))))))


TX = V.with_(V.TICKETS, edge_sql(), """texts AS (SELECT ticket_id, title, description FROM tickets
  UNION ALL SELECT ticket_id, title, description FROM edges)""")
COMPOSED = "trim(coalesce(title, '') || ' ' || coalesce(description, ''))"

_s = ["s0", "s1", "s2", "s3", "s4", "s5"]
_steps = [("nfc", s_nfc), ("diacritics", s_dia), ("alef", s_alef), ("latin_lower", s_lower), ("whitespace", s_ws)]
_impact_cols = ",\n  ".join(f"CAST(sum(CASE WHEN s{i + 1} <> s{i} THEN 1 ELSE 0 END) AS BIGINT) AS changed_{n}"
                            for i, (n, _) in enumerate(_steps))
_fam = "[" + ", ".join(f"'{m}'" for m in MODEL_FAMILIES) + "]"
_base = "lower(string_split(model_id, '/')[-1])"
_slug = (f"CASE WHEN contains({_base}, 'marbert') THEN 'marbert' WHEN contains({_base}, 'arabert') THEN 'arabert' "
         f"WHEN contains({_base}, 'egybert') THEN 'egybert' WHEN contains({_base}, 'byt5') THEN 'byt5' "
         f"ELSE replace({_base}, '-', '_') END")

SQL = {
    "norm_null_guard": TX + f"SELECT ticket_id, {s_guard('description')} AS out FROM texts",
    "norm_nfc": TX + f"SELECT ticket_id, {s_nfc(s_guard('title'))} AS out FROM texts",
    "norm_diacritics": TX + f"SELECT ticket_id, {s_dia(s_guard('title'))} AS out FROM texts",
    "norm_alef": TX + f"SELECT ticket_id, {s_alef(s_guard('title'))} AS out FROM texts",
    "norm_teh_marbuta": TX + f"SELECT ticket_id, {s_teh(s_guard('title'))} AS out FROM texts",
    "norm_latin_lower": TX + f"SELECT ticket_id, {s_lower(s_guard('title'))} AS out FROM texts",
    "norm_whitespace": TX + f"SELECT ticket_id, {s_ws(s_guard('title'))} AS out FROM texts",
    "normalize_corpus": TX + f"SELECT ticket_id, {s_norm('title')} AS title, {s_norm('description')} AS description FROM texts",
    "norm_impact": TX + f""", st AS (SELECT s0, s1, s2, s3, s4, {s_ws('s4')} AS s5 FROM (
  SELECT s0, s1, s2, s3, {s_lower('s3')} AS s4 FROM (
  SELECT s0, s1, s2, {s_alef('s2')} AS s3 FROM (
  SELECT s0, s1, {s_dia('s1')} AS s2 FROM (
  SELECT s0, {s_nfc('s0')} AS s1 FROM (SELECT {s_guard('title')} AS s0 FROM texts))))))
SELECT count(*) AS n_rows, {_impact_cols},
  CAST(sum(CASE WHEN regexp_matches(s5, '{DIA}') THEN 1 ELSE 0 END) AS BIGINT) AS residual_marks FROM st""",
    "compose_text": TX + f"SELECT ticket_id, {COMPOSED} AS text FROM texts",
    "excerpt": TX + f"SELECT ticket_id, substr({COMPOSED}, 1, 300) AS excerpt FROM texts",
    "label_to_string": """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_id
FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part)""",
    "model_slug": f"""SELECT p_partkey, model_id, {_slug} AS slug, regexp_matches(model_id, '(?i)t5') AS byte_level,
  ({_slug}) || '_l1_l2_l3_best' AS out_name
FROM (SELECT p_partkey, {_fam}[CAST(p_partkey % 5 + 1 AS INTEGER)] || '-' || p_brand AS model_id FROM part)""",
    "fmt_mean_std": V.with_(V.HISTORY) + """SELECT run, CASE WHEN m IS NULL THEN '—' ELSE printf('%.2f ± %.2f', m, coalesce(sd, 0.0)) END AS cell
FROM (SELECT run, avg(metric) AS m, stddev_pop(metric) AS sd FROM history GROUP BY run)""",
    "round_policy": V.with_(V.predictions("p")) + """SELECT task, n, round(acc, 6) AS acc_6, round(acc, 4) AS acc_4,
  round(acc * 100.0, 2) AS acc_pct FROM (SELECT task, count(*) AS n, avg(CAST(pred_id = true_id AS DOUBLE)) AS acc
  FROM p GROUP BY task)""",
}
