"""§2.B profiling queries over the ``tickets`` view, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import WHITESPACE_RUN, compose_text, word_count
from corpuslab.operators import profile as P
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import table, taxonomy, tickets

TICKET_COLS = [("ticket_id", "bigint"), ("title", "string"), ("description", "string"),
               ("category_level_1", "string"), ("category_level_2", "string"),
               ("category_level_3", "string"), ("priority", "int"), ("sentiment", "string"),
               ("channel", "string"), ("n_chars", "bigint")]
COUNT_TASKS = ["category_level_1", "category_level_2", "priority", "sentiment", "channel"]
DECLARED = {"category_level_1": 4, "category_level_2": 20, "category_level_3": 100,
            "priority": 5, "sentiment": 4, "channel": 3, "category_level_4": 7}
WS = WHITESPACE_RUN
T = V.with_(V.TICKETS)


def sql_words(expr: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({expr}, '{WS}'), lambda w: w <> '')) AS BIGINT)"


SQL_COMPOSED = "trim(coalesce(title, '') || ' ' || coalesce(description, ''))"


def _long_sql(tasks):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS task, CAST({t} AS VARCHAR) AS label FROM tickets" for t in tasks)


QUERIES = {
    "prof_schema": lambda s, d: P.profile_schema(tickets(s, d)),
    "prof_nulls": lambda s, d: P.null_counts(tickets(s, d)),
    "prof_dup_key": lambda s, d: P.dup_count(tickets(s, d), ["ticket_id"]),
    "prof_dup_text": lambda s, d: P.dup_count(tickets(s, d), ["title", "description"]),
    "prof_sample": lambda s, d: P.seeded_sample(tickets(s, d), 5, 42, "ticket_id",
                                                ["ticket_id", "category_level_1", "priority"]),
    "class_counts": lambda s, d: P.class_counts(tickets(s, d), COUNT_TASKS),
    "class_balance": lambda s, d: P.class_balance(tickets(s, d), "category_level_1"),
    "class_size_summary": lambda s, d: P.class_size_summary(tickets(s, d), COUNT_TASKS),
    "text_lengths": lambda s, d: P.text_lengths(tickets(s, d), "ticket_id", ["title", "description"]),
    "describe_exact": lambda s, d: P.describe_exact(tickets(s, d), ["n_chars", "priority"]),
    "histogram": lambda s, d: P.histogram(tickets(s, d), "n_chars", 30),
    "dist_sorted": lambda s, d: P.class_counts(tickets(s, d), ["priority", "sentiment", "channel"])
        .withColumn("ord", F.row_number().over(
            __import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("task").orderBy("label"))),
    "crosstab": lambda s, d: P.crosstab(tickets(s, d), "category_level_1", "priority", [1, 2, 3, 4, 5], prefix="p"),
    "crosstab_rowpct": lambda s, d: P.crosstab(tickets(s, d), "category_level_1", "priority", [1, 2, 3, 4, 5],
                                               normalize="row", prefix="p"),
    "dq_out_of_taxonomy": lambda s, d: P.out_of_taxonomy(table(s, d, "events"), "user_id", taxonomy(s, d), "l3"),
    "dq_declared_classes": lambda s, d: P.declared_vs_observed(tickets(s, d), DECLARED),
    "token_budget": lambda s, d: P.token_budget(
        tickets(s, d).select(word_count(compose_text(F.col("title"), F.col("description"))).alias("n_tok")),
        "n_tok", 128),
}

_ps = ", ".join(f"('{n}', '{t}', {i + 1})" for i, (n, t) in enumerate(TICKET_COLS))
_nulls = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, CAST(sum(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM tickets"
    for n, _ in TICKET_COLS)
_pct = ", ".join(f"round(CAST(p{i} AS DOUBLE) * 100.0 / (p1 + p2 + p3 + p4 + p5), 2) AS p{i}" for i in range(1, 6))
_xt = ", ".join(f"CAST(sum(CASE WHEN priority = {i} THEN 1 ELSE 0 END) AS BIGINT) AS p{i}" for i in range(1, 6))
_dec = ", ".join(f"('{k}', {v})" for k, v in DECLARED.items())
_Q = "quantile_cont(x, [0.25, 0.5, 0.75])"

SQL = {
    "prof_schema": T + f"""SELECT c.column_name, c.dtype, c.position, n.n_rows
FROM (VALUES {_ps}) c(column_name, dtype, position), (SELECT count(*) AS n_rows FROM tickets) n""",
    "prof_nulls": T + f"SELECT * FROM ({_nulls}) WHERE n_null > 0",
    "prof_dup_key": T + """SELECT n_rows, n_distinct, n_rows - n_distinct AS n_duplicates FROM
(SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT ticket_id FROM tickets)) AS n_distinct FROM tickets)""",
    "prof_dup_text": T + """SELECT n_rows, n_distinct, n_rows - n_distinct AS n_duplicates FROM
(SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT title, description FROM tickets)) AS n_distinct FROM tickets)""",
    "prof_sample": T + """SELECT ticket_id, category_level_1, priority FROM tickets
ORDER BY md5('42' || CAST(ticket_id AS VARCHAR)) LIMIT 5""",
    "class_counts": T + f"SELECT task, label, count(*) AS n FROM ({_long_sql(COUNT_TASKS)}) WHERE label IS NOT NULL GROUP BY 1, 2",
    "class_balance": T + """, g AS (SELECT CAST(category_level_1 AS VARCHAR) AS label, count(*) AS n FROM tickets
  WHERE category_level_1 IS NOT NULL GROUP BY 1)
SELECT label, n, round(CAST(n AS DOUBLE) * 100.0 / (SELECT sum(n) FROM g), 1) AS share_pct,
       round(CAST((SELECT max(n) FROM g) AS DOUBLE) / n, 2) AS imbalance_ratio FROM g""",
    "class_size_summary": T + f""", c AS (SELECT task, label, count(*) AS n FROM ({_long_sql(COUNT_TASKS)})
  WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT task, count(*) AS n_classes, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size,
       round(CAST(max(n) AS DOUBLE) / min(n), 6) AS max_min_ratio FROM c GROUP BY task""",
    "text_lengths": T + f"""SELECT ticket_id,
  CAST(length(coalesce(title, '')) AS BIGINT) AS title_chars, {sql_words("coalesce(title, '')")} AS title_words,
  CAST(length(coalesce(description, '')) AS BIGINT) AS description_chars,
  {sql_words("coalesce(description, '')")} AS description_words FROM tickets""",
    "describe_exact": T + f"""SELECT column_name, count(*) AS count, round(avg(x), 6) AS mean,
  round(stddev_samp(x), 6) AS std, min(x) AS min, round({_Q}[1], 6) AS q25, round({_Q}[2], 6) AS q50,
  round({_Q}[3], 6) AS q75, max(x) AS max
FROM (SELECT 'n_chars' AS column_name, CAST(n_chars AS DOUBLE) AS x FROM tickets
      UNION ALL SELECT 'priority', CAST(priority AS DOUBLE) FROM tickets) WHERE x IS NOT NULL GROUP BY 1""",
    "histogram": T + """, base AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM tickets WHERE n_chars IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM base),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS BIGINT) END AS bin
      FROM base, st),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT s.bin, round(lo + s.bin * ((hi - lo) / 30), 6) AS bin_lo, round(lo + (s.bin + 1) * ((hi - lo) / 30), 6) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n, mean, median
FROM (SELECT range AS bin, lo, hi, mean, median FROM st, range(0, 30)) s LEFT JOIN c ON s.bin = c.bin""",
    "dist_sorted": T + f"""SELECT task, label, n, row_number() OVER (PARTITION BY task ORDER BY label) AS ord FROM
(SELECT task, label, count(*) AS n FROM ({_long_sql(["priority", "sentiment", "channel"])})
 WHERE label IS NOT NULL GROUP BY 1, 2)""",
    "crosstab": T + f"SELECT category_level_1, {_xt} FROM tickets GROUP BY 1",
    "crosstab_rowpct": T + f"SELECT category_level_1, {_pct} FROM (SELECT category_level_1, {_xt} FROM tickets GROUP BY 1)",
    "dq_out_of_taxonomy": V.with_(V.TAXONOMY) + """SELECT 'l3' AS level, user_id AS label, count(*) AS n_rows
FROM events e WHERE NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.l3 = e.user_id) GROUP BY user_id""",
    "dq_declared_classes": T + f""", obs AS (SELECT task, count(DISTINCT label) AS observed FROM
  ({_long_sql([k for k in DECLARED if k != "category_level_4"])}) WHERE label IS NOT NULL GROUP BY task),
dec AS (SELECT task, CAST(declared AS BIGINT) AS declared FROM (VALUES {_dec}) v(task, declared))
SELECT coalesce(dec.task, obs.task) AS task, declared, observed, coalesce(declared = observed, false) AS matches
FROM dec FULL OUTER JOIN obs ON dec.task = obs.task""",
    "token_budget": T + f""", tk AS (SELECT CAST({sql_words(SQL_COMPOSED)} AS DOUBLE) AS x FROM tickets)
SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
  round({_Q}[1], 6) AS q25, round({_Q}[2], 6) AS q50, round({_Q}[3], 6) AS q75, max(x) AS max,
  round(avg(CAST(x <= 128 AS DOUBLE)) * 100.0, 2) AS pct_within FROM tk""",
}
