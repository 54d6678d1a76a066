"""DuckDB twins of ``views.py`` as CTE texts for the oracle SQL."""

from __future__ import annotations

from corpuslab.functions.hashing import h32_sql

NL = "chr(10)"

TICKETS = f"""tickets AS (
  SELECT ticket_id, title, description, category_level_1, category_level_2,
         category_level_2 || '_p' || CAST(priority AS VARCHAR) AS category_level_3,
         priority, sentiment, channel, n_chars
  FROM (
    SELECT d.doc_id AS ticket_id,
      CASE WHEN strpos(d.text, {NL}) > 0 THEN substr(d.text, 1, strpos(d.text, {NL}) - 1) ELSE d.text END AS title,
      CASE WHEN strpos(d.text, {NL}) > 0 THEN substr(d.text, strpos(d.text, {NL}) + 1) END AS description,
      d.lang AS category_level_1, d.source AS category_level_2,
      CASE WHEN d.n_chars < 500 THEN 1 WHEN d.n_chars < 1000 THEN 2 WHEN d.n_chars < 2000 THEN 3
           WHEN d.n_chars < 4000 THEN 4 ELSE 5 END AS priority,
      CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS VARCHAR) || CAST(l.toxic AS VARCHAR) END AS sentiment,
      'ch' || CAST(CAST(substr(d.source, 4, 10) AS INTEGER) % 3 AS VARCHAR) AS channel,
      d.n_chars
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t0)"""

TAXONOMY = """taxonomy AS (
  SELECT CAST(r.r_regionkey AS BIGINT) AS l1, CAST(n.n_nationkey AS BIGINT) AS l2,
         CAST(s.s_suppkey AS BIGINT) AS l3
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

LINE_ID = ("concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), "
           "CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR), "
           "CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR))")

_SIZES = {"l1": "(SELECT count(*) FROM region)", "l2": "(SELECT count(*) FROM nation)",
          "l3": "(SELECT count(*) FROM supplier)"}


def predictions_wide(name: str = "pw", salt: str = "", salts: list[str] | None = None) -> str:
    multi = salts is not None
    salt_list = salts if multi else [salt]
    vals = ", ".join(f"('{x}')" for x in salt_list)
    preds = ",\n    ".join(
        f"CASE WHEN {h32_sql(f'salt || {lv!r} || id')} % 10 >= 8 "
        f"THEN {h32_sql(f'{chr(39)}alt{chr(39)} || salt || {lv!r} || id')} % {_SIZES[lv]} ELSE true_{lv} END AS pred_{lv}"
        for lv in ("l1", "l2", "l3"))
    confs = ",\n    ".join(
        f"0.5 + CAST({h32_sql(f'{chr(39)}conf{chr(39)} || salt || {lv!r} || id')} % 500 AS DOUBLE) / 1000.0 AS conf_{lv}"
        for lv in ("l1", "l2", "l3"))
    salt_out = "salt, " if multi else ""
    return f"""{name} AS (
  SELECT id, l_orderkey, l_linenumber, l_returnflag, true_l1, true_l2, true_l3, {salt_out}
    {preds},
    {confs}
  FROM (
    SELECT {LINE_ID} AS id, l.l_orderkey, l.l_linenumber, l.l_returnflag,
      CAST(n.n_regionkey AS BIGINT) AS true_l1, CAST(s.s_nationkey AS BIGINT) AS true_l2,
      CAST(l.l_suppkey AS BIGINT) AS true_l3
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey) b, (VALUES {vals}) sv(salt))"""


def predictions(name: str = "p", salt: str = "", wide: str | None = None,
                salts: list[str] | None = None) -> str:
    """Long form; defines the wide CTE too unless ``wide`` names an existing one."""
    pre = ""
    if wide is None:
        wide = name + "_w"
        pre = predictions_wide(wide, salt, salts) + ",\n"
    sc = "salt, " if salts is not None else ""
    sel = "\n  UNION ALL ".join(
        f"SELECT {sc}id, '{lv}' AS task, true_{lv} AS true_id, pred_{lv} AS pred_id, conf_{lv} AS confidence FROM {wide}"
        for lv in ("l1", "l2", "l3"))
    return pre + f"{name} AS (\n  {sel})"


SCORES = """emb_pos AS (
  SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos
  FROM embeddings),
centroids AS (
  SELECT label AS class_id, pos, avg(v) AS c FROM emb_pos WHERE vec_id % 2 = 0 GROUP BY label, pos),
scores AS (
  SELECT t.vec_id AS id, CAST(t.label AS BIGINT) AS true_id, CAST(c.class_id AS BIGINT) AS class_id,
         round(sum(t.v * c.c), 6) AS score
  FROM emb_pos t JOIN centroids c ON t.pos = c.pos
  WHERE t.vec_id % 2 = 1
  GROUP BY t.vec_id, t.label, c.class_id)"""

HISTORY = """history AS (
  SELECT user_id AS run, CAST(day(ts) AS BIGINT) AS epoch, round(avg(value), 6) AS metric
  FROM events GROUP BY user_id, day(ts))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
