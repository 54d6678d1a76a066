"""SQL twins of the confusion-cell metrics (DuckDB)."""

from __future__ import annotations


def class_stats(src: str, keys: list[str], name: str = "st", weight: str | None = None) -> str:
    """CTEs ``{name}_cells`` and ``{name}`` (per-class stats) over table ``src``."""
    k = "".join(f"{x}, " for x in keys)
    n = f"CAST(sum({weight}) AS BIGINT)" if weight else "count(*)"
    return f"""{name}_cells AS (SELECT {k}true_id, pred_id, {n} AS n FROM {src} GROUP BY ALL),
{name}_g AS (SELECT {k}label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
    CAST(sum(tp) AS BIGINT) AS tp FROM (
  SELECT {k}true_id AS label, n AS s, 0 AS p, CASE WHEN true_id = pred_id THEN n ELSE 0 END AS tp FROM {name}_cells
  UNION ALL SELECT {k}pred_id AS label, 0 AS s, n AS p, 0 AS tp FROM {name}_cells) GROUP BY ALL),
{name} AS (SELECT {k}label, support, predicted, tp,
  coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
  coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM {name}_g)"""


def metrics(src: str, keys: list[str], name: str = "m", digits: int = 6, weight: str | None = None) -> str:
    k = "".join(f"{x}, " for x in keys)
    return class_stats(src, keys, name + "_st", weight) + f""",
{name} AS (SELECT {k}CAST(sum(support) AS BIGINT) AS n, count(*) AS n_classes,
  round(sum(tp) / sum(support), {digits}) AS accuracy, round(avg(precision), {digits}) AS macro_precision,
  round(avg(recall), {digits}) AS macro_recall, round(avg(f1), {digits}) AS macro_f1
  FROM {name}_st GROUP BY ALL)"""
