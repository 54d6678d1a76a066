"""The corpus normalisation job: every step fused into one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X


def normalize(df: DataFrame, cols: Sequence[str], params: X.NormalizeParams = X.NormalizeParams(),
              suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) normalised versions of ``cols``."""
    out = df
    for c in cols:
        out = out.withColumn(c + suffix, X.normalize_text(F.col(c), params))
    return out


def compose(df: DataFrame, title: str = "title", description: str = "description",
            text: str = "text") -> DataFrame:
    """``text`` = trim(title || ' ' || description) unless a ``text`` column exists."""
    if text in df.columns:
        return df.withColumn(text, X.null_guard(F.col(text)))
    return df.withColumn(text, X.compose_text(F.col(title), F.col(description)))


def normalize_impact(df: DataFrame, col: str, params: X.NormalizeParams = X.NormalizeParams()) -> DataFrame:
    """Rows changed by each step of the chain (one aggregate pass) and rows
    that still carry diacritics afterwards."""
    steps: list[tuple[str, callable]] = [("nfc", X.nfc), ("diacritics", X.strip_diacritics),
                                         ("alef", X.alef)]
    if params.normalize_teh_marbuta:
        steps.append(("teh_marbuta", X.teh_marbuta))
    steps += [("latin_lower", X.lower_latin), ("whitespace", X.collapse_ws)]
    cur: Column = X.null_guard(F.col(col))
    stages = {"s0": cur}
    proj = [cur.alias("s0")]
    for i, (_, fn) in enumerate(steps):
        proj.append(fn(F.col(f"s{i}")).alias(f"s{i + 1}"))
    # materialise each stage once (chained projections keep one codegen stage)
    x = df.select(proj[0])
    for i in range(len(steps)):
        x = x.withColumn(f"s{i + 1}", proj[i + 1])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (name, _) in enumerate(steps):
        aggs.append(F.sum((F.col(f"s{i + 1}") != F.col(f"s{i}")).cast("bigint")).alias(f"changed_{name}"))
    last = f"s{len(steps)}"
    aggs.append(F.sum(F.col(last).rlike(X.DIACRITICS_CLASS).cast("bigint")).alias("residual_marks"))
    del stages
    return x.agg(*aggs)
