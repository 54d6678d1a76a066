"""Paired significance tests, bootstrap intervals and density grids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.metrics import class_stats, confusion


def _half_beta(n: float, k: float) -> float:
    """min(1, 2 P(X <= k)) of a fair binomial: the incomplete beta function
    I_1/2(n - k, k + 1) by its continued fraction."""
    if n <= 0 or 2 * k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1_000_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return min(1.0, 2 * front * out)


def binom_two_sided_p(k: Column, n: Column) -> Column:
    """Exact two-sided binomial p for k = min(b, c) of n trials at p = 0.5. The
    work grows with the root of n at most, and the call is made on the one row
    of the 2x2 table."""
    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_half_beta(float(y), float(x)) for x, y in zip(k, n)])
    return p(k.cast("double"), n.cast("double"))


def mcnemar(pa: DataFrame, pb: DataFrame, keys: Sequence[str] = ("id",), alpha: float = 0.05) -> DataFrame:
    """2×2 correct/wrong table of two models on the same rows (inner join on
    the row key) and the exact McNemar p."""
    a = pa.select(*keys, (F.col("pred_id") == F.col("true_id")).alias("a_ok"))
    b = pb.select(*keys, (F.col("pred_id") == F.col("true_id")).alias("b_ok"))
    j = a.join(b, list(keys))
    t = j.agg(F.count(F.lit(1)).alias("n"),
              F.sum((F.col("a_ok") & F.col("b_ok")).cast("bigint")).alias("both_correct"),
              F.sum((F.col("a_ok") & ~F.col("b_ok")).cast("bigint")).alias("a_only"),
              F.sum((~F.col("a_ok") & F.col("b_ok")).cast("bigint")).alias("b_only"),
              F.sum((~F.col("a_ok") & ~F.col("b_ok")).cast("bigint")).alias("both_wrong"))
    p = binom_two_sided_p(F.least("a_only", "b_only"), F.col("a_only") + F.col("b_only"))
    return t.withColumn("p_value", F.round(p, 6)).withColumn("significant", F.col("p_value") < alpha)


#: Cells drawn at once.
DRAWN = 500


def replicate_cells(cells: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Poisson bootstrap on counts: each (cell, replicate) draws Poisson(n), the
    sum of n Poisson(1) row weights, from a generator seeded by (seed, cell); the
    work does not depend on n. One draw for a joint cell serves all models.
    Rows: keys, rep, w."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema) + ", rep int, w bigint"

    def weights(key, n):
        digest = hashlib.md5(repr((seed, [str(x) for x in key])).encode()).digest()
        return np.random.Generator(np.random.Philox(int.from_bytes(digest, "little"))).poisson(n, reps)

    def draw(batches):
        for whole in batches:
            for at in range(0, len(whole), DRAWN):  # a matrix of cells x replicates at a time
                b = whole.iloc[at:at + DRAWN]
                w = np.stack([weights(key, n) for *key, n in zip(*[b[c] for c in [*keys, "n"]])])
                cell, rep = np.nonzero(w)
                yield pd.DataFrame({**{k: b[k].to_numpy()[cell] for k in keys}, "rep": (rep + 1).astype("int32"), "w": w[cell, rep].astype("int64")})
    return cells.select(*keys, "n").mapInPandas(draw, schema)


def replicate_f1(P: DataFrame, model: str, reps: int, seed: int, id_col: str = "id") -> DataFrame:
    """(model, rep, macro_f1). Rows are aggregated once to joint cells (true
    label, every model's prediction), so all models see the same resample."""
    joint = P.groupBy(id_col, "true_id").agg(F.sort_array(F.collect_list(F.struct(F.col(model), "pred_id"))).alias("preds"))
    cells = joint.groupBy("true_id", F.to_json("preds").alias("preds")).agg(F.count(F.lit(1)).alias("n"))
    each = F.from_json("preds", P.select(F.array(F.struct(F.col(model), "pred_id"))).schema[0].dataType)
    x = replicate_cells(cells, ["true_id", "preds"], reps, seed).withColumn("_e", F.explode(each)) \
        .select(F.col(f"_e.{model}").alias(model), "rep", "true_id", F.col("_e.pred_id").alias("pred_id"), "w")
    st = class_stats(confusion(x, [model, "rep"], weight="w"), [model, "rep"])
    return st.groupBy(model, "rep").agg(F.avg("f1").alias("macro_f1"))


def bootstrap_f1(P: DataFrame, model: str, reps: int = 1000, seed: int = 7, id_col: str = "id",
                 probs: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Mean and interval of macro-F1 per model over the replicates."""
    f1 = replicate_f1(P, model, reps, seed, id_col)
    q = F.percentile("macro_f1", F.array(*[F.lit(p) for p in probs]))
    return f1.groupBy(model).agg(F.count(F.lit(1)).alias("reps"), F.round(F.avg("macro_f1"), 6).alias("mean"),
                                 q.alias("_q")) \
        .select(model, "reps", "mean", F.round(F.col("_q")[0], 6).alias("ci_low"),
                F.round(F.col("_q")[1], 6).alias("ci_high"))


def kde(samples: DataFrame, by: str, col: str, grid: int = 50) -> DataFrame:
    """Gaussian KDE on an equal grid between min and max, Scott bandwidth
    n^(-1/5)·std. The samples of one group (bootstrap replicates: their count
    is a parameter, not data size) are gathered into one array."""
    g = samples.groupBy(by).agg(F.collect_list(F.col(col).cast("double")).alias("xs"),
                                F.min(col).alias("lo"), F.max(col).alias("hi"),
                                F.stddev_samp(col).alias("sd"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("bw", F.pow(F.col("n").cast("double"), -0.2) * F.col("sd"))
    pts = g.select(by, "xs", "n", "bw", "lo", "hi",
                   F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gi") / (grid - 1)
    dens = F.aggregate("xs", F.lit(0.0), lambda acc, v: acc + F.exp(-0.5 * F.pow((x - v) / F.col("bw"), 2))) \
        / (F.col("n") * F.col("bw") * F.lit(2.5066282746310002))
    return pts.select(by, F.col("gi").cast("bigint").alias("gi"), F.round(x, 6).alias("x"), F.round(dens, 6).alias("density"))
