"""Ranking, top-k, splits and run-history windows.

Large ordered windows are never run over one huge partition: ranks inside a
group are computed per (group, bucket) where ``bucket`` is a monotone
function of the order key, then shifted by the sizes of the earlier buckets
(a tiny prefix-sum table). A group holding a third of all rows is thus
ranked by many tasks in parallel with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.functions.hashing import h32


def bucketed_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column,
                  name: str = "rank") -> DataFrame:
    """1-based rank inside ``group`` by ``order`` (must be unique in a group);
    ``bucket`` must be non-decreasing in ``order``."""
    x = df.withColumn("_b", bucket)
    local = x.withColumn("_lr", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    sizes = x.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    pre = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(
        Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return _null_safe_join(local, pre.select(*group, "_b", "_off"), [*group, "_b"]) \
        .withColumn(name, F.col("_off") + F.col("_lr")).drop("_b", "_lr", "_off")


def _null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null."""
    o = other.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in other.columns])
    on = F.lit(True)
    for c in keys:
        on = on & df[c].eqNullSafe(o[f"_j_{c}"])
    return df.join(o, on).drop(*[f"_j_{c}" for c in keys])


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    spread: Column, buckets: int = 64, name: str = "rank") -> DataFrame:
    """Exact top-k per group in two rounds: top-k per (group, spread bucket),
    then top-k of those survivors per group (≤ k·buckets rows each)."""
    x = df.withColumn("_s", F.pmod(spread, F.lit(buckets)))
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_s").orderBy(*order))) \
        .filter(F.col("_r") <= k).drop("_r", "_s")
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))) \
        .filter(F.col(name) <= k)


def topk_metrics(ranked: DataFrame, ks: Sequence[int] = (3, 5), parent_ok: str | None = None) -> DataFrame:
    """Hit counts, rates (6 dp) and % (2 dp) for each k from (true_rank[, parent_ok])."""
    aggs = [F.count(F.lit(1)).alias("n_eval")]
    if parent_ok:
        aggs.append(F.sum(F.col(parent_ok).cast("bigint")).alias("n_parent_correct"))
    for k in ks:
        hit = F.col("true_rank") <= k
        aggs.append(F.sum(hit.cast("bigint")).alias(f"global_top_{k}_count"))
        if parent_ok:
            aggs.append(F.sum((hit & F.col(parent_ok)).cast("bigint")).alias(f"top_{k}_with_correct_parent_count"))
    out = ranked.agg(*aggs)
    cols = [F.col("n_eval")] + ([F.col("n_parent_correct")] if parent_ok else [])
    for k in ks:
        g = F.col(f"global_top_{k}_count")
        cols += [g, F.round(F.coalesce(F.try_divide(g, F.col("n_eval")), F.lit(0.0)), 6).alias(f"global_top_{k}_rate"),
                 F.round(F.coalesce(F.try_divide(g * 100.0, F.col("n_eval")), F.lit(0.0)), 2).alias(f"global_top_{k}_pct")]
        if parent_ok:
            c = F.col(f"top_{k}_with_correct_parent_count")
            cols += [c, F.round(F.coalesce(F.try_divide(c, F.col("n_eval")), F.lit(0.0)), 6).alias(f"top_{k}_with_correct_parent_rate"),
                     F.round(F.coalesce(F.try_divide(c * 100.0, F.col("n_eval")), F.lit(0.0)), 2).alias(f"top_{k}_with_correct_parent_pct"),
                     F.round(F.coalesce(F.try_divide(c, F.col("n_parent_correct")), F.lit(0.0)), 6).alias(f"top_{k}_given_parent_correct_rate"),
                     F.round(F.coalesce(F.try_divide(c * 100.0, F.col("n_parent_correct")), F.lit(0.0)), 2).alias(f"top_{k}_given_parent_correct_pct")]
    return out.select(*cols)


def top_errors(P: DataFrame, n: int, cols: Sequence[str]) -> DataFrame:
    """The n wrong predictions with the highest confidence (TakeOrdered)."""
    return P.filter(F.col("pred_id") != F.col("true_id")) \
        .orderBy(F.col("confidence").desc(), F.col("id"), F.col("task")).limit(n).select(*cols)


def sample_errors(P: DataFrame, n: int, seed: int, group: str = "task") -> DataFrame:
    """n seeded errors per group ordered by md5(seed || id)."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col("id").cast("string")))
    e = P.filter(F.col("pred_id") != F.col("true_id")).withColumn("_k", key)
    return top_k_per_group(e, [group], [F.col("_k"), F.col("id")], n, spread=h32(F.col("id"))).drop("_k")


def _largest_remainder(counts: DataFrame, label: str, n_col: str, total_draw: Column, total_n: Column,
                       out: str) -> DataFrame:
    """Allocate ``total_draw`` over classes proportionally to ``n_col``:
    floors first, the remainder to the largest fractional parts (ties by label)."""
    num = F.col(n_col) * total_draw
    c = counts.withColumn("_base", F.floor(num / total_n).cast("bigint")) \
        .withColumn("_rem", F.pmod(num, total_n))
    w_all = Window.partitionBy()
    c = c.withColumn("_left", total_draw - F.sum("_base").over(w_all))
    c = c.withColumn("_ord", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label))))
    return c.withColumn(out, F.col("_base") + F.when(F.col("_ord") <= F.col("_left"), 1).otherwise(0)) \
        .drop("_base", "_rem", "_left", "_ord")


def stratified_split(df: DataFrame, id_col: str, label: str, seed: int = 42,
                     temp_fraction: float = 0.30, test_fraction_of_temp: float = 0.50,
                     buckets_bits: int = 8) -> DataFrame:
    """Exact stratified train/val/test: temp = ceil(n·temp_fraction),
    test = ceil(temp·test_fraction_of_temp); per-class quotas by largest
    remainder; rows ranked in their class by md5(seed‖id)."""
    key = h32(F.lit(f"{seed}|"), F.col(id_col))
    x = df.withColumn("_key", key)
    counts = x.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    tot = counts.select(F.sum("_n")).scalar()
    n_temp = F.ceil(tot * F.lit(temp_fraction)).cast("bigint")
    q = _largest_remainder(counts, label, "_n", n_temp, tot, "_temp")
    n_test = F.ceil(n_temp * F.lit(test_fraction_of_temp)).cast("bigint")
    q = _largest_remainder(q, label, "_temp", n_test, n_temp, "_test")
    q = q.select(label, (F.col("_n") - F.col("_temp")).alias("_train"), (F.col("_temp") - F.col("_test")).alias("_val"))
    shift = 32 - buckets_bits
    r = bucketed_rank(x, [label], [F.col("_key"), F.col(id_col)], F.shiftright(F.col("_key"), shift), "_r")
    r = _null_safe_join(r, q, [label])
    split = F.when(F.col("_r") <= F.col("_train"), "train") \
        .when(F.col("_r") <= F.col("_train") + F.col("_val"), "val").otherwise("test")
    return r.withColumn("split", split).drop("_key", "_r", "_train", "_val")


def improvement_flags(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric",
                      initial: float = 0.0) -> DataFrame:
    """``improved`` = metric strictly above every earlier value and ``initial``."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.coalesce(F.max(metric).over(w), F.lit(initial)), F.lit(initial))
    return history.withColumn("improved", F.col(metric) > prev)


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    f = improvement_flags(history, run, epoch, metric)
    return f.groupBy(run).agg(F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
                              F.max_by(metric, F.when(F.col("improved"), F.col(epoch))).alias("best_metric"),
                              F.sum(F.col("improved").cast("bigint")).alias("n_saves"))


def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch",
               metric: str = "metric") -> DataFrame:
    """Per epoch: improved, epochs since the last improvement, and whether
    the epoch ran (training stops once ``since`` reaches ``patience``)."""
    f = improvement_flags(history, run, epoch, metric)
    w = Window.partitionBy(run).orderBy(epoch)
    f = f.withColumn("_grp", F.sum(F.col("improved").cast("bigint")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    rn = F.row_number().over(Window.partitionBy(run, "_grp").orderBy(epoch))
    f = f.withColumn("since", F.when(F.col("_grp") == 0, rn).otherwise(rn - 1).cast("bigint"))
    stop = F.min(F.when(F.col("since") >= patience, F.col(epoch))).over(Window.partitionBy(run))
    return f.withColumn("stop_epoch", stop) \
        .withColumn("ran", F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch"))).drop("_grp")


def running_mean(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, bucket: Column,
                 name: str = "running_mean", scale: int = 15) -> DataFrame:
    """Mean of the non-null ``value``s from the start of the partition to the
    current row (null before the first). ``bucket`` must be non-decreasing in
    ``order``. Local running sums per (part, bucket) plus prefix totals of earlier
    buckets, so a hot partition is spread over its buckets. Sums are decimals
    with ``scale`` digits after the point, so the result does not depend on how
    the rows were split."""
    x = df.withColumn("_b", bucket).withColumn("_v", F.col(value).cast(f"decimal(38,{scale})"))
    wl = Window.partitionBy(*part, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loc = x.withColumn("_s", F.sum("_v").over(wl)).withColumn("_c", F.count("_v").over(wl))
    tot = x.groupBy(*part, "_b").agg(F.sum("_v").alias("_bs"), F.count("_v").alias("_bc"))
    wp = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(*part, "_b", F.coalesce(F.sum("_bs").over(wp), F.lit(0)).alias("_ps"),
                     F.coalesce(F.sum("_bc").over(wp), F.lit(0)).alias("_pc"))
    total = (F.col("_ps") + F.coalesce("_s", F.lit(0))).cast("double")
    return _null_safe_join(loc, pre, [*part, "_b"]).withColumn(name, F.try_divide(total, F.col("_pc") + F.col("_c"))) \
        .drop("_b", "_v", "_s", "_c", "_ps", "_pc")


def assign_batches(df: DataFrame, order: Sequence[str], size: int, bucket: Column) -> DataFrame:
    """Fixed-size batches over a global order (the last one short)."""
    r = bucketed_rank(df.withColumn("_g", F.lit(0)), ["_g"], order, bucket, "_row")
    n = df.select(F.count(F.lit(1))).scalar()
    batch = F.floor((F.col("_row") - 1) / size).cast("bigint")
    return r.withColumn("batch", batch) \
        .withColumn("batch_size", F.least(F.lit(size).cast("bigint"), n - F.col("batch") * size)) \
        .drop("_g", "_row")
