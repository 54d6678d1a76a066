"""Filters, keyed joins and set operations.

Where the reference lines rows up by position, these join on keys. Label and
taxonomy dimensions are aggregates of bounded size; joins against them are
left to Spark's planner, which broadcasts them after checking their size
(statistics, and with AQE the materialised size) and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.operators.profile import long_labels
from corpuslab.session import materialize


def errors(P: DataFrame) -> DataFrame:
    return P.filter(F.col("pred_id") != F.col("true_id"))


def dedup(df: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """One row per key tuple (nulls equal), the smallest ``order`` kept.
    Partial aggregation combines repeats map-side before the shuffle, whose key
    is a digest of the (null-safe) key tuple, not the texts themselves."""
    g = df.groupBy(F.sha2(F.to_json(F.struct(*keys)), 256).alias("_key")).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in keep if c != order])).alias("_r"))
    return g.select("_r.*")


def align(pred: DataFrame, truth: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    return pred.join(truth, list(on), "inner")


def build_dimension(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """(task, label, label_id): sorted distinct string labels → 0..k-1."""
    d = long_labels(df, tasks).distinct()
    return d.withColumn("label_id", (F.dense_rank().over(Window.partitionBy("task").orderBy("label")) - 1).cast("bigint"))


def encode(df: DataFrame, dim: DataFrame, tasks: Sequence[str], prefix: str = "label_",
           on_unknown: str = "error") -> DataFrame:
    """label → id per task; a non-null label missing from the dimension raises
    (``on_unknown="error"``) or becomes null (``"null"``). The dimension is stored first,
    so its size decides how it is joined: dealt out by label, whole classes (and all
    rows without a label) would meet in one task."""
    dim = materialize(dim.filter(F.col("task").isin(list(tasks))), "dimension")
    out = df
    for t in tasks:
        d = dim.filter(F.col("task") == t).select(F.col("label").alias(f"_l_{t}"), F.col("label_id").alias(f"{prefix}{t}"))
        out = out.join(d, F.col(t).cast("string") == F.col(f"_l_{t}"), "left").drop(f"_l_{t}")
        if on_unknown == "error":
            bad = F.col(t).isNotNull() & F.col(f"{prefix}{t}").isNull()
            out = out.withColumn(f"{prefix}{t}", F.when(bad, F.raise_error(
                F.concat(F.lit(f"unknown label for {t}: "), F.col(t).cast("string")))).otherwise(F.col(f"{prefix}{t}")))
    return out


def decode(P: DataFrame, names: DataFrame, cols: Sequence[str] = ("true_id", "pred_id")) -> DataFrame:
    """id → name per task using a (task, label_id, name) dimension."""
    out = P
    for c in cols:
        n = names.select(F.col("task").alias("_t"), F.col("label_id").alias("_i"), F.col("name").alias(c.replace("_id", "_name")))
        out = out.join(n, (F.col("task") == F.col("_t")) & (F.col(c) == F.col("_i")), "left").drop("_t", "_i")
    return out


def known_labels(df: DataFrame, dim: DataFrame, tasks: Sequence[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows known in every task, per-task report of kept / dropped rows)."""
    lg = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).cast("string").alias("label")) for t in tasks])).alias("r")) \
        .select(id_col, "r.*")
    tagged = lg.join(dim.select("task", "label", F.lit(True).alias("known")), ["task", "label"], "left")
    rep = tagged.groupBy("task").agg(F.count(F.lit(1)).alias("n_in"),
                                     F.sum(F.col("known").isNotNull().cast("bigint")).alias("n_kept")) \
        .withColumn("n_dropped", F.col("n_in") - F.col("n_kept"))
    kept = df
    for t in tasks:
        d = dim.filter(F.col("task") == t).select(F.col("label").alias(f"_k_{t}"))
        kept = kept.join(d, F.col(t).cast("string") == F.col(f"_k_{t}"), "left_semi")
    return kept, rep


def drop_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    return df.join(flagged.select(key).distinct(), key, "left_anti")


def grid(configs: DataFrame, config_col: str, seeds: Sequence[int]) -> DataFrame:
    """Every config × seed via a generator (no join)."""
    return configs.select(F.col(config_col).alias("config")).distinct() \
        .select("config", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("seed"))


def pending(g: DataFrame, done: DataFrame) -> DataFrame:
    return g.join(done.select("config", "seed").distinct(), ["config", "seed"], "left_anti")


def run_outcomes(g: DataFrame, runs: DataFrame) -> DataFrame:
    """Status and minutes per grid cell; a missing run is ``no_metrics``."""
    j = g.join(runs, ["config", "seed"], "left")
    return j.select("config", "seed", F.when(F.col("minutes").isNotNull(), "ok").otherwise("no_metrics").alias("status"),
                    "minutes")


def reference_metric(multi: DataFrame, single: DataFrame, key: str = "task") -> DataFrame:
    """Per task: multi-seed mean when present, else the single run's value."""
    j = single.select(key, F.col("value").alias("_s")).join(multi.select(key, F.col("value").alias("_m")), key, "full")
    return j.select(key, F.round(F.coalesce("_m", "_s"), 6).alias("reference_f1"),
                    F.when(F.col("_m").isNotNull(), "multi_seed_summary_mean")
                    .when(F.col("_s").isNotNull(), "checkpoint_test_metrics").alias("source"))


def union_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def order_by_list(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Known names in a fixed order with their row counts; absent ones marked."""
    order = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "config"))
    counts = df.groupBy(F.col(col).alias("config")).agg(F.count(F.lit(1)).alias("n_rows"))
    return order.join(counts, "config", "left").select(
        (F.col("pos") + 1).cast("bigint").alias("pos"), "config",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.col("n_rows").isNotNull().alias("present"))


def choose_source(listed: DataFrame, recomputed: DataFrame, expected: Column) -> DataFrame:
    """Use the listed ids unless the report announces more than it lists; then
    the recomputed set. Decided by a scalar subquery, no driver round trip."""
    n_listed = listed.select(F.count(F.lit(1))).scalar()
    use_re = expected > n_listed
    a = listed.select("id", F.lit("report_flagged_pairs").alias("source")).filter(~use_re)
    b = recomputed.select("id", F.lit("recomputed").alias("source")).filter(use_re)
    return a.unionByName(b)
