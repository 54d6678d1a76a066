"""Model-artefact bookkeeping: which registered models can be evaluated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artefact_status(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per registered model: ``ok`` (has head weights),
    ``skipped_missing_heads`` (keys but no weights) or
    ``skipped_missing_checkpoint`` (no keys); plus the task set read from the
    key prefixes."""
    k = keys.groupBy("model").agg(
        F.array_join(F.array_sort(F.collect_set(F.split_part(F.col("key"), F.lit("."), F.lit(1)))), ",").alias("tasks"),
        F.max(F.col("key").endswith(".weight")).alias("_has_w"))
    j = registry.select("model").join(k, "model", "left")
    st = F.when(F.col("_has_w").isNull(), "skipped_missing_checkpoint") \
        .when(F.col("_has_w"), "ok").otherwise("skipped_missing_heads")
    return j.select("model", st.alias("status"), "tasks")


def expected_keys(models: DataFrame, tasks: Sequence[str], kinds: Sequence[str] = ("weight", "bias")) -> DataFrame:
    """Every model × every expected key, by a generator (no join)."""
    ks = [f"{t}.1.{k}" for t in tasks for k in kinds]
    return models.select("model", F.explode(F.array(*[F.lit(x) for x in ks])).alias("key"))


def keys_equal(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per model: keys missing, keys extra and whether the sets are equal."""
    a, e = actual.select("model", "key").distinct(), expected.select("model", "key").distinct()
    missing = e.join(a, ["model", "key"], "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("n_missing"))
    extra = a.join(e, ["model", "key"], "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("n_extra"))
    models = a.select("model").union(e.select("model")).distinct()
    out = models.join(missing, "model", "left").join(extra, "model", "left")
    return out.select("model", F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
                      F.coalesce("n_extra", F.lit(0)).alias("n_extra")) \
        .withColumn("keys_equal", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
