"""Scores, softmax, pooling and linear heads on array / long vector tables.

Score tables are long: (id, true_id, class_id, score). Per-id work is done
with window functions over ``partitionBy(id)`` followed by a groupBy on the
same key, so the table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def softmax(scores: DataFrame, by: Sequence[str] = ("id",), score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by)
    e = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def parent_of(class_col) -> F.Column:
    """Fixture parent rule: parent(c) = floor(c / 2)."""
    return F.floor(class_col / 2).cast("bigint")


def log_loss(scores: DataFrame) -> DataFrame:
    """Mean −ln p(true) for the class head and the parent head (parent
    probability = sum over its children) and the joint loss = sum over
    labelled heads ÷ number of heads."""
    p = softmax(scores)
    row = p.groupBy("id", "true_id").agg(
        (-F.ln(F.sum(F.when(F.col("class_id") == F.col("true_id"), F.col("p"))))).alias("l_label"),
        (-F.ln(F.sum(F.when(parent_of(F.col("class_id")) == parent_of(F.col("true_id")), F.col("p"))))).alias("l_parent"))
    heads = 2
    return row.select(F.explode(F.array(
        F.struct(F.lit("label").alias("task"), F.col("l_label").alias("l")),
        F.struct(F.lit("parent").alias("task"), F.col("l_parent").alias("l")),
        F.struct(F.lit("joint").alias("task"),
                 ((F.coalesce(F.col("l_label"), F.lit(0.0)) + F.coalesce(F.col("l_parent"), F.lit(0.0))) / heads)
                 .alias("l")))).alias("r")) \
        .groupBy("r.task").agg(F.round(F.avg("r.l"), 6).alias("mean_loss"))


def argmax_class(scores: DataFrame, keys: Sequence[str] = ("id", "true_id")) -> DataFrame:
    """Best class per row; the lowest class id wins a tie."""
    return scores.groupBy(*keys).agg(
        F.max_by("class_id", F.struct(F.col("score"), -F.col("class_id"))).alias("pred_id"))


def true_rank(scores: DataFrame) -> DataFrame:
    """(id, true_id, rank of the true class) where ties rank the higher class
    id first (reversed argsort). One shuffle by id."""
    w = Window.partitionBy("id")
    t = scores.withColumn("_ts", F.max(F.when(F.col("class_id") == F.col("true_id"), F.col("score"))).over(w))
    above = (F.col("score") > F.col("_ts")) | ((F.col("score") == F.col("_ts")) & (F.col("class_id") > F.col("true_id")))
    return t.groupBy("id", "true_id").agg((F.sum(above.cast("bigint")) + 1).alias("true_rank"))


def mean_pool(df: DataFrame, by: Sequence[str], vec: str, mask: str) -> DataFrame:
    """Masked mean per group and dimension: Σ v·m / max(Σ m, 1e-9)."""
    e = df.select(*by, F.col(mask).cast("double").alias("_m"), F.posexplode(vec).alias("pos", "_v"))
    return e.groupBy(*by, "pos").agg(
        F.round(F.sum(F.col("_v") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9)), 6).alias("value"))


def first_pool(df: DataFrame, by: Sequence[str], vec: str, order: str) -> DataFrame:
    """Vector of the first token per group (long form)."""
    g = df.groupBy(*by).agg(F.min_by(vec, order).alias("_v"))
    return g.select(*by, F.posexplode("_v").alias("pos", "value")) \
        .withColumn("value", F.round(F.col("value").cast("double"), 6))


def score_heads(vectors: DataFrame, weights: DataFrame, tasks: Sequence[str], vec: str = "vec") -> DataFrame:
    """Logits = W·x + b for several heads in one pass.

    ``weights`` has one row per task: (task, W array<array<double>>, b
    array<double>); its size is the model's (classes × dims), not the data's.
    Each vector row is paired with its task rows by an equi-join on task and
    scored with higher-order functions, so no per-dimension rows are made."""
    v = vectors.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    j = v.join(F.broadcast(weights), "task")
    logits = F.zip_with(F.col("W"), F.col("b"), lambda w, b: F.aggregate(
        F.zip_with(w, F.col(vec), lambda a, x: a * x.cast("double")), F.lit(0.0), lambda acc, y: acc + y) + b)
    return j.select(*[c for c in vectors.columns if c != vec], "task", logits.alias("logits"))


def to_predictions(logits: DataFrame, keys: Sequence[str] = ("id", "task")) -> DataFrame:
    """Softmax over a logits array: predicted class (lowest on ties) and its
    probability (4 dp)."""
    m = F.array_max("logits")
    ex = F.transform("logits", lambda x: F.exp(x - m))
    z = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    pred = F.array_position(F.col("logits"), m) - 1
    return logits.select(*keys, pred.cast("bigint").alias("pred_id"), F.round(F.lit(1.0) / z, 4).alias("confidence"))
