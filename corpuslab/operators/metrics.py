"""Classification metrics, all derived from one confusion-cell aggregate.

The predictions table ``P`` has (keys..., true_id, pred_id). It is shuffled
once into sparse confusion cells (keys, true_id, pred_id, n) with map-side
combine; every metric below works on those cells, whose size is bounded by
the number of label pairs actually seen, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRUE, PRED = "true_id", "pred_id"


def confusion(P: DataFrame, keys: Sequence[str] = ("task",), weight: str | None = None) -> DataFrame:
    """Sparse confusion cells; absent cells are zero."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return P.groupBy(*keys, TRUE, PRED).agg(n.cast("bigint").alias("n"))


def confusion_norm(P: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Cells divided by their true-class total (6 dp)."""
    c = confusion(P, keys)
    tot = c.groupBy(*keys, TRUE).agg(F.sum("n").alias("row_total"))
    return (c.join(tot, [*keys, TRUE])
            .select(*keys, TRUE, PRED, "n", F.round(F.try_divide(F.col("n"), F.col("row_total")), 6).alias("share")))


def class_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, support, predicted, tp, precision, recall, f1); labels are
    the union of true and predicted labels; 0 on zero division."""
    e = cells.select(*keys, F.explode(F.array(
        F.struct(F.col(TRUE).alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col(PRED).alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("r")).select(*keys, "r.*")
    g = e.groupBy(*keys, "label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"),
                                      F.sum("tp").alias("tp"))
    z = F.lit(0.0)
    return g.select(*keys, "label", "support", "predicted", "tp",
                    F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), z).alias("precision"),
                    F.coalesce(F.try_divide(F.col("tp"), F.col("support")), z).alias("recall"),
                    F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), z).alias("f1"))


def classification_metrics(P: DataFrame, keys: Sequence[str] = ("task",), weight: str | None = None,
                           digits: int = 6) -> DataFrame:
    """accuracy, macro precision / recall / F1 per key group."""
    st = class_stats(confusion(P, keys, weight), keys)
    return st.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.count(F.lit(1)).alias("n_classes"),
        F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.round(F.avg("precision"), digits).alias("macro_precision"),
        F.round(F.avg("recall"), digits).alias("macro_recall"),
        F.round(F.avg("f1"), digits).alias("macro_f1"))


def classification_report(P: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg``, ``weighted avg`` (4 dp)."""
    st = class_stats(confusion(P, keys), keys)
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in ("precision", "recall", "f1")]
    # classes and totals in one pass: of a single class the averages are its values
    g = st.groupingSets([[*keys, "label"], list(keys)], *keys, "label").agg(
        F.grouping("label").alias("_all"), F.sum("support").cast("double").alias("n"), F.array(F.try_divide(F.sum("tp"), F.sum("support"))).alias("acc"),
        F.array(*[F.avg(c) for c in ("precision", "recall", "f1")]).alias("macro"), F.array(*weighted).alias("wtd"))

    def row(name, values, at=(0, 1, 2), support=F.col("n")):
        return F.struct(name.alias("class"), *[F.col(values)[i].alias(c) for i, c in zip(at, ("precision", "recall", "f1_score"))], support.alias("support"))
    totals = F.array(row(F.lit("accuracy"), "acc", (0, 0, 0), F.col("acc")[0]), row(F.lit("macro avg"), "macro"), row(F.lit("weighted avg"), "wtd"))
    one = F.array(row(F.col("label").cast("string"), "macro"))
    out = g.select(*keys, F.explode(F.when(F.col("_all") == 1, totals).otherwise(one)).alias("r")).select(*keys, "r.*")
    return out.select(*keys, "class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def metrics_by_task(P: DataFrame, keys: Sequence[str] = (), task: str = "task") -> DataFrame:
    """macro-F1 and accuracy per task plus a ``mean`` row over tasks."""
    m = classification_metrics(P, [*keys, task]).select(*keys, task, "accuracy", "macro_f1")
    mean = m.groupBy(*keys).agg(F.round(F.avg("accuracy"), 6).alias("accuracy"),
                                F.round(F.avg("macro_f1"), 6).alias("macro_f1")) \
        .withColumn(task, F.lit("mean"))
    return m.unionByName(mean)


def level_decay(P: DataFrame, levels: Sequence[str] = ("l1", "l2", "l3")) -> DataFrame:
    m = classification_metrics(P, ["task"])
    return m.groupBy().pivot("task", list(levels)).agg(F.first("macro_f1")) \
        .select(*[F.col(lv).alias(f"macro_f1_{lv}") for lv in levels])


def error_summary(P: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    wrong = (F.col(PRED) != F.col(TRUE)).cast("bigint")
    return P.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("n_errors")) \
        .withColumn("error_rate", F.round(F.col("n_errors") / F.col("n"), 6)) \
        .withColumn("error_pct", F.round(F.col("n_errors") * 100.0 / F.col("n"), 2))


def errors_by_class(P: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Errors per true class, the class with most first (ties by label)."""
    e = P.filter(F.col(PRED) != F.col(TRUE)).groupBy(*keys, TRUE).agg(F.count(F.lit(1)).alias("n_errors"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n_errors").desc(), F.col(TRUE))))


def distribution_compare(P: DataFrame, train: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Class counts in truth, predictions and training side by side."""
    t = P.groupBy(*keys, F.col(TRUE).alias("label")).agg(F.count(F.lit(1)).alias("n_true"))
    p = P.groupBy(*keys, F.col(PRED).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    tr = train.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_train"))
    j = t.join(p, [*keys, "label"], "full").join(tr, [*keys, "label"], "full")
    return j.select(*keys, "label", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                      for c in ("n_true", "n_pred", "n_train")])


def hardest_classes(P: DataFrame, k: int, keys: Sequence[str] = ("task",)) -> DataFrame:
    """k classes with the lowest F1 per key (ties by label)."""
    st = class_stats(confusion(P, keys), keys)
    w = Window.partitionBy(*keys).orderBy(F.col("f1").asc(), F.col("label").asc())
    return st.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select(*keys, "rank", "label", F.round("f1", 6).alias("f1"), "support")


def model_compare(metrics: DataFrame, model: str = "model", score: str = "macro_f1") -> DataFrame:
    """Models by score, best flagged, delta to the best (scalar subquery)."""
    best = metrics.select(F.max(score)).scalar()
    return metrics.select(model, score, "accuracy", (F.col(score) == best).alias("is_best"),
                          F.round(F.col(score) - best, 6).alias("delta_to_best"))


def confusion_matrix(P: DataFrame, labels, task: str | None = None) -> DataFrame:
    """Zero-filled matrix for one task: a row per true label, a column per
    label of the known domain ``labels`` (the union of true and predicted
    labels). Built by pivoting the sparse cells, so no label × label spine is
    joined; the column count is the label domain's size."""
    cells = confusion(P.filter(F.col("task") == task) if task else P, ())
    labels = list(labels)
    wide = cells.groupBy(TRUE).pivot(PRED, labels).agg(F.first("n"))
    spine = cells.sparkSession.createDataFrame([(lb,) for lb in labels], [TRUE]) \
        .withColumn(TRUE, F.col(TRUE).cast(cells.schema[TRUE].dataType))
    rows = spine.join(wide, TRUE, "left")
    return rows.select(TRUE, *[F.coalesce(F.col(f"`{lb}`"), F.lit(0)).cast("bigint").alias(f"pred_{lb}") for lb in labels])
