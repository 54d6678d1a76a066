"""Taxonomy (L1 → L2 → L3) operators over wide predictions
(id, true_l1..3, pred_l1..3). Taxonomy tables are joined on keys; their size
is the tree's, independent of the number of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = (("l1_l2", "l1", "l2"), ("l2_l3", "l2", "l3"))


def taxonomy_pairs(tax: DataFrame) -> DataFrame:
    """Distinct (edge, parent, child) for both edges."""
    out = None
    for name, p, c in EDGES:
        e = tax.select(F.lit(name).alias("edge"), F.col(p).alias("parent"), F.col(c).alias("child"))
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def children(tax: DataFrame) -> DataFrame:
    """Parent → sorted children per edge and the number of children."""
    g = taxonomy_pairs(tax).groupBy("edge", "parent").agg(F.array_sort(F.collect_set("child")).alias("cs"))
    return g.select("edge", "parent", F.array_join(F.transform("cs", lambda x: x.cast("string")), ",").alias("children"),
                    F.size("cs").cast("bigint").alias("n_children"))


def parent_map(rows: DataFrame, child: str, parent: str, order: list[str]) -> DataFrame:
    """Child → parent where the last row (by ``order``) wins; conflicts flagged."""
    return rows.groupBy(F.col(child).alias("child")).agg(
        F.max_by(F.col(parent), F.struct(*[F.col(o) for o in order])).alias("parent"),
        F.count_distinct(F.col(parent)).alias("n_parents")) \
        .withColumn("conflict", F.col("n_parents") > 1)


def pair_valid(pw: DataFrame, tax: DataFrame, p1: str = "pred_l1", p2: str = "pred_l2",
               p3: str = "pred_l3") -> DataFrame:
    """Adds l1_l2_valid / l2_l3_valid: is each predicted pair in the tree."""
    pairs = taxonomy_pairs(tax)
    out = pw
    for (name, _, _), (a, b) in zip(EDGES, ((p1, p2), (p2, p3))):
        pe = pairs.filter(F.col("edge") == name).select(F.col("parent").alias(f"_{name}_p"),
                                                         F.col("child").alias(f"_{name}_c"),
                                                         F.lit(True).alias(f"{name}_valid"))
        out = out.join(pe, (F.col(a) == F.col(f"_{name}_p")) & (F.col(b) == F.col(f"_{name}_c")), "left") \
            .drop(f"_{name}_p", f"_{name}_c").withColumn(f"{name}_valid", F.coalesce(F.col(f"{name}_valid"), F.lit(False)))
    return out


def inconsistency(pw: DataFrame, tax: DataFrame) -> DataFrame:
    """Count, rate (6 dp) and % (2 dp) of invalid L1→L2, L2→L3 and either."""
    v = pair_valid(pw, tax)
    bad = {"l1_l2": ~F.col("l1_l2_valid"), "l2_l3": ~F.col("l2_l3_valid"),
           "full": ~F.col("l1_l2_valid") | ~F.col("l2_l3_valid")}
    a = v.agg(F.count(F.lit(1)).alias("n_test"), *[F.sum(c.cast("bigint")).alias(f"{k}_count") for k, c in bad.items()])
    cols = [F.col("n_test")]
    for k in bad:
        cols += [F.col(f"{k}_count"), F.round(F.col(f"{k}_count") / F.col("n_test"), 6).alias(f"{k}_rate"),
                 F.round(F.col(f"{k}_count") * 100.0 / F.col("n_test"), 2).alias(f"{k}_pct")]
    return a.select(*cols)


def path_consistency(pw: DataFrame, tax: DataFrame) -> DataFrame:
    v = pair_valid(pw, tax)
    ok = (F.col("l1_l2_valid") & F.col("l2_l3_valid")).cast("bigint")
    a = v.agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("consistent_count"))
    return a.select("consistent_count", (F.col("n") - F.col("consistent_count")).alias("inconsistent_count"),
                    F.round(F.col("consistent_count") / F.col("n"), 6).alias("rate"),
                    F.round(F.col("consistent_count") * 100.0 / F.col("n"), 2).alias("pct"))


def correct_paths(pw: DataFrame, tax: DataFrame) -> DataFrame:
    """Invalid L2 → smallest valid child of the predicted L1 (kept when the L1
    has no children); then L3 against the corrected L2 the same way."""
    pairs = taxonomy_pairs(tax)
    first = pairs.groupBy("edge", "parent").agg(F.min("child").alias("first_child"))
    out = pw
    for name, src_parent, src_child, dst in (("l1_l2", "pred_l1", "pred_l2", "corr_l2"),
                                              ("l2_l3", "corr_l2", "pred_l3", "corr_l3")):
        pe = pairs.filter(F.col("edge") == name).select(F.col("parent").alias("_p"), F.col("child").alias("_c"),
                                                         F.lit(True).alias("_ok"))
        fc = first.filter(F.col("edge") == name).select(F.col("parent").alias("_fp"), "first_child")
        out = (out.join(pe, (F.col(src_parent) == F.col("_p")) & (F.col(src_child) == F.col("_c")), "left")
               .join(fc, F.col(src_parent) == F.col("_fp"), "left")
               .withColumn(dst, F.when(F.col("_ok"), F.col(src_child))
                           .otherwise(F.coalesce(F.col("first_child"), F.col(src_child))))
               .drop("_p", "_c", "_ok", "_fp", "first_child"))
    return out


def expand_path(df: DataFrame, leaf: str, pmap: DataFrame, pmap_up: DataFrame) -> DataFrame:
    """Leaf → (l3, l2, l1) through two child→parent maps; unknown nodes end
    the path early (lenient lookup)."""
    m3 = pmap.select(F.col("child").alias("_c3"), F.col("parent").alias("l2"))
    m2 = pmap_up.select(F.col("child").alias("_c2"), F.col("parent").alias("l1"))
    out = df.join(m3, F.col(leaf) == F.col("_c3"), "left").join(m2, F.col("l2") == F.col("_c2"), "left") \
        .drop("_c3", "_c2")
    return out.withColumn("path_len", 1 + F.col("l2").isNotNull().cast("int") + F.col("l1").isNotNull().cast("int"))


def hierarchical_f1(pw: DataFrame, tax: DataFrame, order: Sequence[str] = ("l1", "l2", "l3")) -> DataFrame:
    """Mean hierarchical precision / recall over rows and hF of the means. ``tax`` has
    the paths, or the training rows that hold them. A true leaf that it lacks raises;
    of several parents of a node that of the last row by ``order`` counts (a
    taxonomy without row order: of the greatest path)."""
    m3 = parent_map(tax, "l3", "l2", list(order)).select(F.col("child").alias("c3"), F.col("parent").alias("p2"))
    m2 = parent_map(tax, "l2", "l1", list(order)).select(F.col("child").alias("c2"), F.col("parent").alias("p1"))
    x = pw.select("id", "pred_l3", "true_l3").join(m3, F.col("true_l3") == F.col("c3"), "left") \
        .withColumnRenamed("p2", "t2").drop("c3") \
        .join(m2, F.col("t2") == F.col("c2"), "left").withColumnRenamed("p1", "t1").drop("c2")
    x = x.withColumn("t1", F.when(F.col("t1").isNull(), F.raise_error(F.concat(
        F.lit("true leaf not in the taxonomy: "), F.coalesce(F.col("true_l3").cast("string"), F.lit("null"))))).otherwise(F.col("t1")))
    x = x.join(m3, F.col("pred_l3") == F.col("c3"), "left").drop("c3") \
        .join(m2, F.col("p2") == F.col("c2"), "left").drop("c2")
    inter = ((F.col("pred_l3") == F.col("true_l3")).cast("int")
             + F.coalesce((F.col("p2") == F.col("t2")).cast("int"), F.lit(0))
             + F.coalesce((F.col("p1") == F.col("t1")).cast("int"), F.lit(0)))
    plen = 1 + F.col("p2").isNotNull().cast("int") + F.col("p1").isNotNull().cast("int")
    a = x.agg(F.avg(inter / plen).alias("hP"), F.avg(inter / F.lit(3.0)).alias("hR"))
    hf = F.coalesce(F.try_divide(2 * F.col("hP") * F.col("hR"), F.col("hP") + F.col("hR")), F.lit(0.0))
    a = a.withColumn("hF", hf)
    return a.select(*[F.round(c, 6).alias(c) for c in ("hP", "hR", "hF")],
                    *[F.round(F.col(c) * 100, 2).alias(f"{c}_pct") for c in ("hP", "hR", "hF")])


def parent_accuracy(pw: DataFrame) -> DataFrame:
    a1 = (F.col("pred_l1") == F.col("true_l1")).cast("bigint")
    a2 = (F.col("pred_l2") == F.col("true_l2")).cast("bigint")
    a = pw.agg(F.count(F.lit(1)).alias("n_eval"), F.sum(a1).alias("_a"), F.sum(a2).alias("_b"),
               F.sum(a1 * a2).alias("_c"))
    return a.select("n_eval", *[F.round(F.col(c) * 100.0 / F.col("n_eval"), 2).alias(n) for c, n in (
        ("_a", "l2_parent_accuracy_pct"), ("_b", "l3_parent_accuracy_pct"), ("_c", "full_parent_chain_accuracy_pct"))])
