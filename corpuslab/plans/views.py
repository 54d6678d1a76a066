"""Stand-in views over the test tables (see FIXTURES.md §2), Spark side.

The SQL twins live in ``sqlviews.py``; both must describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.hashing import h32

TASK_LEVELS = ["l1", "l2", "l3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priority_of(n_chars):
    return (F.when(n_chars < 500, 1).when(n_chars < 1000, 2).when(n_chars < 2000, 3)
            .when(n_chars < 4000, 4).otherwise(5))


def tickets(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """documents ⟕ labels as a ticket table (``documents`` may be a stream)."""
    d = table(spark, sf_dir, "documents") if documents is None else documents
    lab = table(spark, sf_dir, "labels").withColumn("_labelled", F.lit(True))
    nl = F.instr(F.col("text"), "\n")
    pr = priority_of(F.col("n_chars"))
    return (d.join(lab, "doc_id", "left")
            .select(
                F.col("doc_id").alias("ticket_id"),
                F.when(nl > 0, F.col("text").substr(F.lit(1), nl - 1))
                 .otherwise(F.col("text")).alias("title"),
                F.when(nl > 0, F.col("text").substr(nl + 1, F.length("text")))
                 .alias("description"),
                F.col("lang").alias("category_level_1"),
                F.col("source").alias("category_level_2"),
                F.concat(F.col("source"), F.lit("_p"), pr.cast("string")).alias("category_level_3"),
                pr.alias("priority"),
                F.when(F.col("_labelled"), F.concat(F.col("quality").cast("string"),
                                                    F.col("toxic").cast("string")))
                 .alias("sentiment"),
                F.concat(F.lit("ch"), (F.substring("source", 4, 10).cast("int") % 3)
                         .cast("string")).alias("channel"),
                F.col("n_chars")))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier → nation → region as an L1 → L2 → L3 tree."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_regionkey").cast("bigint").alias("l1"),
                    F.col("n_nationkey").cast("bigint").alias("l2"),
                    F.col("s_suppkey").cast("bigint").alias("l3")))


def line_id(li: DataFrame):
    parts = [li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey,
             F.round(li.l_extendedprice * 100).cast("bigint")]
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def predictions_wide(spark: SparkSession, sf_dir: str, salt: str = "",
                     salts: list[str] | None = None) -> DataFrame:
    """One row per lineitem: true path from its supplier, a noisy predicted
    path (20 % of each level replaced by a hashed node) and confidences.

    With ``salts`` the table is scanned once and each row is scored once per
    salt (a ``salt`` column tells the runs apart)."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sizes = {"l1": table(spark, sf_dir, "region").select(F.count("*")).scalar(),
             "l2": table(spark, sf_dir, "nation").select(F.count("*")).scalar(),
             "l3": table(spark, sf_dir, "supplier").select(F.count("*")).scalar()}
    base = (li.select(line_id(li).alias("id"), "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("id", "l_orderkey", "l_linenumber", "l_returnflag",
                    F.col("n_regionkey").cast("bigint").alias("true_l1"),
                    F.col("s_nationkey").cast("bigint").alias("true_l2"),
                    F.col("l_suppkey").cast("bigint").alias("true_l3")))
    if salts is None:
        salt_col = F.lit(salt)
    else:
        base = base.withColumn("salt", F.explode(F.array(*[F.lit(x) for x in salts])))
        salt_col = F.col("salt")
    cols = [F.col(c) for c in base.columns]
    for lv in TASK_LEVELS:
        cols.append(F.when(h32(salt_col, F.lit(lv), F.col("id")) % 10 >= 8,
                           h32(F.lit("alt"), salt_col, F.lit(lv), F.col("id")) % sizes[lv])
                    .otherwise(F.col("true_" + lv)).alias("pred_" + lv))
    for lv in TASK_LEVELS:
        cols.append((F.lit(0.5) + (h32(F.lit("conf"), salt_col, F.lit(lv), F.col("id")) % 500)
                     .cast("double") / 1000.0).alias("conf_" + lv))
    return base.select(*cols)


def to_long(w: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Wide predictions → P = (..., id, task, true_id, pred_id, confidence)."""
    keep = keep if keep is not None else [c for c in ("salt",) if c in w.columns]
    return w.select(*keep, "id", F.explode(F.array(*[
        F.struct(F.lit(lv).alias("task"), F.col("true_" + lv).alias("true_id"),
                 F.col("pred_" + lv).alias("pred_id"), F.col("conf_" + lv).alias("confidence"))
        for lv in TASK_LEVELS])).alias("r")).select(*keep, "id", "r.*")


def predictions(spark: SparkSession, sf_dir: str, salt: str = "",
                salts: list[str] | None = None) -> DataFrame:
    """Long form P = (id, task, true_id, pred_id, confidence)."""
    return to_long(predictions_wide(spark, sf_dir, salt, salts))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, true_id, class_id, score): odd vec_ids scored against the label
    centroids of even vec_ids (dot product, 6 dp)."""
    e = table(spark, sf_dir, "embeddings")
    pe = e.filter(F.col("vec_id") % 2 == 0).select("label", F.posexplode("embedding").alias("pos", "v"))
    cent = pe.groupBy(F.col("label").cast("bigint").alias("class_id"), "pos").agg(F.avg("v").alias("c"))
    rows = cent.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("w"))
    # one array for each class: classes x dimensions, whatever the rows
    heads = rows.select(F.collect_list(F.struct("class_id", F.transform("w", lambda x: x["c"]).alias("w")))).scalar()
    test = e.filter(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("true_id"),
                                                     "embedding", F.explode(heads).alias("head"))
    dot = F.aggregate(F.zip_with("embedding", "head.w", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return test.select("id", "true_id", F.col("head.class_id").alias("class_id"), F.round(dot, 6).alias("score"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, metric): events per user and day of month."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("run"),
                       F.dayofmonth("ts").cast("bigint").alias("epoch"))
            .agg(F.round(F.avg("value"), 6).alias("metric")))
