"""Readers and writers: explicit schemas, no inference, partitioned sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import splits

TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("category_level_1", T.StringType()),
    T.StructField("category_level_2", T.StringType()), T.StructField("category_level_3", T.StringType()),
    T.StructField("priority", T.IntegerType()), T.StructField("sentiment", T.StringType()),
    T.StructField("channel", T.StringType()), T.StructField("n_chars", T.LongType())])

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tickets(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(**_CSV).option("emptyValue", '""').csv(path)
    else:
        w.option("ignoreNullFields", "false").json(path)


def read_tickets(spark: SparkSession, path: str, schema: T.StructType = TICKET_SCHEMA,
                 fmt: str = "csv") -> DataFrame:
    """Header CSV whose text fields may hold quotes and newlines, or JSON lines."""
    if fmt == "csv":
        return spark.read.schema(schema).options(**_CSV).option("emptyValue", "").csv(path)
    return spark.read.schema(schema).json(path)


REPORT_SCHEMA = T.StructType([
    T.StructField("threshold", T.DoubleType()),
    T.StructField("flagged_pairs", T.ArrayType(T.StructType([T.StructField("test_idx", T.LongType())]))),
    T.StructField("n_flagged_above_threshold", T.LongType())])


def write_flag_report(flagged: DataFrame, id_col: str, threshold: float, path: str,
                      per_document: int = 10_000) -> None:
    """Near-duplicate report documents of about ``per_document`` ids each: their
    number grows with the ids, so a document (and its task) stays bounded. The
    announced total is repeated in each."""
    total = flagged.select(F.count(F.lit(1))).scalar()
    shards = F.greatest(F.lit(1), F.ceil(total / per_document))
    docs = flagged.groupBy(F.pmod(F.xxhash64(F.col(id_col)), shards).alias("_s")).agg(
        F.collect_list(F.struct(F.col(id_col).cast("bigint").alias("test_idx"))).alias("flagged_pairs"))
    docs.select(F.lit(threshold).alias("threshold"), "flagged_pairs",
                total.alias("n_flagged_above_threshold")).write.mode("overwrite").json(path)


def read_flagged(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(test_idx) distinct ids listed in the report document(s), plus the
    threshold and announced count. ``multi_line`` reads one pretty-printed
    document per file (the single-file report form); the sharded form written
    by ``write_flag_report`` is one document per line."""
    r = spark.read.schema(REPORT_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    return r.select("threshold", "n_flagged_above_threshold", F.explode("flagged_pairs.test_idx").alias("test_idx")) \
        .groupBy("test_idx").agg(F.max("threshold").alias("threshold"),
                                 F.max("n_flagged_above_threshold").alias("n_flagged_above_threshold"))


RUN_SCHEMA = T.StructType([T.StructField("config", T.StringType()), T.StructField("seed", T.LongType()),
                           T.StructField("metrics", T.StringType())])


def write_run_metrics(runs: DataFrame, path: str) -> None:
    """One JSON record per run ``{config, seed, metrics}``; files laid out by
    config so a glob over configs prunes whole folders."""
    runs.write.mode("overwrite").partitionBy("config").json(path)


def read_run_metrics(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """All run files under ``path`` matching ``glob``; config from the folder
    name (partition discovery), file name kept for provenance."""
    df = spark.read.schema(RUN_SCHEMA).option("pathGlobFilter", glob).json(path)
    return df.select("config", "seed", "metrics", F.col("_metadata.file_name").alias("file_name"))


# Metric-key shapes tried in order, first hit wins (fixed values of the
# reference's reader):  test_macro_f1_<task>, test.macro_f1_<task>,
# test.<task>.macro_f1, <task>_macro_f1, macro_f1_<task>, <task>
def metric_paths(task: str) -> list[str]:
    return [f"$.test_macro_f1_{task}", f"$.test.macro_f1_{task}", f"$.test.{task}.macro_f1",
            f"$.{task}_macro_f1", f"$.macro_f1_{task}", f"$.{task}"]


def extract_metric(json_col: Column, task: str) -> Column:
    return F.coalesce(*[F.get_json_object(json_col, p).try_cast("double") for p in metric_paths(task)])


def write_splits(df: DataFrame, path: str, cols: Sequence[str], fmt: str = "parquet") -> None:
    w = df.select(*cols, "split").write.mode("overwrite").partitionBy("split")
    (w.options(header="true").csv(path) if fmt == "csv" else w.parquet(path))


def write_metrics_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header="true").csv(path)


def read_metrics_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(header="true").csv(path)


def save_predictions(P: DataFrame, model: str, path: str) -> None:
    """Append one model's predictions; the store is partitioned by model."""
    P.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)


#: Shuffle partitions of a load for each split of the store.
PARTS = 4


def load_predictions(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    """Two or more models lined up by (id, task) — a keyed join, never by
    position. Partition pruning reads only the requested models.

    Rows are dealt out by id alone: an id's tasks then travel side by side, so its text
    is compressed away in the shuffle, and the number of partitions follows the store,
    so that they are sorted in memory. The few tasks of an id are matched as they meet;
    as an equality Spark would take the task for a key and shuffle by both."""
    st = spark.read.parquet(path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * splits(st))
    out = None
    for m in models:
        p = st.filter(F.col("model") == m).select("id", "task", "true_id", F.col("pred_id").alias(f"pred_{m}")).repartition(n, "id")
        if out is None:
            out = p
        else:
            p = p.select("id", F.col("task").alias("_task"), f"pred_{m}")
            same = (F.col("task") <= F.col("_task")) & (F.col("task") >= F.col("_task"))
            out = out.join(p, "id").filter(same).drop("_task")
    return out


def log_metrics(history: DataFrame, path: str, run_params: dict[str, str]) -> None:
    """Append (run, epoch, metric, value, params) rows to the run log."""
    params = F.create_map(*[x for k, v in run_params.items() for x in (F.lit(k), F.lit(v))])
    history.withColumn("params", params).write.mode("append").parquet(path)
