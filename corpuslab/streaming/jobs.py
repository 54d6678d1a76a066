"""Structured Streaming versions of the corpus jobs.

Each job reads a directory of files as a stream (explicit schema), applies the
same DataFrame logic as the batch operators, and writes to a sink with its
checkpoint in the shared folder, so a restarted query resumes exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_source(spark: SparkSession, path: str, schema, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A directory (or file) as a stream; a batch takes at most ``max_files`` files or
    ``max_bytes`` of files (one file at least)."""
    r = spark.readStream.schema(schema)
    if max_bytes is not None:
        r = r.option("maxBytesPerTrigger", max_bytes)
    elif max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def stream_score(src: DataFrame, score_batch: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Normalise + score every micro-batch with ``score_batch`` (any batch
    DataFrame function, e.g. the fitted naive Bayes) and write the predictions
    to the batch's own folder of ``sink``; a replayed batch overwrites it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_filter(src: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream–static semi join: keep rows whose keys are in the dimension."""
    return src.join(dim, list(on), "left_semi")


def stream_counts(src: DataFrame, ts: str, keys: Sequence[str], window: str, delay: str) -> DataFrame:
    """Counts per tumbling window with a watermark; late rows are dropped.
    ``TIMESTAMP_NTZ`` event times are cast to ``TIMESTAMP`` first."""
    x = src.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return x.groupBy(F.window("_ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def stream_dedup(src: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    x = src.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return x.dropDuplicatesWithinWatermark(list(keys)).drop("_ts")


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a streaming DataFrame into parquet with ``availableNow``."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", sink) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
