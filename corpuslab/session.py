"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOT: str | None = None


def build_session(master: str | None = None, app: str = "corpuslab",
                  shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Local/test session. On a cluster use the session the platform gives."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets a private folder,
    registered as its checkpoint directory; on a cluster that would be one
    machine's disk, so there a missing setting raises.
    """
    global _LOCAL_ROOT
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            d = None
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="corpuslab-")
        d = _LOCAL_ROOT
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def own_shuffles(spark: SparkSession):
    """Queries that are run inside drop their shuffle files as soon as they end; else
    those lie on the disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Most bits of a filter of keys (8 MB).
KEY_BITS = 1 << 26


@contextlib.contextmanager
def key_filter(spark: SparkSession, n: int):
    """Joins that are planned inside and shuffle both sides drop rows without a partner before
    they shuffle them: Spark builds a Bloom filter of the smaller side's ``n`` keys, 16 bits for
    each up to ``KEY_BITS`` in all. That side has to be a stored table with a condition on it."""
    base = "spark.sql.optimizer.runtime.bloomFilter."
    conf = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": max(1, n),
            "maxNumItems": max(1, n), "numBits": min(KEY_BITS, max(1 << 10, 16 * n)), "maxNumBits": KEY_BITS}
    before = {base + k: spark.conf.get(base + k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(base + k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df, path: str, **options) -> None:
    with own_shuffles(df.sparkSession):
        df.write.mode("overwrite").options(**options).parquet(path)


def materialize(df, name: str):
    """Write ``df`` once as a parquet table in the shared folder and read it
    back: cuts lineage (branches stop recomputing it) and survives executor
    loss, without the double computation of an uncached checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    store(df, path)
    return spark.read.parquet(path)


def spread(df):
    """A stored table with fewer splits than the session has cores is dealt out over them;
    a larger one stays as it is, without a shuffle. (Of a plan with shuffles the splits
    are known only after they have run: spread the tables it reads.)"""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def splits(df) -> int:
    """Tasks for work on a stored table: its splits, or the session's cores if those are more."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


_TABLES: dict[tuple, tuple[str, str]] = {}
#: Tables that are as old as the session's inputs; removed when the process ends.
INPUTS = ("documents", "labels")


def input_state(spark: SparkSession, paths) -> str:
    """What the files under ``paths`` are now: number, bytes and a digest of their
    names, lengths and modification times. Only the listing is read (by the
    source's own file system, so any store works); the contents are not."""
    from pyspark.sql import functions as F
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "modificationTime", "length")
    r = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return "-".join(map(str, r))


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote, through the file system it is on."""
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def shared_table(spark: SparkSession, key: tuple, build, inputs=INPUTS, **options):
    """``build()`` written once per session, key (name, folder of the inputs) and
    state of the input files as a table in the shared folder; every later use, in
    any query, reads it. When an input table has been rewritten since, the table
    is built anew and the old one is dropped."""
    full = (spark.sparkContext.applicationId, *key)
    state = input_state(spark, [f"{key[1]}/{t}.parquet" for t in inputs])
    have = _TABLES.get(full)
    if have is None or have[0] != state:
        path = scratch_path(spark, str(key[0]))
        store(build(), path, **options)
        _TABLES[full] = state, path
        if have is not None:
            remove_table(spark, have[1])
    return spark.read.parquet(_TABLES[full][1])


def release(spark: SparkSession) -> None:
    """Drop the shared tables of this session (also done when the process ends
    while the session is still open)."""
    mine = [k for k in _TABLES if k[0] == spark.sparkContext.applicationId]
    for k in mine:
        remove_table(spark, _TABLES.pop(k)[1])


@atexit.register
def _release_at_exit() -> None:
    s = SparkSession.getActiveSession() if _TABLES else None
    if s is not None and s.sparkContext._jsc is not None:
        release(s)
