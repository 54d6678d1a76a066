"""Profiling and data-quality scans (one pass over the data each)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import ws_words
from corpuslab.session import materialize


def profile_schema(df: DataFrame) -> DataFrame:
    """(column_name, dtype, position, n_rows); the schema is metadata, the row
    count is one distributed count."""
    cols = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("dtype"),
                              F.lit(i + 1).alias("position"))
                     for i, (n, t) in enumerate(df.dtypes)])
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.explode(cols).alias("c"), "n_rows").select("c.*", "n_rows"))


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column_name, n_null) from one aggregate pass."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    out = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null"))
        for c in df.columns])).alias("r")).select("r.*")
    return out.filter("n_null > 0") if only_positive else out


def dup_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates); nulls compare equal. The shuffle key is
    a digest, not the values."""
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_distinct"))
            .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct")))


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str, cols: Sequence[str]) -> DataFrame:
    """n rows ordered by md5(seed || id): reproducible in any engine."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.orderBy(key).limit(n).select(*cols)


def long_labels(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """(task, label) rows, label as string, nulls dropped."""
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).cast("string").alias("label")) for t in tasks]))
        .alias("r")).select("r.*").filter(F.col("label").isNotNull()))


def class_counts(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Count per (task, label); map-side partial aggregation after the explode."""
    return long_labels(df, tasks).groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """count, share % (1 dp), imbalance ratio max/count (2 dp) per class.
    Totals come from a window over the grouped result, one row a class."""
    g = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    total, top = F.sum("n").over(every), F.max("n").over(every)
    return g.select("label", "n", F.round(F.col("n") * 100.0 / total, 1).alias("share_pct"),
                    F.round(top / F.col("n"), 2).alias("imbalance_ratio"))


def class_size_summary(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    c = class_counts(df, tasks)
    return (c.groupBy("task").agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_size"),
                                  F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("mean_size"))
            .withColumn("max_min_ratio", F.round(F.col("max_size") / F.col("min_size"), 6)))


def text_lengths(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    out = [F.col(id_col)]
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(""))
        out += [F.length(v).cast("bigint").alias(f"{c}_chars"), F.size(ws_words(v)).cast("bigint").alias(f"{c}_words")]
    return df.select(*out)


def _attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The group's ``cols`` on every row: a join on the keys, or scalar
    subqueries where there is one group only. The statistics are stored first, so
    their size decides how they are joined; of a plan Spark knows it too late and
    deals the rows out by group, a few tasks for all of them."""
    if keys:
        return df.join(materialize(stats.select(*keys, *cols), "group-stats"), list(keys))
    return df.select("*", *[stats.select(c).scalar().alias(c) for c in cols])


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], buckets: int = 1024) -> DataFrame:
    """keys, q: exact linear quantiles of ``col`` (no nulls) by rank. Equal values
    are counted first (map-side combined); the values are ranked within equal
    ranges of the group, shifted by the sizes of the earlier ranges, so no task
    holds a group."""
    return _counted_quantiles(_value_counts(df, keys, col), keys, probs, buckets)


def _value_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*keys, F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))


def _counted_quantiles(n: DataFrame, keys: Sequence[str], probs: Sequence[float], buckets: int = 1024) -> DataFrame:
    """``exact_quantiles`` of counted values (keys, _x, _n)."""
    st = n.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_total"))
    v = _attach(n, st, keys, ["_lo", "_hi", "_total"])
    v = v.withColumn("_b", F.coalesce(F.floor(F.try_divide((F.col("_x") - F.col("_lo")) * (buckets - 1), F.col("_hi") - F.col("_lo"))), F.lit(0)))
    per = v.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    per = per.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).drop("_s")
    v = v.join(per, [*keys, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_x")))
    def at(i):
        return F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i), F.col("_x")))
    cols = []
    for p in probs:
        pos = (F.col("_total") - 1) * F.lit(p)
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        cols.append(low + (high - low) * F.max(pos - F.floor(pos)))
    return v.groupBy(*keys).agg(F.array(*cols).alias("q"))


QUARTILES = (0.25, 0.5, 0.75)


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, linear quartiles, max per column, exact."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols]))
        .alias("r")).select("r.*").filter(F.col("x").isNotNull())
    st = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return (st.join(exact_quantiles(long, ["column_name"], "x", QUARTILES), "column_name")
            .select("column_name", "count", "mean", "std", "min",
                    *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max"))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), empty bins
    included, plus the group's mean and median on every row. The rows are read once,
    for the counts of equal values; all else comes from these."""
    keys = [by] if by else []
    base = df.select(*keys, F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    values = materialize(_value_counts(base, keys, "x"), "value-counts")
    mean = F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")
    stats = values.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.round(mean, 6).alias("mean"))
    stats = _attach(stats, _counted_quantiles(values, keys, [0.5]), keys, ["q"]).withColumn("median", F.round(F.col("q")[0], 6)).drop("q")
    width = (F.col("hi") - F.col("lo")) / bins
    binned = _attach(values, stats, keys, ["lo", "hi"])
    binned = binned.select(*keys, "_n", F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1))).cast("bigint").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.sum("_n").alias("n"))
    spine = stats.filter(F.col("lo").isNotNull()).select(*keys, "lo", "hi", "mean", "median",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return (spine.join(counts, keys + ["bin"], "left")
            .select(*keys, "bin",
                    F.round(F.col("lo") + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), "mean", "median"))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence, normalize: str | None = None,
             prefix: str = "c") -> DataFrame:
    """rows × cols counts, zero-filled; ``values`` is the known column domain
    (no extra job to discover it). normalize="row" scales each row to 100 %."""
    p = df.groupBy(rows).pivot(cols, list(values)).agg(F.count(F.lit(1)))
    names = [f"{prefix}{v}" for v in values]
    p = p.select(F.col(rows), *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(nm)
                                for v, nm in zip(values, names)])
    if normalize == "row":
        tot = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        p = p.select(F.col(rows), *[F.round(F.col(n) * 100.0 / tot, 2).alias(n) for n in names])
    return p


def out_of_taxonomy(df: DataFrame, label_col: str, taxonomy: DataFrame, level: str) -> DataFrame:
    """(level, label, n_rows) for labels absent from the taxonomy level."""
    known = taxonomy.select(F.col(level).alias("_k")).distinct()
    return (df.select(F.col(label_col).alias("label"))
            .join(known, F.col("label") == F.col("_k"), "left_anti")
            .groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(level).alias("level"), "label", "n_rows"))


def declared_vs_observed(df: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """Declared vs observed distinct class count per task (full outer join)."""
    tasks = [t for t in declared if t in df.columns]
    obs = long_labels(df, tasks).groupBy("task").agg(F.count_distinct("label").alias("observed"))
    spark = df.sparkSession
    dec = spark.createDataFrame([(k, int(v)) for k, v in declared.items()], "task string, declared long")
    return (dec.join(obs, "task", "full")
            .select("task", "declared", "observed",
                    F.coalesce(F.col("declared") == F.col("observed"), F.lit(False)).alias("matches")))


def token_budget(df: DataFrame, n_tokens: str, max_len: int) -> DataFrame:
    base = df.select(F.col(n_tokens).cast("double").alias("x")).filter(F.col("x").isNotNull())
    x = F.col("x")
    st = base.agg(F.count(x).alias("count"), F.round(F.avg(x), 6).alias("mean"),
                  F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                  F.round(F.avg((x <= max_len).cast("double")) * 100.0, 2).alias("pct_within"))
    st = _attach(st, exact_quantiles(base, [], "x", QUARTILES), [], ["q"])
    return st.select("count", "mean", "std", "min", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
                     "max", "pct_within")
