"""Class centroids and token ids over the sparse rows of ``sparse``; the long form
(doc, term, tf) for models with a vocabulary for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import sparse as SP
from corpuslab.session import materialize


def term_counts(counted: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, term, tf) of counted rows, without a shuffle."""
    return counted.select(F.col(doc).alias("doc"), F.explode(F.arrays_zip("terms", "tf")).alias("z")).select("doc", F.col("z.terms").alias("term"), F.col("z.tf").alias("tf"))


def centroids(rows: DataFrame, label: str, scale: SP.Scale | None = None) -> DataFrame:
    """(label, idx, value): mean weight by class and term, from one pass."""
    sums = materialize(SP.class_sums(rows, label, scale), "class-sums")  # classes x vocabulary
    n = sums.filter("idx = -1").select("label", F.col("total").alias("n"))
    return sums.filter("idx >= 0").join(n, "label").select("label", "idx", (F.col("total") / F.col("n")).alias("value"))


def separability(cent: DataFrame) -> DataFrame:
    """Mean cosine distance between different class centroids, without pairing
    classes: for unit centroids the k(k-1) ordered cosines sum to
    ||sum of the centroids||^2 - k. ``cent`` should be a stored table."""
    norms = cent.groupBy("label").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("unit"))
    total = cent.join(norms, "label").groupBy("idx").agg(F.sum(F.col("value") / F.col("unit")).alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("q"))
    k = norms.agg(F.count(F.lit(1)).alias("k"))
    return total.crossJoin(k).select(  # one row each
        F.try_subtract(F.lit(1.0), F.try_divide(F.col("q") - F.col("k"), F.col("k") * (F.col("k") - 1))).alias("mean_inter_class_cosine_distance"),
        F.col("k").alias("n_classes"))


def pad_ids(tokens: DataFrame, doc: str, vocab: DataFrame, max_len: int) -> DataFrame:
    """Token ids (vocabulary rank + 2; 1 unknown, 0 padding), truncated and
    padded to ``max_len``, with the attention mask."""
    v = vocab.select("term", (F.col("rank") + 1).alias("tid"))
    t = tokens.select(doc, F.posexplode(F.slice("tokens", 1, max_len)).alias("pos", "term")).join(v, "term", "left")
    g = t.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tid", F.lit(1)).alias("tid")))).alias("s"))
    ids = F.transform("s", lambda x: x["tid"])
    n = F.size(ids)
    return tokens.select(doc).join(g, doc, "left").select(
        doc, F.concat(F.coalesce(ids, F.array().cast("array<bigint>")),
                      F.array_repeat(F.lit(0).cast("bigint"), F.lit(max_len) - F.coalesce(n, F.lit(0)))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.coalesce(n, F.lit(0))),
                 F.array_repeat(F.lit(0), F.lit(max_len) - F.coalesce(n, F.lit(0)))).alias("attention_mask"))
