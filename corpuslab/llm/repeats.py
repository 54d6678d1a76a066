"""What the exact-repeat operators and the similarity join share: document keys,
exact copies and the bookkeeping of positions.

Documents are known by ``d`` (doc_id; null counts as the largest) and ``k``, which
tells the different texts of one doc_id apart. It is 0 where a doc_id has one
text; else the texts are numbered, so no two ever share (d, k). Numbers below 0
are those of the id 2**63 - 1, whose ``d`` is that of the null id.
Positions travel as ``kp``: k in the upper half, the place in the lower.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

NULL_ID, BUCKETS = (1 << 63) - 1, 4096


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """d, text (null: empty), k and two text fingerprints h1, h2; ``whole`` adds the
    input row as a struct ``row``."""
    have = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    d = docs.select(*T.columns(docs, "doc_id", "text"), *have).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.col("doc_id").isNull().alias("no_id"),
                 F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), *[c.name for c in d.schema if c.name == "row"])
    several = d.groupBy("d").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter((F.col("lo") != F.col("hi")) | (F.col("d") == NULL_ID))
    texts = d.select("d", "no_id", "h1", "h2").join(several.select("d"), "d", "left_semi").distinct()
    texts = materialize(texts.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS))), "several-texts")
    first = texts.groupBy("d", "bucket").count()
    first = first.select("d", "bucket", (F.sum("count").over(Window.partitionBy("d").orderBy("bucket")) - F.col("count")).alias("first"))
    n = F.col("first") + F.row_number().over(Window.partitionBy("d", "bucket").orderBy("no_id", "h1", "h2")) - 1
    texts = texts.join(first, ["d", "bucket"]).withColumn("n", n)
    real = (F.col("d") == NULL_ID) & ~F.col("no_id")
    texts = texts.select("d", "no_id", "h1", "h2", F.when(real, -1 - F.col("n")).otherwise(F.col("n")).cast("int").alias("k"))
    texts = materialize(texts, "text-numbers")  # most often empty; left to the planner
    out = d.join(texts, ["d", "no_id", "h1", "h2"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return out.drop("no_id")


def classes(keyed_docs: DataFrame) -> DataFrame:
    """h1, h2, the first document of each class of equal texts, and its size
    (map-side combined: a huge class sends one row per task)."""
    return keyed_docs.groupBy("h1", "h2").agg(F.min("d").alias("first_d"), F.count(F.lit(1)).alias("copies"))


def pack(k: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (k.astype(np.int64) << 32) | place.astype(np.int64)


def unpack_columns():
    """(k, place) of the column kp."""
    return F.shiftright("kp", 32).cast("int").alias("k"), F.col("kp").bitwiseAND(0xFFFFFFFF).cast("int").alias("p")


def doc_id(d="d", k="k"):
    """doc_id from d and k."""
    return F.when((F.col(d) != NULL_ID) | (F.col(k) < 0), F.col(d))


ROWS = "g bigint, known boolean, many boolean, d bigint, kp bigint"


def witnesses(g: np.ndarray, d: np.ndarray, kp: np.ndarray, g2: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one batch, pre-aggregated: of each key the row with the smallest
    (document, place) stands as witness for the batch and says whether the key
    occurs more than once here (``many``); the later ones are ``known`` to be
    repeats, so they get a scattered key. A key that fills a third of the corpus
    thus sends one row per batch to its task. The same place of a repeated row
    counts once."""
    place = kp & 0xFFFFFFFF
    second = np.zeros(len(g), np.uint64) if g2 is None else g2
    order = np.lexsort((kp, place, d, second, g))
    g, d, kp, place, second = g[order], d[order], kp[order], place[order], second[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1]) | (d[1:] != d[:-1]) | (kp[1:] != kp[:-1])
        g, d, kp, place, second = g[new], d[new], kp[new], place[new], second[new]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(g)))
    many = np.repeat(size > 1, size)
    known = (d != np.repeat(d[start], size)) | (place != np.repeat(place[start], size))
    key = np.where(known, T.mix(d.astype(np.uint64) * T.U(0x9E3779B97F4A7C15) + kp.astype(np.uint64)), g)
    cols = [pa.array(key.view(np.int64)), pa.array(known), pa.array(many), pa.array(d), pa.array(kp)]
    names = ["g", "known", "many", "d", "kp"]
    if g2 is not None:
        cols.append(pa.array((second >> T.U(32)).astype(np.uint32).view(np.int32)))
        names.append("g2")
    return pa.RecordBatch.from_arrays(cols, names=names)


def positions(rows: DataFrame) -> DataFrame:
    """d, k and the list of places of each document (bounded by its length)."""
    return rows.select("d", *unpack_columns()).groupBy("d", "k").agg(F.collect_list("p").alias("places"))


def lists(column, rows: slice, off: np.ndarray) -> np.ndarray:
    """The places of a chunk's documents as sorted chunk places; ``off`` has the
    first place of each document."""
    part = column.slice(rows.start, rows.stop - rows.start)
    flat = np.asarray(part.flatten(), dtype=np.int64)
    n = np.asarray(pc.fill_null(pc.list_value_length(part), 0), dtype=np.int64)
    return np.sort(flat + np.repeat(off[:-1][: len(n)], n))


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True where x is in a sorted array."""
    if len(ordered) == 0:
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x
