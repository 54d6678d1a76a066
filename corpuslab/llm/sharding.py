"""Sharding by sampled splitters, with DataFrame functions only.

Law ``bytes``: the shards are consecutive ranges of one order and hold nearly
equal bytes. The order is (fingerprint of the text, fingerprint of doc_id), so
copies of a text stand together and usually share a shard.

1. Sizes and fingerprints of all rows (one pass over the texts, written as a
   slim table).
2. A sample of about SAMPLE keys, each row drawn with a probability in
   proportion to its size (by a hash of the row, so a rerun draws the same),
   gives RANGES - 1 quantiles as splitters.
3. Exact bytes and rows of every range. A range with more than TWICE its share
   of bytes or rows - a hot text, a great heap of empty texts, or bad luck in
   the draw - is subdivided by the second fingerprint into equal parts. What is
   still overfull holds rows that share both fingerprints (repeated rows, empty
   texts without an id); those are numbered and dealt out in equal pieces.
4. Ranges, parts and pieces, a bounded list, are laid end to end; each belongs to
   the shard in which its middle lies. Slots number the rows of a shard: the part's
   offset plus the row's place in its part, so no window spans more than a part.

Nulls: a null text has size 1 (no bytes plus 1) and CRC 0; a null doc_id is a
key like any other. Repeated rows take a slot each, however many there are.
A very long text is a row like any other; it is never split. Other columns,
whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T
from corpuslab.session import materialize

RANGES, SAMPLE, TWICE, BUCKET = 2048, 65536, 2, 65536


UNIT = ["range", "part", "hot_h", "hot_t", "piece"]


def _find(key: Column, splitters: Column, n: int) -> Column:
    """Number of splitters <= key, by binary search inside one expression."""
    steps, k = [], 1
    while k <= n:
        steps.append(k)
        k *= 2
    take = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.aggregate(take, F.lit(0), lambda at, s: at + F.when(
        (at + s <= F.size(splitters)) & (F.try_element_at(splitters, at + s) <= key), s).otherwise(0))


def keys(docs: DataFrame) -> DataFrame:
    d = T.strip_columns(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                    F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id"), F.lit("tie")).alias("t"), F.monotonically_increasing_id().alias("row"))


def shard(docs: DataFrame, shards: int = 16, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    k = materialize(keys(docs), "shard-keys")
    total = k.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total["rows"]:
        return k.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    # a row is drawn if its hash, uniform in [0, 1), is below its share
    u = F.pmod(F.xxhash64("h", "t", F.lit("draw")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = k.filter(u < F.col("size") * F.lit(sample / total["bytes"]))
    cuts = drawn.agg(F.percentile_approx("h", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()["cuts"]
    cuts = F.lit(sorted(set(cuts or [])))
    k = k.withColumn("range", _find(F.col("h"), cuts, ranges))
    sums = k.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.greatest(F.col("bytes") * ranges / (TWICE * total["bytes"]), F.col("rows") * ranges / (TWICE * total["rows"]))).cast("int")
    # at most ``ranges`` rows
    k = k.join(F.broadcast(sums.select("range", F.greatest(F.lit(1), parts).alias("parts"))), "range")
    # the part: an equal interval of the second fingerprint
    place = F.pmod(F.shiftrightunsigned("t", 11), F.lit(1 << 53)) / F.lit(float(1 << 53))
    k = k.withColumn("part", F.floor(place * F.col("parts")).cast("int")).drop("parts")
    k = materialize(k, "shard-parts")
    units = k.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    much = (F.col("bytes") * ranges > 2 * TWICE * total["bytes"]) | (F.col("rows") * ranges > 2 * TWICE * total["rows"])
    # a unit or key with so much: at most ranges / TWICE of them, whatever the rows
    full = k.join(F.broadcast(units.filter(much).select("range", "part")), ["range", "part"])
    hot = full.groupBy("h", "t").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).filter(much)
    pieces = F.ceil(F.greatest(F.col("bytes") * ranges / total["bytes"], F.col("rows") * ranges / total["rows"]))
    hot = materialize(hot.select("h", "t", "rows", F.least("rows", pieces).alias("pieces"), F.ceil(F.col("rows") / BUCKET).alias("buckets")), "shard-hot")
    ranked = full.join(F.broadcast(hot), ["h", "t"]).withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    first = ranked.groupBy("h", "t", "bucket").count()
    first = first.select("h", "t", "bucket", (F.sum("count").over(Window.partitionBy("h", "t").orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("h", "t", "bucket").orderBy("row")) - 1
    ranked = ranked.join(first, ["h", "t", "bucket"]).withColumn("rank", rank).withColumn("piece", F.floor(F.col("rank") * F.col("pieces") / F.col("rows")))
    ranked = ranked.withColumn("place", F.col("rank") - F.ceil(F.col("piece") * F.col("rows") / F.col("pieces")))
    cols = ["doc_id", "size", "text_crc32", "range", "part"]
    ranked = ranked.select(*cols, F.col("h").alias("hot_h"), F.col("t").alias("hot_t"), "piece", "place")
    rest = k.join(F.broadcast(hot.select("h", "t")), ["h", "t"], "left_anti")
    wr = Window.partitionBy("range", "part").orderBy("h", "t", "doc_id", "size", "text_crc32")
    rest = rest.select(*cols, F.lit(0).cast("bigint").alias("hot_h"), F.lit(0).cast("bigint").alias("hot_t"), F.lit(-1).cast("bigint").alias("piece"),
                       (F.row_number().over(wr) - 1).cast("bigint").alias("place"))
    if hot.isEmpty():
        placed = rest
    else:
        placed = materialize(rest.unionByName(ranked), "shard-placed")
        units = placed.groupBy(*UNIT).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    units = units.select(*[F.col(c) if c in units.columns else F.lit(-1 if c == "piece" else 0).cast("bigint").alias(c) for c in UNIT], "bytes", "rows")
    # bounded: at most ranges + 4 * ranges / TWICE parts and pieces
    w = Window.orderBy(*UNIT)
    before = F.sum("bytes").over(w) - F.col("bytes")
    units = units.withColumn("shard", F.least(F.lit(shards - 1), F.floor((before + F.col("bytes") / 2) * shards / F.lit(total["bytes"])).cast("int")))
    ws = Window.partitionBy("shard").orderBy(*UNIT)
    units = units.withColumn("first", F.sum("rows").over(ws) - F.col("rows")).select(*UNIT, "shard", "first")
    out = placed.join(F.broadcast(units), UNIT)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"))
