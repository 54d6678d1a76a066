"""The registered queries op1 to op13, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.llm import (decontaminate, jaccard_join, license_scan, packing, quality, secret_scan, sharding, source_audit, sql,
                           substring_dedup, suffix_dedup, token_counts, toxicity, whitening)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.join(_docs(spark, sf_dir))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(_docs(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return toxicity.classify(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(_docs(spark, sf_dir))


def op6_quality_rules(spark, sf_dir):
    out = quality.assess(_docs(spark, sf_dir)).drop("lang", "text_key")
    return out.withColumn("char_js", F.round("char_js", 9)).withColumn("word_js", F.round("word_js", 9))


def op7_sharding(spark, sf_dir):
    out = sharding.shard(_docs(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.digest(_docs(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan(_docs(spark, sf_dir))


def op11_source_audit(spark, sf_dir):
    return source_audit.audit(_docs(spark, sf_dir))


def op12_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_decontaminate, op3_substring_dedup, op4_toxicity, op5_suffix_dedup, op6_quality_rules, op7_sharding,
                                   op8_packing, op9_secret_scan, op10_license_scan, op11_source_audit, op12_token_counts, op13_whitening)}
SQL: dict[str, str] = dict(sql.SQL)
