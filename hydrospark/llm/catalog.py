"""One query for each corpus operator, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrospark.llm import bpe, exact_dedup, fingerprints, mixing, phrases, pii, quality, repair, sharding, simhash, substrings, token_files, toxicity
from hydrospark.llm.common import documents, labels


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(spark, token_files.write_files(documents(spark, sf_dir)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    named = lambda spans, kind=None: F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(named("base"), ","), 256).alias("base_sha256"), F.array_join(F.concat(named("base"), named("extra", "term")), ",").alias("spans"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_sharding, op3_byte_bpe, op4_exact_dedup, op5_mixing, op6_token_files, op7_quality, op8_toxicity, op9_simhash, op10_pii, op11_substrings, op12_conversation_repair, op13_phrases)}

ORACLES = {
    "op4_exact_dedup": """
        WITH g AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) AS again FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AND again = 1 AS kept, sha256(t) AS text_sha256 FROM g""",
    "op5_mixing": mixing.MIX_SQL,
    "op11_substrings": substrings.REPEATS_SQL,
    "op13_phrases": phrases.COLLOCATIONS_SQL,
}
