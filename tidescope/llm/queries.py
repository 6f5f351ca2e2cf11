"""Queries of the numbered operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.llm import (
    decontaminate,
    exact_dedup,
    license_scan,
    pii,
    sentencepiece_codec,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)
from tidescope.llm.common import TOKENIZER, cut, documents

#: The key of the demonstration; a real one comes from the caller's secret store.
KEY = b"tidescope demonstration key"


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("th")


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("row.text", F.lit(""))
    return sharding.shard(documents(spark, sf_dir), 8).select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumn("dice", F.round("dice", 6))


def op4_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_incremental_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), KEY).withColumn("n_replaced", F.size("spans"))


def op9_shared_prefix_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = cut(sentencepiece_codec.encode(documents(spark, sf_dir), TOKENIZER))
    done = sentencepiece_codec.decode(ids, TOKENIZER)
    return done.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (
    op1_latent_decontamination, op2_histogram_sharding, op3_license_scan, op4_streaming_exact_dedup, op5_compression_toxicity,
    op6_warc_derivatives, op7_incremental_substring_dedup, op8_feistel_pseudonyms, op9_shared_prefix_sentencepiece, op10_simhash_components,
)}

ORACLE_SQL: dict[str, str] = {
    "op7_incremental_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h FROM s),
        o AS (SELECT h, min(doc_id) AS owner FROM h GROUP BY h),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM (SELECT doc_id, s FROM h JOIN o USING (h) WHERE owner < doc_id)),
        k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        r AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.i = g.i GROUP BY k.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
    "op4_streaming_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
    """,
}
