"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import embed_graph, gif, langid, license_scan, mixing, packing, pii, quality, repair_codec, simhash

#: The key of the registered query only; whoever runs the operator passes one of their own.
QUERY_KEY = b"larkspan query key, not a secret"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spark, _documents(spark, sf_dir))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair_codec.write_shards(spark, _documents(spark, sf_dir))
    return repair_codec.read_shards(spark, shards)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_column(spark, _documents(spark, sf_dir), QUERY_KEY).select("doc_id", "text", "pii_kinds", "pii_count")


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = C.scratch(gif.text_media(spark, _documents(spark, sf_dir)), "media")
    return gif.media_digest(spark, stored)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    profiles = langid.learn(spark, docs.where(~out))
    # Predictions see the text alone.
    found = langid.identify(spark, docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(spark, _documents(spark, sf_dir))


def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality.resample(spark, _documents(spark, sf_dir), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_simhash_dedup, op3_repair_tokens, op4_pii_pseudonyms, op5_gif_media, op6_best_fit_packing, op7_language_id, op8_mix_sources, op9_embedding_graph, op10_importance_resampling)
}
#: None of these has an SQL form; tests hold them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {}
