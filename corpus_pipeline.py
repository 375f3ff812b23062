"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import common, langid, mixing, packing, pii, simhash
from larkspan.llm.queries import QUERY_KEY


#: A text whose best out-of-place score is below this is in none of the languages learned.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are in none of the corpus's languages: null ones, those without a letter, and those whose n-grams
    are next to all foreign to the nearest profile. Without any labelled text there is no profile to be foreign to, and
    all texts with a letter stay."""
    profiles = langid.learn(spark, docs)
    if not profiles:
        return docs.where(F.regexp_like("text", F.lit("\\p{L}")))
    return langid.identify(spark, docs, profiles).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each component of near-duplicates, that with the smallest id."""
    return simhash.dedup(spark, docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of private data, and the new text's length in n_chars."""
    found = pii.pseudonymise_column(spark, docs, QUERY_KEY)
    return found.withColumn("n_chars", F.when(F.col("pii_count") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and leaves out texts as the mix of sources takes them."""
    return mixing.mix_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of the texts into sequences."""
    return packing.pack(spark, docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("PII pseudonyms", private_data), ("mixing", mix), ("packing", pack)]

#: Fingerprints, pseudonyms and tokens have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
