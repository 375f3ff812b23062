import pytest
from pyspark.sql import functions as F

#: Columns whose names operators use inside.
CLASH = ["rid", "fp", "h", "tpl", "component_id", "_id", "_taken", "_size", "_part", "key", "bucket", "lang_pred", "pii_kinds", "size", "taken", "node", "target", "_gone"]
LONG = " ".join(f"word{i % 997} under the mit license" for i in range(60_000))
ODD = [
    (1_000_000, None, "en", "a", 0), (1_000_001, "", "en", None, 0), (1_000_002, " \t\n ", None, "a", 3), (1_000_003, "12 34 --", "en", "b", 8), (1_000_004, LONG, "en", "b", len(LONG)),
    (1_000_005, "twice the same row of words here", "en", "c", 32), (1_000_005, "twice the same row of words here", "en", "c", 32), (1_000_006, "twice the same row of words here", "en", "c", 32),
    (None, "a row without an id at all", "en", "c", 26), (1_000_007, "naïve  café 　 schöne Straße  x", "de", None, 30), (1_000_008, "CC BY NC and Apache License, version 2!", "en", "a", 39), (1_000_009, "x", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, SCHEMA).repartition(3))


@pytest.fixture(scope="session")
def none(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def docs(spark, sf, odd):
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
