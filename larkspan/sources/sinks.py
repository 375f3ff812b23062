"""Sinks. Spark's committer makes each write whole or absent; nothing is replaced unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Columns of raw text, which derived tables must not carry.
TEXT_COLUMNS = ("Positive_Review", "Negative_Review", "review_text", "raw_review_text", "Review_Text", "text", "review")


def check_schema(df: DataFrame, name: str, required: list[str], forbidden: tuple[str, ...] = TEXT_COLUMNS) -> None:
    """Raises for missing columns and for columns of raw text. No job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    text = [c for c in df.columns if c in forbidden]
    if text:
        raise ValueError(f"{name} carries the text columns {text}")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_parquet(df: DataFrame, path: str, name: str, required: list[str], partition_by: list[str] | None = None, overwrite: bool = True) -> None:
    """A derived table, its schema checked first. partition_by: columns that later reads prune by."""
    check_schema(df, name, required)
    writer = df.write.mode(_mode(overwrite))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; numbers that are not finite become null, and null fields stay in the lines."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType) else F.col(c) for c in df.columns]
    df.select(*clean).write.mode(_mode(overwrite)).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, guarded: bool = False, overwrite: bool = False) -> None:
    """CSV with a header. guarded: for people's spreadsheets, so cells that would be formulas are quoted."""
    if guarded:
        df = df.select(*[X.quote_formula(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in df.columns])
    df.write.mode(_mode(overwrite)).option("header", "true").option("escape", '"').csv(path)
