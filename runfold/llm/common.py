"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.session import staging_path

#: White space of the operators' contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared staging folder and read it back: cuts the
    lineage, and every later use sees the same rows however tasks are retried."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once per row (a one-element array carries
    it, so the optimizer can't copy the expression to every place of use)."""
    return F.element_at(F.transform(F.array(value), body), 1)
