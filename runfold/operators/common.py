"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runfold.session import staging_path


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared staging folder and read back: a result that is
    used twice is computed once, and a lost executor costs a read, not a rerun."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
