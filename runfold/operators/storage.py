"""Object-store style jobs over listings: usage per prefix, expected-output
checks and prefix filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_prefix(path: Column, root: str, depth: int = 1) -> Column:
    """The first ``depth`` components of ``path`` below ``root``."""
    r = root.rstrip("/") + "/"
    rest = F.when(F.startswith(path, F.lit(r)), F.substring(path, len(r) + 1, 1 << 30))
    return F.array_join(F.slice(F.split(rest, "/", -1), 1, depth), "/")


def storage_usage(listing: DataFrame, prefix: Column) -> DataFrame:
    """A5: objects, bytes and latest change per prefix (partial aggregates)."""
    return (listing.withColumn("prefix", prefix)
                   .groupBy("prefix")
                   .agg(F.count(F.lit(1)).alias("n_objects"),
                        F.sum("length").alias("total_bytes"),
                        F.max("modificationTime").alias("last_modified")))


def output_existence(expected: DataFrame, listing: DataFrame, prefix: Column,
                     expected_col: str = "prefix") -> DataFrame:
    """Does each expected output prefix exist and hold data?

    The listing side derives its prefix column and the check is an equi join
    (a ``startswith`` theta join over a huge listing would not scale).
    ``status``: ``ok`` / ``empty`` (only zero-byte objects) / ``missing``."""
    per = (listing.withColumn(expected_col, prefix)
                  .groupBy(expected_col)
                  .agg(F.count(F.lit(1)).alias("n_objects"), F.sum("length").alias("total_bytes")))
    d = expected.join(per, expected_col, "left")
    n = F.coalesce(F.col("n_objects"), F.lit(0))
    return (d.withColumn("n_objects", n)
             .withColumn("total_bytes", F.coalesce(F.col("total_bytes"), F.lit(0)))
             .withColumn("status", F.when(n == 0, "missing").when(F.col("total_bytes") == 0, "empty").otherwise("ok"))
             .withColumn("passed", F.col("status") == "ok"))


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """rows whose name starts with ``prefix`` (pushed into the Parquet
    scan as a ``StringStartsWith`` filter)."""
    return df.where(F.startswith(F.col(col), F.lit(prefix)))
