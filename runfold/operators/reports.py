"""Suite scores and tool-call counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_score(results: DataFrame, suite: str, success: str = "success") -> DataFrame:
    """A3: per suite, passed / total and whether all passed (a NULL result is
    not a pass)."""
    s = F.col(success)
    return (results.groupBy(suite)
                   .agg(F.count_if(s).alias("passed"), F.count(F.lit(1)).alias("total"),
                        (F.count_if(s) == F.count(F.lit(1))).alias("all_passed"))
                   .withColumn("score", F.col("passed") / F.col("total")))


def tool_call_count(messages: DataFrame, run: str, calls: Column) -> DataFrame:
    """A4: tool calls per run and tool, runs with no call kept (``tool``
    NULL, ``n_calls`` 0). ``calls`` is an ARRAY<STRING> of tool names per
    message. Two partial aggregates and a union; no join."""
    m = messages.select(F.col(run), calls.alias("__calls"))
    per_tool = (m.select(run, F.explode("__calls").alias("tool"))
                 .groupBy(run, "tool").agg(F.count(F.lit(1)).alias("n_calls")))
    idle = (m.groupBy(run).agg(F.sum(F.coalesce(F.size("__calls"), F.lit(0))).alias("__n"))
             .where(F.col("__n") == 0)
             .select(run, F.lit(None).cast("string").alias("tool"), F.lit(0).cast("bigint").alias("n_calls")))
    return per_tool.unionByName(idle)
