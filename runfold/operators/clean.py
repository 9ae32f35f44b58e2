"""Clean-and-load jobs: e-mail and money/date cleaning, CSV → Parquet, exact
totals, the high-value summary and the per-dataset validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runfold.functions.text import amount_clean, email_clean, iso_date
from runfold.sources.files import csv_scan, csv_scan_checked


def clean_email(df: DataFrame, col: str = "customer_email") -> DataFrame:
    """``col`` becomes lower(trim(e)) when valid else NULL; adds
    ``email_valid``. Rows are kept either way."""
    clean, valid = email_clean(col)
    return df.withColumn("email_valid", valid).withColumn(col, clean)


def clean_amount_date(df: DataFrame, amount: str | None = "amount", date: str | None = "date",
                      precision: int = 18, scale: int = 2) -> DataFrame:
    """Trimmed money text → DECIMAL(p,s); ISO date text → DATE (bad → NULL)."""
    out = df
    if amount:
        out = out.withColumn(amount, amount_clean(amount, precision, scale))
    if date:
        out = out.withColumn(date, iso_date(date))
    return out


def csv_to_parquet(spark: SparkSession, src: str, dst: str, columns: list[str],
                   email: str = "customer_email", amount: str | None = "amount",
                   date: str | None = None, casts: dict[str, str] | None = None,
                   partition_by: list[str] | None = None, quarantine: str | None = None,
                   header: bool = True) -> DataFrame:
    """Read raw CSV (all text), clean e-mail / money / date, write Parquet,
    and return the written table read back. With ``quarantine`` (a folder), lines
    that don't have exactly ``columns`` go there as they are (``csv_scan_checked``),
    not into the table; without it they are cut or filled with NULL, and files must
    have a header."""
    if quarantine is None:
        df = csv_scan(spark, src, columns=columns)
    else:
        seen = Observation()
        df, bad = csv_scan_checked(spark, src, columns, header, seen)
    for c, t in (casts or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    if email:
        df = clean_email(df, email)
    df = clean_amount_date(df, amount, date)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(dst)
    if quarantine is not None:
        if not seen.get["n_malformed"]:
            bad = spark.createDataFrame([], bad.schema)
        bad.write.mode("overwrite").parquet(quarantine)
    return spark.read.parquet(dst)


def column_total(df: DataFrame, col: str, group_by: list[str] | None = None,
                 precision: int = 18, scale: int = 2, out: str = "total") -> DataFrame:
    """A1: exact total of a money column (DECIMAL, never DOUBLE), returned as
    DECIMAL(38, scale). Partial sums are combined map-side."""
    v = F.sum(F.col(col).cast(f"decimal({precision},{scale})")).cast(f"decimal(38,{scale})").alias(out)
    return df.groupBy(*(group_by or [])).agg(v)


def high_value_summary(orders: DataFrame, customer: DataFrame, threshold: float = 450000.0) -> DataFrame:
    """A2 (our rule): orders over ``threshold`` per market segment: count,
    exact total, average, maximum and the largest customer by value.

    The filter is pushed into the order scan and orders are summed per
    customer before the join on ``custkey`` (customers can be large: no
    forced broadcast; AQE may still pick one from runtime sizes)."""
    o = orders.where(F.col("o_totalprice") > threshold).select("o_custkey", "o_totalprice")
    amt = F.col("o_totalprice").cast("decimal(18,2)")
    # pre-aggregate per customer before the join: the join sees one row per
    # customer, not one per order
    per_order_cust = (o.groupBy("o_custkey")
                       .agg(F.count(F.lit(1)).alias("n"), F.sum(amt).alias("s"), F.max("o_totalprice").alias("m")))
    per_cust = per_order_cust.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return (per_cust.groupBy("c_mktsegment")
            .agg(F.sum("n").alias("n_orders"),
                 F.sum("s").cast("decimal(38,2)").alias("total_value"),
                 (F.sum("s").cast("double") / F.sum("n")).alias("avg_value"),
                 F.max("m").alias("max_value"),
                 F.max_by("o_custkey", F.struct(F.col("s"), -F.col("o_custkey"))).alias("top_customer")))


def validation_report(clean: DataFrame, dataset: str, amount: str = "amount",
                      email_valid: str = "email_valid", runs: DataFrame | None = None,
                      quarantined: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """One row per dataset in one aggregation pass: rows, issues found,
    exact total, value range, status and a suggested remedy.

    With ``runs(dataset, run_id, ts, status)`` (job polls), each dataset also
    gets its execution status (latest poll) and processing time (first to
    last poll, seconds), joined on the dataset key.

    With ``quarantined(dataset)`` (one row per malformed line) each such line is an
    issue, counted in ``n_quarantined``. With ``outputs(dataset, status)`` (J9, one row
    per expected output) a missing or empty output is an issue that fails the dataset.
    Datasets that only these name (NULL is one, too) get a row of their own."""
    rep = clean.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(email_valid)).alias("n_bad_email"),
        F.count_if(F.col(amount).isNull()).alias("n_bad_amount"),
        F.sum(amount).cast("decimal(38,2)").alias("total_amount"),
        F.min(amount).cast("decimal(38,2)").alias("min_amount"),
        F.max(amount).cast("decimal(38,2)").alias("max_amount"))
    if quarantined is not None:
        rep = _beside(rep, quarantined.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_quarantined")), dataset)
    if outputs is not None:
        rep = _beside(rep, outputs.select(dataset, F.col("status").alias("output_status")), dataset)
    counts = [c for c in rep.columns if c.startswith("n_")]
    rep = rep.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    bad_lines = F.col("n_quarantined") if quarantined is not None else F.lit(0)
    lost = F.coalesce(F.col("output_status") != "ok", F.lit(False)) if outputs is not None else F.lit(False)
    issues = F.col("n_bad_email") + F.col("n_bad_amount") + bad_lines + lost.cast("bigint")
    status = (F.when(issues == 0, "PASSED")
               .when(~lost & (issues * 10 < F.col("n_rows") + bad_lines), "WARNING")
               .otherwise("FAILED"))
    remedies = [F.when(F.col("n_bad_email") > 0, F.lit("quarantine rows with invalid e-mail")),
                F.when(F.col("n_bad_amount") > 0, F.lit("fix non-numeric amounts at the source"))]
    if quarantined is not None:
        remedies.append(F.when(bad_lines > 0, F.lit("repair malformed lines in quarantine")))
    if outputs is not None:
        remedies.append(F.when(lost, F.concat(F.lit("load again, output is "), F.col("output_status"))))
    remedy = F.when(issues == 0, F.lit("none")).otherwise(F.concat_ws("; ", *remedies))
    rep = rep.withColumns({"status": status, "issues": issues, "remedy": remedy})
    if runs is not None:
        ex = (runs.groupBy(dataset)
                  .agg(F.max_by(F.col("status"), F.struct("ts", "run_id")).alias("execution_status"),
                       F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).cast("bigint").alias("processing_seconds")))
        rep = rep.join(ex, dataset, "left")
    return rep


def _beside(rep: DataFrame, more: DataFrame, dataset: str) -> DataFrame:
    """The columns of both, one row per dataset of either (each has one row a dataset)."""
    both = rep.unionByName(more, allowMissingColumns=True)
    return both.groupBy(dataset).agg(*[F.max(c).alias(c) for c in both.columns if c != dataset])
