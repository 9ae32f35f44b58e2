"""Published versions of a folder: earlier batches stay, failed writes change nothing."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runfold.operators import policy
from runfold.session import staging_path
from runfold.sources.versions import VersionedTable

ROWS = "id long, path string, batch string"


def rows(spark, *batches):
    return spark.createDataFrame([(i, f"/w/CodeSandBox/{name}{i}{end}", name) for name, n, end in batches for i in range(n)], ROWS).repartition(3)


def content(t, version=None):
    return sorted((r.batch or "", r.id) for r in t.read(version).collect())


def files(t):
    return {f for f in t.read().inputFiles() if "/data/" in f}


def test_a_second_call_keeps_earlier_batches(spark):
    dest = staging_path(spark, "v")
    policy.gated_write(rows(spark, ("a", 3, ".csv"), ("bad", 2, ".sh")), "batch", "id", dest)
    t = VersionedTable(spark, dest, "batch")
    first, before = content(t), files(t)
    assert first == [("a", i) for i in range(3)]
    refused = policy.gated_write(rows(spark, ("a", 9, ".sh"), ("bad", 2, ".exe")), "batch", "id", dest)
    assert {r.status for r in refused.collect()} == {"refused"} and t.version() == 1 and content(t) == first
    policy.gated_write(rows(spark, ("b", 2, ".csv")), "batch", "id", dest)
    assert content(t) == [*first, ("b", 0), ("b", 1)] and before < files(t)
    policy.gated_write(rows(spark, ("a", 1, ".csv")), "batch", "id", dest)  # a batch of the same name is replaced
    assert content(t) == [("a", 0), ("b", 0), ("b", 1)] and content(t, 1) == first and t.versions() == [1, 2, 3]


def test_a_write_that_fails_leaves_the_old_version(spark, monkeypatch):
    t = VersionedTable(spark, staging_path(spark, "v"), "batch")
    t.publish(rows(spark, ("a", 3, "")))
    broken = rows(spark, ("a", 5, ""), ("b", 5, "")).withColumn("id", F.when(F.col("batch") == "b", F.raise_error(F.lit("half way")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="half way"):
        t.publish(broken)
    assert t.version() == 1 and content(t) == [("a", i) for i in range(3)]
    made = VersionedTable._write

    def dies(self, df, path):  # after the data, before the pointer
        made(self, df, path)
        raise RuntimeError("lost")
    monkeypatch.setattr(VersionedTable, "_write", dies)
    with pytest.raises(RuntimeError):
        t.publish(rows(spark, ("b", 1, "")))
    monkeypatch.undo()
    assert content(t) == [("a", i) for i in range(3)]
    t.publish(rows(spark, ("b", 1, "")))
    assert content(t) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_two_writers_of_one_version(spark):
    t = VersionedTable(spark, staging_path(spark, "v"), "batch")
    t.publish(rows(spark, ("a", 1, "")))
    seen = t.version()
    t.publish(rows(spark, ("b", 1, "")), expect=seen)
    with pytest.raises(AnalysisException):
        t.publish(rows(spark, ("c", 1, "")), expect=seen)
    assert content(t) == [("a", 0), ("b", 0)]


def test_delete_rewrites_touched_batches_only(spark):
    dest = staging_path(spark, "v")
    policy.gated_write(rows(spark, ("a", 3, ".csv"), ("b", 3, ".csv"), ("c", 1, ".csv")), "batch", "id", dest)
    t = VersionedTable(spark, dest, "batch")
    policy.gated_write(rows(spark, ("d", 2, ".csv")), "batch", "id", dest)
    first = set(VersionedTable(spark, dest, "batch").read(1).inputFiles())
    untouched = files(t) - first
    asked = spark.createDataFrame([(1, "/w/CodeSandBox/a1.csv", "x"), (2, "/w/CodeSandBox/c0.csv", "x"), (3, "/w/CodeSandBox/b0.csv", "y"),
                                   (4, "/w/CodeSandBox/none.csv", "y")], ROWS)
    report = {r.batch: (r.status, r.first_reason) for r in policy.gated_delete(t, asked, "batch", "id").collect()}
    assert report == {"x": ("deleted", None), "y": ("refused", "File does not exist.")}
    assert content(t) == [("a", 0), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("d", 0), ("d", 1)] and untouched and untouched < files(t)
    assert t.versions() == [1, 2, 3] and len(content(t, 2)) == 9


def test_nulls_types_and_emptied_folders(spark):
    t = VersionedTable(spark, staging_path(spark, "v"), "batch")
    assert t.version() == 0 and t.publish(rows(spark).limit(0)) == 0
    df = spark.createDataFrame([(1, None, None), (2, "p", "007"), (2, "p", "007")], ROWS)
    t.publish(df)
    assert content(t) == [("", 1), ("007", 2), ("007", 2)] and t.read().schema == df.schema
    t.publish(df.limit(0), df.select("batch").distinct())
    assert content(t) == [] and t.read().columns == df.columns and len(content(t, 1)) == 3
