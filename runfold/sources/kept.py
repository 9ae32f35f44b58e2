"""A keyed table that takes change sets: buckets of a versioned folder.

A row's bucket is a hash of its ``bucket_by`` columns. A change set finds the buckets it
really changes, reads and rewrites these only and publishes them as the next version; the
files of all other buckets stay the same, and a change set without effect publishes
nothing. Readers see one published version; a change set that fails leaves it as it was,
and of two writers of one version the second raises (see ``versions.VersionedTable``).

The driver holds the numbers of the touched buckets, ``buckets`` at most. Take about one
bucket per 100 MB: a change set of one row costs one bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.operators import policy, registry
from runfold.operators.common import settled
from runfold.sources.versions import VersionedTable

_BUCKET = "__bucket"


class KeptTable:
    """``root`` with rows of ``schema``, bucketed by ``bucket_by`` (some of its columns;
    a change set looks rows up by these, NULLs are values like any other)."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, bucket_by: list[str], buckets: int = 64) -> None:
        self.spark, self.bucket_by, self.buckets = spark, bucket_by, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = VersionedTable(spark, root, _BUCKET)

    def version(self) -> int:
        """The newest published version, 0 before the first change set."""
        return self.stored.version()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version (the newest by default)."""
        return self._rows(self.version() if version is None else version).drop(_BUCKET)

    def change(self, keys: DataFrame, apply: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Rows of the buckets that hold ``keys`` (the ``bucket_by`` columns) become
        ``apply`` of them. Returns the new version, the old one without a key."""
        version = self.version() if version is None else version
        touched = [(r[0],) for r in keys.select(self._bucket()).distinct().collect()]
        if not touched:
            return version
        old = self._rows(version).where(F.col(_BUCKET).isin([b for b, in touched])).drop(_BUCKET)
        new = apply(old).to(self.schema).withColumn(_BUCKET, self._bucket())
        return self.stored.publish(new, self.spark.createDataFrame(touched, f"{_BUCKET} long"), expect=version)

    def compact(self) -> int:
        """All rows in one write: files that hold replaced rows are no longer read."""
        version = self.version()
        return self.stored.publish(self._rows(version), expect=version) if version else 0

    # -------------------------------------------------------- J6, J7, W5
    def insert_if_absent(self, new: DataFrame, added_at: Column | str | None = None) -> int:
        """J6 as a change set: rewrites the buckets of rules that are not there yet."""
        version, keys = self.version(), ["category", "target", "operation"]
        fresh = settled(new.select(*keys).distinct().join(self._rows(version).select(*keys), keys, "left_anti"), "fresh-rules")
        return self.change(fresh, lambda old: policy.insert_if_absent(old, fresh, added_at), version)

    def remove_by_target(self, removals: DataFrame) -> int:
        """J7 as a change set: rewrites the buckets that lose a rule."""
        version, keys = self.version(), ["category", "target"]
        hit = settled(removals.select(*keys).distinct().join(self._rows(version).select(*keys), keys, "left_semi"), "removed-rules")
        return self.change(hit, lambda old: policy.remove_by_target(old, hit), version)

    def upsert(self, registrations: DataFrame, name: str = "name", seq: str = "seq") -> int:
        """W5 as a change set: the latest registration of a name wins, also over those of
        earlier change sets, in whatever order the sets come; ``overwrites`` adds up.
        Repeating a set counts its registrations again."""
        found = settled(registry.upsert_last_wins(registrations, name, seq), "registrations")
        others = [c for c in found.columns if c not in (name, "overwrites")]

        def merged(old: DataFrame) -> DataFrame:
            return (old.unionByName(found).groupBy(name)
                       .agg(F.max_by(F.struct(*others), F.col(seq)).alias("__w"),
                            (F.sum(F.col("overwrites") + 1) - 1).alias("overwrites"))
                       .select(name, *[F.col("__w").getField(c).alias(c) for c in others], "overwrites"))
        return self.change(found, merged)

    def _bucket(self) -> Column:
        typed = [F.col(c).cast(self.schema[c].dataType) for c in self.bucket_by]
        return F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("long").alias(_BUCKET)

    def _rows(self, version: int) -> DataFrame:
        if version:
            return self.stored.read(version)
        return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.LongType())]))
