"""A folder of Parquet files whose readers always see one published version.

``data/<write>`` holds the rows of one write, ``lists/<list>`` which batches are live and
in which write they are, and ``pointer/version=N`` one file that names the list of version
N. A write first puts its data and its list beside the others, where no reader looks, and
then publishes them with the pointer, whose only file is moved into place by one rename. A
write that fails before leaves the last version as it is; earlier versions stay readable.
Two writers of one version: the second one's pointer is there already, so it raises and
changes nothing.

The driver holds the names of the live writes (one per call that published), never batches
or rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows per file of a write.
FILE_ROWS = 1_000_000


class VersionedTable:
    """``root`` with rows grouped in batches named by ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(r.version for r in self._pointers().select("version").distinct().collect())

    def version(self) -> int:
        """The newest published version, 0 if there is none."""
        return (self.versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version (the newest by default)."""
        pointer = self._pointer(self.version() if version is None else version)
        schema = StructType.fromJson(json.loads(pointer.schema_json))
        live = self._list(pointer)
        writes = [r.write for r in live.select("write").distinct().collect()]
        if not writes:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add("__write", "string")).parquet(*[f"{self.root}/data/{w}" for w in writes])
        live = live.select(F.col("batch").alias("__batch"), F.col("write").alias("__of"))
        return rows.join(live, F.col(self.key).eqNullSafe(F.col("__batch")) & (F.col("__write") == F.col("__of")), "left_semi").drop("__write")

    def publish(self, rows: DataFrame, emptied: DataFrame | None = None, expect: int | None = None) -> int:
        """A new version: the batches of ``rows`` replace those of the same name, those of
        ``emptied`` (one column) go, all others stay in the files they are in. ``expect``:
        the version that the rows were made from. Returns the new version, or the old one
        where there is nothing to change."""
        version = self.version() if expect is None else expect
        write = uuid.uuid4().hex
        data = f"{self.root}/data/{write}"
        schema = rows.schema
        self._write(rows.withColumn("__write", F.lit(write)), data)
        done = self.spark.read.schema(schema).parquet(data)
        new = done.groupBy(F.col(self.key).alias("batch")).agg(F.lit(write).alias("write"), F.count(F.lit(1)).alias("n_rows"))
        gone = new.select("batch") if emptied is None else new.select("batch").union(emptied)
        if gone.isEmpty():
            return version
        if version:
            old = self._list(self._pointer(version))
            gone = gone.select(F.col("batch").alias("__batch"))
            new = old.join(gone, F.col("batch").eqNullSafe(F.col("__batch")), "left_anti").union(new.select(*old.columns))
        name = uuid.uuid4().hex
        new.write.parquet(f"{self.root}/lists/{name}")
        pointer = self.spark.createDataFrame([(name, schema.json(), new.schema.json())], "list string, schema_json string, list_json string")
        pointer.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/pointer/version={version + 1}")
        return version + 1

    def _write(self, rows: DataFrame, path: str) -> None:
        """One task per ``FILE_ROWS`` rows of a batch: a large one is spread, small ones
        share files."""
        sizes = rows.groupBy(F.col(self.key).alias("__batch")).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("__n"))
        rows = rows.join(sizes, F.col(self.key).eqNullSafe(F.col("__batch"))).drop("__batch")
        slice_ = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("__n", "__write")]), F.col("__n"))
        rows.withColumn("__slice", slice_).repartition(self.key, "__slice").drop("__slice", "__n").write.parquet(path)

    def _pointers(self) -> DataFrame:
        schema = "list string, schema_json string, list_json string, version int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/pointer")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _pointer(self, version: int):
        found = self._pointers().where(F.col("version") == version).first()
        if found is None:
            raise ValueError(f"version {version} of {self.root} is not published")
        return found

    def _list(self, pointer) -> DataFrame:
        schema = StructType.fromJson(json.loads(pointer.list_json))
        return self.spark.read.schema(schema).parquet(f"{self.root}/lists/{pointer.list}")
