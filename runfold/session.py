"""Session helpers: the settings every operator relies on, and the shared
staging folder (``spark.checkpoint.dir``) used for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "runfold") -> SparkSession:
    """Create (or reuse) a session with UTC time, ANSI mode and AQE on.

    On a cluster, pass nothing: master and partition counts come from the
    submit configuration. Tests pass ``local[*]`` and a small partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # JSON text parsed to VARIANT keeps the last of repeated keys, as JSON.parse does
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    staging_root(spark)
    return spark


def size_shuffles(spark: SparkSession, shuffle_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Size the initial shuffle partition count for a job that shuffles about
    ``shuffle_bytes``: one partition per ``partition_bytes`` (so each fits in
    executor memory and spills little), with AQE coalescing small ones and
    splitting skewed ones at run time. Returns the count set."""
    n = max(1, -(-int(shuffle_bytes) // int(partition_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(int(partition_bytes)))
    return n


def staging_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates and checkpoints.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Where it is unset, a
    fresh local folder is chosen on a ``local`` master only; on a cluster every
    executor would write to its own disk, so that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        cur = sc.getCheckpointDir()
        if cur:
            d = os.path.dirname(cur.rstrip("/"))
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver "
                             "and all executors share")
        else:
            d = tempfile.mkdtemp(prefix="runfold-ckpt-")
            spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the staging root (never reused, never removed)."""
    return f"{staging_root(spark)}/runfold/{name}-{uuid.uuid4().hex}"
