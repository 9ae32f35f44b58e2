"""Structured Streaming jobs: the same operators kept live.

Sources are file streams over the table folder (``pathGlobFilter`` picks one
table); sinks are Parquet folders under the shared staging root with their
own checkpoints, so a restarted or re-run job resumes exactly where it left
off. ``trigger`` defaults to ``availableNow`` (process what is there, then
stop); pass ``{"processingTime": "30 seconds"}`` for a live poll.

Aggregations run in ``update`` mode; each micro-batch of changed groups is
written to its own ``batch_id=N`` folder (overwritten if the batch is
retried), and readers take the latest row per key, so executor loss or a
rerun never duplicates or loses a batch. Every ``COMPACT_EVERY`` batches the
current rows are written whole as a snapshot; readers start from the newest one,
so a long-lived sink is not read from its beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.constants import POLL_SECONDS
from runfold.operators import state
from runfold.session import staging_path
from runfold.sources import tables as tb
from runfold.streaming import approvals

DEFAULT_TRIGGER = {"availableNow": True}
COMPACT_EVERY = 100


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream of one table's Parquet files (schema from the table). The
    table may be one file or a folder of part files: the last letter as a pattern
    makes the source list whatever has the name, and read folders' files."""
    schema = tb.table(spark, sf_dir, name).schema
    return parquet_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parque[t]", schema, max_files=max_files)


def parquet_stream(spark: SparkSession, src: str, schema, glob: str | None = None,
                   max_files: int | None = None, recursive: bool = False) -> DataFrame:
    """A Parquet file stream over ``src`` with a fixed schema."""
    r = spark.readStream.format("parquet").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(src)


def _runs_to_end(trigger: dict | None) -> bool:
    t = trigger or DEFAULT_TRIGGER
    return bool(t.get("availableNow") or t.get("once"))


def _run(writer, trigger: dict | None):
    """Start the query. A run-to-end trigger (``availableNow`` / ``once``)
    is awaited and its failure raised; a live trigger (``processingTime``)
    returns the running query at once."""
    q = writer.trigger(**(trigger or DEFAULT_TRIGGER)).start()
    if _runs_to_end(trigger):
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return q


def start_append(df: DataFrame, name: str, trigger: dict | None = None):
    """Stream ``df`` into a new Parquet folder (append mode); returns
    ``(query, path)``."""
    spark = df.sparkSession
    out, ck = staging_path(spark, name), staging_path(spark, name + "-ckpt")
    q = _run(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
               .outputMode("append"), trigger)
    return q, out


def start_update(df: DataFrame, name: str, trigger: dict | None = None, keys: list[str] | None = None,
                 compact_every: int = COMPACT_EVERY):
    """Stream an aggregate in update mode: each micro-batch of changed rows
    goes to its own ``batch_id=N`` folder; returns ``(query, path)``. Read
    the current state with ``latest_per_key`` at any time. With ``keys``, every
    ``compact_every`` batches the latest rows are written as a snapshot."""
    spark = df.sparkSession
    out, ck = staging_path(spark, name), staging_path(spark, name + "-ckpt")
    schema = df.schema

    def write_batch(batch: DataFrame, batch_id: int):
        # one folder per micro-batch, overwritten on retry: a re-run batch
        # replaces its own output instead of appending a second copy
        batch.write.mode("overwrite").parquet(f"{out}/kind=changes/batch_id={batch_id}")
        if keys and (batch_id + 1) % compact_every == 0:
            whole = latest_per_key(batch.sparkSession, out, keys, schema)
            whole.write.mode("overwrite").parquet(f"{out}/kind=snapshots/batch_id={batch_id}")

    q = _run(df.writeStream.foreachBatch(write_batch).option("checkpointLocation", ck).outputMode("update"), trigger)
    return q, out


def _append_sink(df: DataFrame, name: str, trigger: dict | None = None) -> str:
    return start_append(df, name, trigger)[1]


def _update_sink(df: DataFrame, name: str, trigger: dict | None = None, keys: list[str] | None = None,
                 compact_every: int = COMPACT_EVERY) -> str:
    return start_update(df, name, trigger, keys, compact_every)[1]


def _batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the finished ``batch_id=N`` folders below ``folder`` (none if it
    isn't there yet)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch_id=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_per_key(spark: SparkSession, path: str, keys: list[str], schema=None) -> DataFrame:
    """Read an update-mode sink: the newest row of every key, from the newest
    snapshot and the changes after it. A sink that no batch has reached yet is
    empty (of ``schema``, which it then needs)."""
    snapshots = _batch_ids(spark, f"{path}/kind=snapshots")
    since = snapshots[-1] if snapshots else -1
    parts = [(i, f"{path}/kind=changes/batch_id={i}") for i in _batch_ids(spark, f"{path}/kind=changes") if i > since]
    if snapshots:
        parts.insert(0, (since, f"{path}/kind=snapshots/batch_id={since}"))
    if not parts:
        if schema is None:
            raise ValueError("the sink is still empty: pass its schema")
        return spark.createDataFrame([], schema)
    # kind and batch_id come from the folder names, which are all below the sink
    d = spark.read.option("basePath", path).parquet(*[p for _, p in parts]).drop("kind")
    others = [c for c in d.columns if c not in keys and c != "batch_id"]
    return (d.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("batch_id")).alias("__r"))
             .select(*keys, *[F.col("__r").getField(c).alias(c) for c in others]))


# ------------------------------------------------------------------ S7
def copy_new_files(source: DataFrame, dst: str, checkpoint: str, trigger: dict | None = None) -> DataFrame:
    """Move the files of a file stream that are new since the last run
    from one store to another (Parquet). Rerun with the same ``dst`` and
    ``checkpoint``: files already copied are skipped, exactly once."""
    _run(source.writeStream.format("parquet").option("path", dst)
         .option("checkpointLocation", checkpoint).outputMode("append"), trigger)
    return source.sparkSession.read.parquet(dst)


def incremental_copy(spark: SparkSession, sf_dir: str, name: str, trigger: dict | None = None) -> DataFrame:
    """S7 for one table, to a fresh destination: returns the copy."""
    return copy_new_files(file_stream(spark, sf_dir, name), staging_path(spark, f"copy-{name}"),
                          staging_path(spark, f"copy-{name}-ckpt"), trigger)


# ------------------------------------------------------------------ ST1
def update_stream_df(events: DataFrame) -> DataFrame:
    return state.node_update(tb.with_messages(tb.state_log_from(events)))


def update_stream(spark: SparkSession, sf_dir: str, trigger: dict | None = None) -> DataFrame:
    """ST1: each finished node's projected update, appended as it arrives."""
    out = _append_sink(update_stream_df(file_stream(spark, sf_dir, "events")), "update-stream", trigger)
    return spark.read.parquet(out)


# ------------------------------------------------------------------ ST2
def streaming_state_df(events: DataFrame) -> DataFrame:
    return state.fold_state(tb.state_log_from(events))


def streaming_state(spark: SparkSession, sf_dir: str, trigger: dict | None = None) -> DataFrame:
    """ST2: per-session folded state (A8, A10, A11), kept live with built-in
    streaming aggregates (no Python state function needed: every channel is
    an order-aware aggregate)."""
    live = streaming_state_df(file_stream(spark, sf_dir, "events"))
    out = _update_sink(live, "streaming-state", trigger, ["session_id"])
    return latest_per_key(spark, out, ["session_id"], live.schema)


def streaming_context_df(events: DataFrame) -> DataFrame:
    log = tb.state_log_from(events).withColumn("map_value", F.get_json_object("props", "$.k"))
    return state.state_map_merge(log)


def streaming_context(spark: SparkSession, sf_dir: str, trigger: dict | None = None) -> DataFrame:
    """ST2, environment map (A9) kept live: the latest value of every key that a
    session's updates carry, one row per key."""
    keys = ["session_id", "map_key"]
    live = streaming_context_df(file_stream(spark, sf_dir, "events"))
    out = _update_sink(live, "streaming-context", trigger, keys)
    return latest_per_key(spark, out, keys, live.schema)


# ------------------------------------------------------------------ ST3
def job_status_df(orders_stream: DataFrame) -> DataFrame:
    """Latest status per job from a stream of status polls (orders: job =
    customer; F / P / O = FAILED / SUCCEEDED / RUNNING)."""
    st = (F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "SUCCEEDED")
           .otherwise("RUNNING"))
    runs = orders_stream.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run_id"),
                                F.col("o_orderdate").alias("ts"), st.alias("status"))
    return (runs.groupBy("job")
                .agg(F.max_by(F.col("status"), F.struct("ts", "run_id")).alias("latest_status"),
                     F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                     F.count(F.lit(1)).alias("n_polls")))


def read_job_status(spark: SparkSession, path: str) -> DataFrame:
    """Current job status from a status sink; jobs not terminal are the ones
    still to poll."""
    schema = "job long, latest_status string, first_seen timestamp_ntz, last_seen timestamp_ntz, n_polls long"
    return (latest_per_key(spark, path, ["job"], schema)
            .withColumn("is_terminal", F.coalesce(F.col("latest_status").isin(*TERMINAL), F.lit(False))))


def start_polling(spark: SparkSession, sf_dir: str, interval: str = f"{POLL_SECONDS} seconds"):
    """ST3 live: poll the status log every ``interval``; returns ``(query,
    path)``. Read with ``read_job_status(spark, path)``; stop with
    ``query.stop()``."""
    return start_update(job_status_df(file_stream(spark, sf_dir, "orders")), "poll-status",
                        {"processingTime": interval}, ["job"])


TERMINAL = ["SUCCEEDED", "FAILED"]


def poll_to_end(status: DataFrame, interval: str = f"{POLL_SECONDS} seconds", wait_seconds: float = 1.0,
                give_up_seconds: float | None = None) -> tuple[DataFrame, bool]:
    """ST3 that ends by itself: the stream ``status`` (``job_status_df``) is polled every
    ``interval`` until no job is open. Each batch reports how many of its jobs are open (an
    observed metric); only after a batch without one is the sink asked for jobs that an
    earlier batch left open, and the query stops when there is none. Returns the final job
    status and whether all jobs are terminal: False if ``give_up_seconds`` ran out first. A
    stream that no job has reached yet goes on."""
    import time
    spark = status.sparkSession
    open_ = F.count(F.when(~F.col("latest_status").isin(*TERMINAL) | F.col("latest_status").isNull(), 1))
    q, path = start_update(status.observe("jobs", F.count(F.lit(1)).alias("n"), open_.alias("open")), "poll-to-end",
                           {"processingTime": interval}, ["job"])
    began, seen, ended = time.monotonic(), -1, False
    try:
        while not ended and (give_up_seconds is None or time.monotonic() - began < give_up_seconds):
            if q.awaitTermination(wait_seconds) and q.exception() is not None:
                raise q.exception()
            new = [p for p in q.recentProgress if p["batchId"] > seen]
            jobs = [p["observedMetrics"]["jobs"] for p in new if "jobs" in p["observedMetrics"] and p["observedMetrics"]["jobs"].n]
            seen = max([seen, *(p["batchId"] for p in new)])
            if jobs and not jobs[-1].open:
                ended = read_job_status(spark, path).where(~F.col("is_terminal")).isEmpty()
    finally:
        q.stop()
    return read_job_status(spark, path), ended


def poll_until_terminal(spark: SparkSession, sf_dir: str, trigger: dict | None = None) -> DataFrame:
    """ST3: latest job status per job from a status-poll stream, processed to
    the end of what is there (``availableNow``)."""
    out = _update_sink(job_status_df(file_stream(spark, sf_dir, "orders")), "poll-status", trigger, ["job"])
    return read_job_status(spark, out)


# ------------------------------------------------------------------ ST4
def approval_run(spark: SparkSession, sf_dir: str, max_files: int | None = None, watermark_seconds: int = 600,
                 slice_seconds: int = approvals.SLICE_SECONDS) -> approvals.ApprovalRun:
    """ST4 over the events: clicks ask, purchases answer."""
    events = file_stream(spark, sf_dir, "events", max_files)
    is_ = lambda kind: F.col("event_type") == kind
    return approvals.ApprovalRun(spark, lambda marks: approvals.approvals_df(
        events, marks, is_("click"), is_("purchase"), watermark=f"{watermark_seconds} seconds", slice_seconds=slice_seconds))


def stream_ack_join(spark: SparkSession, sf_dir: str, max_files: int | None = None, watermark_seconds: int = 600) -> DataFrame:
    """ST4: every request with its earliest answer within the time-out, or denied when
    its timer fires. The run takes what is there, then a mark closes what is open."""
    run = approval_run(spark, sf_dir, max_files, watermark_seconds)
    run.to_end(watermark_seconds)
    return run.decisions()


# ------------------------------------------------------------------ ST2, message channel
def streaming_positions_df(messages: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """A7 kept live: every appended message gets its position (from 0) in its
    session's message list, across micro-batches.

    A running count that survives micro-batches is not a streaming aggregate,
    so this is the one Python state function: per session, the state is the
    number of messages seen so far; each micro-batch's rows of a session are
    numbered after it in ``seq`` order. Assumes an append-only log (a
    session's later batches carry larger ``seq``)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    out_schema = messages.select(key, seq, *cols).schema.add("position", "long")
    state_schema = "n long"
    names = [key, seq, *cols]

    def number(k, pdfs, state):
        import pandas as pd
        seen = state.get[0] if state.exists else 0
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(seq, kind="stable")
        batch = batch[names].copy()
        batch["position"] = range(seen, seen + len(batch))
        state.update((seen + len(batch),))
        yield batch

    return (messages.select(*names).groupBy(key)
                    .applyInPandasWithState(number, out_schema, state_schema, "append",
                                            GroupStateTimeout.NoTimeout))


def streaming_positions(spark: SparkSession, sf_dir: str, trigger: dict | None = None,
                        max_files: int | None = None) -> DataFrame:
    """Positions of conversation turns as a stream (conversations table)."""
    src = file_stream(spark, sf_dir, "conversations", max_files)
    out = _append_sink(streaming_positions_df(src, "conv_id", "turn", ["role", "text"]), "positions", trigger)
    return spark.read.parquet(out)


def streaming_messages(spark: SparkSession, sf_dir: str, trigger: dict | None = None,
                       max_files: int | None = None) -> DataFrame:
    """ST2's message channel without state: turns are appended to a sink once each as they
    arrive, and readers number them by A7's scan, which cuts long sessions into pieces. A
    late turn takes its place by ``turn``; those after it move up with the next read."""
    src = file_stream(spark, sf_dir, "conversations", max_files).select("conv_id", "turn", "role", "text")
    out = _append_sink(src, "messages", trigger)
    return state.state_append(spark.read.parquet(out), "conv_id", "turn", ["role", "text"])
