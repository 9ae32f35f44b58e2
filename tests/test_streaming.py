"""Streams with availableNow equal their batch twins."""

from pyspark.sql import functions as F

from runfold.operators import state
from runfold.sources import tables as tb
from runfold.streaming import streams
from tests.conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_incremental_copy_equals_source(spark):
    got = streams.incremental_copy(spark, SF_SMALL, "events")
    src = tb.table(spark, SF_SMALL, "events")
    assert _rows(got, src.columns) == _rows(src, src.columns)


def test_update_stream_equals_batch(spark):
    got = streams.update_stream(spark, SF_SMALL)
    batch = streams.update_stream_df(tb.table(spark, SF_SMALL, "events"))
    assert _rows(got, batch.columns) == _rows(batch, batch.columns)


def test_streaming_state_equals_batch_fold(spark):
    got = streams.streaming_state(spark, SF_SMALL)
    batch = state.fold_state(tb.state_log(spark, SF_SMALL))
    assert _rows(got, batch.columns) == _rows(batch, batch.columns)


def test_streaming_state_over_many_batches(spark):
    """Split the log into several files: update mode over many micro-batches
    still ends at the batch fold."""
    import uuid

    from runfold.session import staging_root
    d = f"{staging_root(spark)}/split-{uuid.uuid4().hex}"
    ev = tb.table(spark, SF_SMALL, "events")
    ev.repartition(4, "event_id").write.parquet(d + "/events.parquet")
    schema = ev.schema
    s = (spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", 1)
         .load(d + "/events.parquet"))
    out = streams._update_sink(streams.streaming_state_df(s), "many-batches")
    got = streams.latest_per_key(spark, out, ["session_id"])
    assert spark.read.parquet(out + "/kind=changes").select("batch_id").distinct().count() >= 4
    batch = state.fold_state(tb.state_log(spark, SF_SMALL))
    assert _rows(got, batch.columns) == _rows(batch, batch.columns)


def test_streams_read_folder_tables(spark):
    """A table that is a folder of part files, one file per trigger, gives every
    stream the batch result; snapshots every two batches change nothing."""
    import uuid

    from runfold.plans import QUERIES
    from runfold.session import staging_root
    d = f"{staging_root(spark)}/folder-{uuid.uuid4().hex}"
    for name in ("events", "orders"):
        tb.table(spark, SF_SMALL, name).repartition(4).write.parquet(f"{d}/{name}.parquet")
    for key in ("incremental_copy", "update_stream", "streaming_state", "streaming_context", "poll_until_terminal", "stream_ack_join"):
        one, four = QUERIES[key](spark, SF_SMALL), QUERIES[key](spark, d)
        assert sorted(map(str, one.collect())) == sorted(map(str, four.collect())), key
    s = streams.file_stream(spark, d, "events", max_files=1)
    out = streams._update_sink(streams.streaming_state_df(s), "snapshots", keys=["session_id"], compact_every=2)
    assert len(streams._batch_ids(spark, out + "/kind=snapshots")) >= 2
    got = streams.latest_per_key(spark, out, ["session_id"])
    batch = state.fold_state(tb.state_log(spark, SF_SMALL))
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_idle_poll_reads_as_empty(spark):
    from runfold.session import staging_path
    assert streams.read_job_status(spark, staging_path(spark, "never-written")).count() == 0


def test_poll_until_terminal_equals_batch(spark):
    got = streams.poll_until_terminal(spark, SF_SMALL)
    batch = state.job_latest_status(tb.job_runs(spark, SF_SMALL))
    cols = ["job", "latest_status", "first_seen", "last_seen", "n_polls", "is_terminal"]
    assert _rows(got, cols) == _rows(batch, cols)


def test_stream_ack_join_equals_batch(spark):
    from runfold.operators import policy
    got = streams.stream_ack_join(spark, SF_SMALL)
    ev = tb.table(spark, SF_SMALL, "events")
    req = ev.where("event_type = 'click'").select(F.col("event_id").alias("req_id"), "user_id", "ts")
    ans = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("aid"), "user_id", F.col("ts").alias("ats"))
    batch = policy.ack_interval_join(req, ans, "user_id", "req_id", "ts", "aid", "ats")
    cols = ["req_id", "answer_id", "decision"]
    assert _rows(got, cols) == _rows(batch, cols)


def test_copy_new_files_is_incremental(spark, tmp_path):
    from runfold.session import staging_path
    src = tmp_path / "src"
    ev = tb.table(spark, SF_SMALL, "events")
    ev.where("event_id < 500").write.parquet(str(src / "b1"))
    dst, ck = staging_path(spark, "copy-dst"), staging_path(spark, "copy-ck")

    def stream():
        return streams.parquet_stream(spark, str(src), ev.schema, "*.parquet", recursive=True)

    n1 = streams.copy_new_files(stream(), dst, ck).count()
    ev.where("event_id >= 500").write.parquet(str(src / "b2"))
    second = streams.copy_new_files(stream(), dst, ck)
    assert n1 == 500 and second.count() == ev.count()
    assert second.select("event_id").distinct().count() == ev.count()       # nothing copied twice


def test_live_polling_returns_running_query(spark):
    import time
    q, path = streams.start_polling(spark, SF_SMALL, interval="1 second")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not q.recentProgress:
            time.sleep(0.5)
        q.processAllAvailable()
        assert q.isActive
        got = streams.read_job_status(spark, path)
        assert got.count() == tb.job_runs(spark, SF_SMALL).select("job").distinct().count()
    finally:
        q.stop()


def test_streaming_positions_equal_batch_append(spark):
    """Message-channel positions kept live equal the batch fold (A7), also
    when the log arrives in several micro-batches."""
    import uuid

    from runfold.session import staging_root
    conv = tb.table(spark, SF_SMALL, "conversations")
    batch = state.state_append(conv, "conv_id", "turn", ["role", "text"])
    got = streams.streaming_positions(spark, SF_SMALL)
    cols = ["conv_id", "turn", "position"]
    assert _rows(got, cols) == _rows(batch, cols)
    # the same log split by turn into three files, one per micro-batch
    d = f"{staging_root(spark)}/conv-split-{uuid.uuid4().hex}"
    for i, (lo, hi) in enumerate([(0, 2), (2, 5), (5, 10 ** 9)]):
        conv.where((F.col("turn") >= lo) & (F.col("turn") < hi)).coalesce(1).write.parquet(f"{d}/part{i}")
    src = streams.parquet_stream(spark, d, conv.schema, "*.parquet", max_files=1, recursive=True)
    out = streams._append_sink(streams.streaming_positions_df(src, "conv_id", "turn", ["role", "text"]), "pos-split")
    assert _rows(spark.read.parquet(out), cols) == _rows(batch, cols)


def _polls(spark, *files):
    """A status log of one file per poll: (job, run, status)."""
    import datetime as dt
    import uuid

    from runfold.session import staging_root
    d = f"{staging_root(spark)}/polls-{uuid.uuid4().hex}"
    schema = "o_custkey long, o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string"
    for i, rows in enumerate(files):
        spark.createDataFrame([(j, r, dt.datetime(2024, 1, 1, 0, i), s) for j, r, s in rows], schema).coalesce(1).write.mode("append").parquet(d)
    return streams.parquet_stream(spark, d, spark.read.parquet(d).schema, max_files=1)


def test_polling_ends_by_itself(spark):
    """Three polls: a job that one left open is closed two polls later; then the query stops."""
    src = _polls(spark, [(1, 1, "O"), (2, 2, "O")], [(1, 1, "P")], [(2, 2, "F")])
    got, ended = streams.poll_to_end(streams.job_status_df(src), interval="1 second", wait_seconds=0.5, give_up_seconds=120)
    assert ended and {(r.job, r.latest_status, r.is_terminal) for r in got.collect()} == {(1, "SUCCEEDED", True), (2, "FAILED", True)}
    assert not [q for q in spark.streams.active if "poll-to-end" in str(q.lastProgress)]


def test_polling_goes_on_while_a_job_is_open(spark):
    src = _polls(spark, [(1, 1, "O"), (2, 2, "P")], [(2, 3, "P")])
    got, ended = streams.poll_to_end(streams.job_status_df(src), interval="1 second", wait_seconds=0.5, give_up_seconds=15)
    assert not ended and {(r.job, r.is_terminal) for r in got.collect()} == {(1, False), (2, True)}
