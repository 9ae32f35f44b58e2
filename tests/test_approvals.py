"""ST4 on ordered state: timers decide requests as the batch as-of join does."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runfold.operators import policy
from runfold.session import staging_root
from runfold.sources import tables as tb
from runfold.streaming import approvals, streams

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
BEGIN = datetime(2024, 1, 1)


def batch(spark, events):
    side = lambda kind, id_, ts: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(id_), "user_id", F.col("ts").alias(ts))
    return policy.ack_interval_join(side("click", "req_id", "req_ts"), side("purchase", "ans_id", "ans_ts"), "user_id", "req_id", "req_ts", "ans_id", "ans_ts")


def rows(df):
    return sorted((r.req_id, r.answer_id, str(r.answer_ts), r.decision) for r in df.collect())


def folder(spark, parts):
    """An events table of one file per part, in order of time of writing."""
    d = f"{staging_root(spark)}/ack-{uuid.uuid4().hex}"
    for p in parts:
        spark.createDataFrame([(i, BEGIN + timedelta(seconds=s), u, k, None, None) for i, s, u, k in p], EVENTS) \
            .coalesce(1).write.mode("append").parquet(d + "/events.parquet")
    return d


@pytest.mark.parametrize("seed", range(40))
def test_decide_by_hand(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 1]), i, rng.randrange(30)) for i in range(rng.randrange(25))]
    until = rng.randrange(40)
    done, left = approvals.decide(rows, until, 5)
    due = [(i, t) for k, i, t in rows if k == approvals.REQUEST and t + 5 <= until]
    want = []
    for i, t in due:
        hits = sorted((u, j) for k, j, u in rows if k == approvals.ANSWER and t <= u <= t + 5)
        want.append((i, t, *(hits[0][::-1] if hits else (None, None))))
    assert sorted(done) == sorted(want)
    assert sorted(left) == sorted([r for r in rows if r[0] == approvals.REQUEST and r[2] + 5 > until]
                                  + [r for r in rows if r[0] == approvals.ANSWER and r[2] > until - 5])


@pytest.mark.parametrize("slice_seconds", [300, 1000, approvals.SLICE_SECONDS])
def test_batches_in_time_order_equal_the_join(spark, slice_seconds):
    """Several micro-batches, slices cut through the time-out, rows of no user."""
    rng = random.Random(slice_seconds)
    events = sorted(((rng.randrange(6000), rng.choice([1, 1, 2, 3, None]), rng.choice(["click", "purchase", "view"])) for _ in range(300)),
                    key=lambda e: e[0])
    events = [(i, *e) for i, e in enumerate(events)]
    d = folder(spark, [events[:100], events[100:200], events[200:]])
    run = streams.approval_run(spark, d, max_files=1, watermark_seconds=60, slice_seconds=slice_seconds)
    run.run()
    some = run.decisions().count()
    run.drain(60)
    assert 0 < some < run.decisions().count() and run.late == 0
    assert rows(run.decisions()) == rows(batch(spark, spark.read.parquet(d + "/events.parquet")))


def test_late_rows_are_counted(spark):
    """A row behind the watermark of the batch before is left out and counted; one within
    it is not late."""
    d = folder(spark, [[(1, 0, 7, "click"), (2, 5000, 7, "purchase"), (3, 5000, 8, "click")], [(9, 5001, 9, "click")],
                       [(4, 10, 7, "purchase"), (5, 4990, 8, "click"), (6, 5010, 8, "purchase")]])
    run = streams.approval_run(spark, d, max_files=1, watermark_seconds=60)
    run.run()
    run.drain(60)
    at = str(BEGIN + timedelta(seconds=5010))
    assert run.late == 1
    assert rows(run.decisions()) == [(1, None, "None", "deny"), (3, 6, at, "allow"), (5, 6, at, "allow"), (9, None, "None", "deny")]


def test_an_answer_of_a_later_batch_that_is_earlier_wins(spark):
    d = folder(spark, [[(1, 100, 7, "click"), (2, 250, 7, "purchase")], [(3, 200, 7, "purchase")]])
    run = streams.approval_run(spark, d, max_files=1, watermark_seconds=600)
    run.run()
    run.drain(600)
    assert [(r.req_id, r.answer_id) for r in run.decisions().collect()] == [(1, 3)]


def test_marks_time_out_a_quiet_stream(spark):
    """Without an event, a mark lets the timer fire; what comes later is decided later."""
    d = folder(spark, [[(1, 0, 7, "click")]])
    run = streams.approval_run(spark, d, watermark_seconds=0)
    run.run()
    assert run.decisions().count() == 0
    run.mark(301)
    run.run()
    assert [(r.req_id, r.decision) for r in run.decisions().collect()] == [(1, "deny")]
    spark.createDataFrame([(2, BEGIN + timedelta(seconds=400), 7, "click", None, None), (3, BEGIN + timedelta(seconds=450), 7, "purchase", None, None)],
                          EVENTS).coalesce(1).write.mode("append").parquet(d + "/events.parquet")
    run.run()
    run.drain(0)
    assert [(r.req_id, r.answer_id) for r in run.decisions().orderBy("req_id").collect()] == [(1, None), (2, 3)]


def test_plan_has_no_join_and_reads_the_table_once(spark):
    events = tb.table(spark, "/root/testdata/sf0.001", "events")
    stream = streams.file_stream(spark, "/root/testdata/sf0.001", "events")
    marks = spark.readStream.schema("ts timestamp").parquet(staging_root(spark))
    df = approvals.approvals_df(stream, marks, F.col("event_type") == "click", F.col("event_type") == "purchase")
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and plan.count("TransformWithState") == 1 and events.columns[0] in plan


def test_empty_table(spark):
    d = folder(spark, [[]])
    assert streams.stream_ack_join(spark, d).count() == 0
