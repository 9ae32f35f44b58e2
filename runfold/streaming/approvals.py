"""Requests and answers on one stream, decided on ordered state with event-time timers.

Rows are keyed by user and slice of event time; an answer within the time-out of a
slice's begin goes to the slice before it, too, so each slice decides its own requests
alone and a user of very many rows is spread over as many tasks as there are slices. The
state of a key is the list of its open requests and of the answers that may still serve
them. A timer stands at the earliest time-out: once the watermark has passed it, no
earlier answer can come, and every request that has timed out is decided from the answers
in time order, with the earliest one at or after it, or denied. No pairs are formed and no
table is read again.

Rows behind the watermark are left out and counted (``late_rows``). A control folder is
read beside the events: a file with one time in it moves the watermark on where no event
does. That closes what is open when a finite run ends, and lets a quiet stream time out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from runfold.constants import ACK_TIMEOUT_SECONDS
from runfold.session import staging_path

REQUEST, ANSWER, MARK = 0, 1, 2
#: Event time per key; a hot user's rows are held for this long and the time-out.
SLICE_SECONDS = 30 * 86400
NULL_KEYS = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "req_id long, req_user long, req_ts timestamp, answer_id long, answer_ts timestamp, decision string"
STATE = "kind int, id long, us long"
DECISION = Row("req_id", "req_user", "req_us", "answer_id", "answer_us", "decision")


def decide(rows: list[tuple[int, int, int]], until: int, timeout: int) -> tuple[list[tuple], list[tuple]]:
    """``rows`` (kind, id, time): decisions (request, time, answer, its time) of all
    requests that have timed out at ``until``, and the rows that stay open."""
    answers = sorted((us, id_) for kind, id_, us in rows if kind == ANSWER)
    requests = [(us, id_) for kind, id_, us in rows if kind == REQUEST]
    done = []
    for us, id_ in sorted(r for r in requests if r[0] + timeout <= until):
        i = bisect_left(answers, (us,))
        hit = answers[i] if i < len(answers) and answers[i][0] <= us + timeout else (None, None)
        done.append((id_, us, hit[1], hit[0]))
    left = [(REQUEST, id_, us) for us, id_ in requests if us + timeout > until]
    # an answer still serves the requests up to its time, open or yet to come
    return done, left + [(ANSWER, id_, us) for us, id_ in answers if us > until - timeout]


class Approvals(StatefulProcessor):
    """Per key: the open rows, and the time of the timer that stands."""

    def __init__(self, timeout_seconds: int) -> None:
        self.timeout = timeout_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.kind, r.id, r.us) for r in rows if r.kind != MARK]
        if new:
            self.rows.appendList(new)
            self._stand(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        done, left = decide(list(map(tuple, self.rows.get())), timerValues.getCurrentWatermarkInMs() * 1000, self.timeout)
        if left:
            self.rows.put(left)
            self._stand(left)
        else:
            self.rows.clear()
        user = key[0]
        for id_, us, answer, answer_us in done:
            hit = answer is not None and user is not None
            yield DECISION(id_, user, us, answer if hit else None, answer_us if hit else None, "allow" if hit else "deny")

    def close(self) -> None:
        pass

    def _stand(self, rows: list[tuple]) -> None:
        """The timer at the earliest time-out; rows without a request need it too, to go."""
        due = -(-(min(us for _, _, us in rows) + self.timeout) // 1000)
        stands = self.timer.get()[0] if self.timer.exists() else None
        if stands is None or due < stands:
            if stands is not None:
                self.handle.deleteTimer(stands)
            self.handle.registerTimer(due)
            self.timer.update((due,))


def keyed(events: DataFrame, marks: DataFrame, request: Column, answer: Column, user: str, id_col: str, ts: str, timeout_seconds: int,
          slice_seconds: int) -> DataFrame:
    """Requests, answers and marks as one stream: ``user``, ``slice``, ``salt``, ``kind``,
    ``id``, ``ts``, ``us``."""
    at = F.col(ts).cast("timestamp")
    kind = F.when(request, REQUEST).when(answer, ANSWER)
    rows = events.select(F.col(user).alias("user"), F.col(id_col).alias("id"), at.alias("ts"), kind.alias("kind")).filter("kind IS NOT NULL AND ts IS NOT NULL")
    rows = rows.unionByName(marks.select(F.lit(None).cast("long").alias("user"), F.lit(None).cast("long").alias("id"),
                                         F.col("ts").cast("timestamp").alias("ts"), F.lit(MARK).alias("kind")))
    us = F.unix_micros("ts")
    width = slice_seconds * 1_000_000
    own = F.floor(us / width).cast("long")
    before = F.floor((us - timeout_seconds * 1_000_000) / width).cast("long")
    slices = F.when(F.col("kind") == ANSWER, F.array_distinct(F.array(own, before))).otherwise(F.array(own))
    salt = F.when(F.col("user").isNull(), F.pmod(F.xxhash64("id"), F.lit(NULL_KEYS))).otherwise(F.lit(0).cast("long"))
    return rows.select("user", F.explode(slices).alias("slice"), salt.alias("salt"), "kind", "id", "ts", us.alias("us"))


def approvals_df(events: DataFrame, marks: DataFrame, request: Column, answer: Column, user: str = "user_id", id_col: str = "event_id",
                 ts: str = "ts", watermark: str = "10 minutes", timeout_seconds: int = ACK_TIMEOUT_SECONDS,
                 slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The decisions on the requests of a stream of events, in ``DECIDED`` form."""
    rows = keyed(events, marks, request, answer, user, id_col, ts, timeout_seconds, slice_seconds).withWatermark("ts", watermark)
    out = rows.groupBy("user", "slice", "salt").transformWithState(
        Approvals(timeout_seconds), "req_id long, req_user long, req_us long, answer_id long, answer_us long, decision string", "Append", "EventTime")
    return out.select("req_id", "req_user", F.timestamp_micros("req_us").alias("req_ts"), "answer_id",
                      F.timestamp_micros("answer_us").alias("answer_ts"), "decision")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class ApprovalRun:
    """A stream of decisions in a folder, with its control folder and checkpoint. Runs
    may follow one another: each goes on where the last one ended."""

    def __init__(self, spark: SparkSession, make, name: str = "approvals") -> None:
        """``make(marks)``: the stream of decisions, given that of control marks."""
        self.spark, self.make = spark, make
        self.out, self.control, self.checkpoint = (staging_path(spark, f"{name}{x}") for x in ("", "-control", "-ckpt"))
        spark.createDataFrame([], "ts timestamp").write.parquet(self.control)
        self.late = 0
        self.newest: str | None = None

    def start(self, trigger: dict):
        marks = self.spark.readStream.schema("ts timestamp").parquet(self.control)
        with rocksdb(self.spark):
            return (self.make(marks).writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint)
                    .outputMode("append").trigger(**trigger).start())

    def run(self) -> None:
        """All that is there now."""
        q = self.start({"availableNow": True})
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        self.note(q)

    def note(self, q) -> None:
        self.late += late_rows(q)
        seen = [p["eventTime"]["max"] for p in q.recentProgress if "max" in (p.get("eventTime") or {})]
        self.newest = max([*seen, *([self.newest] if self.newest else [])], default=None)

    def mark(self, seconds: int) -> None:
        """Say that event time has come ``seconds`` beyond the newest event."""
        if self.newest is not None:
            at = F.lit(self.newest).cast("timestamp") + F.lit(timedelta(seconds=seconds))
            self.spark.range(1).select(at.alias("ts")).write.mode("append").parquet(self.control)

    def drain(self, watermark_seconds: int, timeout_seconds: int = ACK_TIMEOUT_SECONDS) -> None:
        """Close what is open: no event will come any more."""
        self.mark(watermark_seconds + timeout_seconds + 1)
        self.run()

    def to_end(self, watermark_seconds: int, timeout_seconds: int = ACK_TIMEOUT_SECONDS) -> None:
        """``run`` and ``drain`` in one query, which is not planned and started twice."""
        q = self.start({"processingTime": "0 seconds"})
        try:
            q.processAllAvailable()
            self.note(q)
            self.mark(watermark_seconds + timeout_seconds + 1)
            q.processAllAvailable()
        finally:
            q.stop()

    def decisions(self) -> DataFrame:
        return self.spark.read.schema(DECIDED).parquet(self.out)


def late_rows(q) -> int:
    """Rows of a query's batches that came behind the watermark and were left out."""
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
