"""Bucketed (skew-safe) scans equal the plain window forms, and fold
properties hold (SURVEY §5 items 4-5)."""

from pyspark.sql import functions as F

from runfold.operators import policy, scan, state, text
from runfold.sources import tables as tb
from tests.conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_running_state_bucketed_equals_plain(spark):
    log = tb.state_log(spark, SF_SMALL)
    cols = ["session_id", "seq", "current_step", "execution_strategy", "deployment_status", "validation_errors",
            "retry_count"]
    a = state.running_state(log, width=7)             # many buckets per session
    b = state.running_state(log, bucketed=False)
    assert _rows(a, cols) == _rows(b, cols)


def test_next_in_group_bucketed_equals_plain(spark):
    log = tb.state_log(spark, SF_SMALL).select("session_id", "seq", "node")
    a = scan.next_in_group(log, ["session_id"], "seq", ["node"], width=5)
    b = scan.next_in_group(log, ["session_id"], "seq", ["node"], bucketed=False)
    cols = ["session_id", "seq", "next_node", "next_seq"]
    assert _rows(a, cols) == _rows(b, cols)


def test_ordered_concat_two_levels(spark):
    c = tb.table(spark, SF_SMALL, "conversations")
    a = text.ordered_concat(c, "conv_id", "turn", "text", width=2, whole=True)
    b = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                                          lambda x: x["text"]), "\n").alias("text"))
    assert _rows(a, ["conv_id", "text"]) == _rows(b, ["conv_id", "text"])


def test_last_running_row_equals_final_fold(spark):
    log = tb.state_log(spark, SF_SMALL)
    run = state.running_state(log, width=11)
    last = (run.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in run.columns if c != "session_id"]), "seq")
                                          .alias("r")).select("session_id", "r.*"))
    cols = ["session_id", "current_step", "execution_strategy", "deployment_status", "validation_errors",
            "retry_count"]
    assert _rows(last, cols) == _rows(state.fold_state(log), cols)


def test_fold_of_split_log_equals_fold_of_whole(spark):
    """Counter and last-wins channels combine over a split of the log."""
    log = tb.state_log(spark, SF_SMALL)
    mid = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    first, second = log.where(F.col("seq") <= mid), log.where(F.col("seq") > mid)
    whole = {r.session_id: r.retry_count for r in state.state_counter(log).collect()}
    parts = {}
    for part in (first, second):
        for r in state.state_counter(part).collect():
            parts[r.session_id] = parts.get(r.session_id, 0) + r.retry_count
    assert whole == parts


def test_rewind_twice_is_smaller_rewind(spark):
    c = tb.table(spark, SF_SMALL, "conversations")
    a = text.rewind(text.rewind(c, "conv_id", "turn", 4, width=3), "conv_id", "turn", 1, width=3)
    b = text.rewind(c, "conv_id", "turn", 1, bucketed=False)
    assert _rows(a, ["conv_id", "turn"]) == _rows(b, ["conv_id", "turn"])


def test_ack_join_equals_plain_range_join(spark):
    e = tb.table(spark, SF_SMALL, "events")
    req = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    ans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("aid"), "user_id", F.col("ts").alias("ats"))
    got = policy.ack_interval_join(req, ans, "user_id", "event_id", "ts", "aid", "ats")
    plain = (req.alias("r").join(ans.alias("a"), (F.col("r.user_id") == F.col("a.user_id"))
                                 & (F.col("a.ats") >= F.col("r.ts"))
                                 & (F.col("a.ats") <= F.col("r.ts") + F.expr("INTERVAL 300 SECONDS")))
                .groupBy("r.event_id").agg(F.min_by("a.aid", F.struct("a.ats", "a.aid")).alias("answer_id")))
    assert _rows(got.where("answer_id IS NOT NULL"), ["event_id", "answer_id"]) == _rows(plain, ["event_id", "answer_id"])


def test_ordered_concat_parts_rebuild_the_whole(spark):
    c = tb.table(spark, SF_SMALL, "conversations")
    parts = text.ordered_concat(c, "conv_id", "turn", "text", width=3)
    rebuilt = parts.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = text.ordered_concat(c, "conv_id", "turn", "text", whole=True)
    assert _rows(rebuilt, ["conv_id", "text"]) == _rows(whole, ["conv_id", "text"])
    assert parts.groupBy("conv_id", "part").count().where("count > 1").count() == 0


def test_cold_keys_have_no_summary_rows(spark):
    """Many keys with a global, sparse order: one piece each, nothing to stitch."""
    df = spark.range(20_000).selectExpr("id % 2000 AS k", "id * 10007 AS seq")
    assert scan.cut_keys(df, ["k"], F.col("seq"), 64) is None


def test_pieces_stay_near_the_width(spark):
    """A user with half of their rows within 300 s of a year, beside cold users and
    NULL: no piece is far above the width, and pieces are few."""
    width = 500
    rows = spark.range(100_000).selectExpr(
        "1 AS u", "CASE WHEN id % 2 = 0 THEN 15000000000000 + id * 3000 ELSE id * 315360000 END AS t")
    rows = rows.union(spark.range(3000).selectExpr("id % 100 + 2", "id * 1000")).union(spark.range(2000).selectExpr("NULL", "id"))
    d, named = scan.cut_keys(rows, ["u"], F.col("t"), width)
    sizes = d.groupBy("u", "__several", *named).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * width
    assert sum(r["__several"] for r in sizes) <= 3 * rows.count() / width
    assert all(r["__several"] == (r["u"] in (1, None)) for r in sizes)
    a = scan.running(rows.withColumn("one", F.lit(1)), ["u"], "t", [scan.Run("n", "sum", "one")], width=width)
    b = scan.running(rows.withColumn("one", F.lit(1)), ["u"], "t", [scan.Run("n", "sum", "one")], bucketed=False)
    assert a.agg(F.bit_xor(F.xxhash64("u", "t", "n")), F.count("*")).first() == b.agg(F.bit_xor(F.xxhash64("u", "t", "n")), F.count("*")).first()


def test_hot_key_is_split_across_buckets(spark):
    """One session holding almost every row: the bucketed fold equals the
    plain window, and no (key, bucket) window partition exceeds the width."""
    n, width = 20000, 256
    df = (spark.range(n).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.lit(1)).alias("k"),
                                F.col("id").alias("seq"),
                                F.when(F.col("id") % 13 == 0, F.col("id").cast("string")).alias("v"),
                                (F.col("id") % 3).alias("n")))
    runs = [scan.Run("last", "last_nonnull", "v"), scan.Run("s", "sum", "n"), scan.Run("c", "count")]
    a = scan.running(df, ["k"], "seq", runs, width=width)
    b = scan.running(df, ["k"], "seq", runs, bucketed=False)
    cols = ["k", "seq", "last", "s", "c"]
    assert _rows(a, cols) == _rows(b, cols)
    biggest = df.groupBy("k", F.expr(f"seq div {width}")).count().agg(F.max("count")).first()[0]
    assert biggest <= width


def test_rows_of_one_time_are_cut_by_the_rest_of_the_order(spark):
    """100,000 rows of one key at one time: pieces of at most 2 x width rows, and the scan
    equals the plain window."""
    width, n = 1000, 100_000
    df = spark.range(n).select(F.lit("u").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") % 2).cast("int").alias("kind"),
                               F.xxhash64("id").alias("id"), F.col("id").alias("v"))
    df = df.unionByName(df.limit(500).withColumn("k", F.lit("small")))
    d, named = scan.cut_keys(df, ["k"], [F.unix_micros("ts"), *scan.order_cuts(df, ["ts", "kind", "id"])], width)
    sizes = d.groupBy("k", *named).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * width and len(sizes) >= n // (2 * width)
    runs = [scan.Run("s", "sum", "v"), scan.Run("n", "count")]
    for down in (False, True):
        a = scan.running(df, ["k"], ["ts", "kind", "id"], runs, width=width, cut=F.unix_micros("ts"), descending=down)
        b = scan.running(df, ["k"], ["ts", "kind", "id"], runs, bucketed=False, descending=down)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_orders_of_all_kinds(spark):
    """Nulls, negative and far numbers, texts that share a prefix, times and doubles."""
    far = (1 << 62) + 5
    texts = [None, "", "a", "a\x00", "shared prefix of many", "shared prefix of more", "é", "\U0001d4b3" * 3]
    rows = [(1, t, w, x, i) for i, (t, w, x) in enumerate((t, w, x) for t in (None, -far, -1, 0, 7, far) for w in texts for x in (None, -1e300, 0.5, 2.0))]
    df = spark.createDataFrame(rows, "k int, t long, w string, x double, v long").repartition(4)
    runs = [scan.Run("s", "sum", "v")]
    for order in (["t", "w", "x"], ["w", "t", "x"], ["x", "t", "w"]):
        a, b = (scan.running(df, ["k"], order, runs, width=4, bucketed=cut) for cut in (True, False))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), order
    d, named = scan.cut_keys(df, ["k"], scan.order_cuts(df, ["t", "w", "x"]), 4)
    assert max(r["count"] for r in d.groupBy(*named).count().collect()) <= 8
