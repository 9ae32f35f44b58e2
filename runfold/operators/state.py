"""Run-state folds over an update log, and process mining on it.

The log has one row per finished node: ``session_id``, a total order ``seq``
(unique per session), the channel values of that update and ``has_*`` flags
that keep an *absent* key apart from a *present NULL*. Channel semantics:

* message list — append in order (A7);
* step / strategy / status / workspace / diagram / plan — last non-NULL,
  else the default (A8);
* environment map — shallow merge, later keys win (A9);
* validation errors — the last update *that has the key* wins, NULL included (A10);
* retry count — sum of increments; a present key with no value counts 1 (A11).

Final state per session is a plain ``groupBy`` of partial aggregates (map-side
combined, so a hot session costs no more than a cold one). Per-update running
state uses the bucketed scan in ``runfold.operators.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.constants import (DEFAULT_DIAGRAM, DEFAULT_STATUS, DEFAULT_STEP, DEFAULT_STRATEGY, DEFAULT_WORKSPACE, END,
                               EXECUTED_TASK_TEXT, MAX_RETRIES, START, WORKFLOW_EDGES)
from runfold.operators.scan import DEFAULT_WIDTH, Run, next_in_group, running

#: channel: value while no update has set it (diagram and plan are JSON texts)
LAST_NONNULL_DEFAULTS = {
    "current_step": DEFAULT_STEP,
    "execution_strategy": DEFAULT_STRATEGY,
    "deployment_status": DEFAULT_STATUS,
    "diagram": DEFAULT_DIAGRAM,
    "cloud_plan": None,
    "workspace_path": DEFAULT_WORKSPACE,
}


def _last_nonnull(col: str, seq: str) -> Column:
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(seq)))


def retry_increment(has_key: str = "has_retry", value: str = "retry_inc") -> Column:
    """``curr + (next ?? 1)`` for present keys, 0 for absent ones."""
    return F.when(F.col(has_key), F.coalesce(F.col(value), F.lit(1))).otherwise(F.lit(0))


# ------------------------------------------------------------------ A7
def state_append(log: DataFrame, key: str, seq: str, cols: list[str],
                 width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """The appended message channel as rows ``(key, position, cols…)``,
    position from 0 in ``seq`` order. Rows, not one growing array per key."""
    r = running(log.select(key, seq, *cols), [key], seq, [Run("__n", "count")], width, bucketed)
    return r.select(key, (F.col("__n") - 1).alias("position"), seq, *cols)


def state_append_array(log: DataFrame, key: str, seq: str, col: str) -> DataFrame:
    """A7 as one ordered array per key (only for keys known to be small)."""
    return log.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.col(col).alias("v")))),
                                            lambda x: x.getField("v")).alias(col))


# ------------------------------------------------------------------ A8
def state_last_nonnull(log: DataFrame, key: str = "session_id", seq: str = "seq",
                       defaults: dict[str, str] | None = None) -> DataFrame:
    """Per key, each channel's last non-NULL value, else its default."""
    return log.groupBy(key).agg(*_channels(log, seq, defaults or LAST_NONNULL_DEFAULTS))


def _channels(log: DataFrame, seq: str, defaults: dict[str, str | None] = LAST_NONNULL_DEFAULTS) -> list[Column]:
    """The last-non-NULL channels that the log has."""
    return [F.coalesce(_last_nonnull(c, seq), F.lit(d).cast("string")).alias(c) for c, d in defaults.items()
            if c in log.columns]


# ------------------------------------------------------------------ A9
def state_map_merge(log: DataFrame, key: str = "session_id", seq: str = "seq",
                    map_key: str = "map_key", map_value: str = "map_value") -> DataFrame:
    """Shallow merge as rows ``(key, map_key, map_value)``: the value of
    the latest update carrying that map key. (``map_concat`` would fail on a
    repeated key; folding rows scales and keeps later-wins.)"""
    return (log.where(F.col(map_key).isNotNull())
               .groupBy(key, map_key)
               .agg(F.max_by(F.col(map_value), F.col(seq)).alias(map_value)))


def state_map(merged: DataFrame, key: str = "session_id", map_key: str = "map_key",
              map_value: str = "map_value") -> DataFrame:
    """A9 as one MAP per key (for bounded key sets)."""
    return merged.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(map_key, map_value))).alias("context"))


# ------------------------------------------------------------------ A10
def state_overwrite(log: DataFrame, key: str = "session_id", seq: str = "seq",
                    col: str = "validation_errors", has_key: str = "has_validation_errors") -> DataFrame:
    """A10: the value of the last update that *has* the key, NULL included;
    NULL (the default) when no update had it. ``max_by`` keeps NULL values."""
    return log.groupBy(key).agg(F.max_by(F.col(col), F.when(F.col(has_key), F.col(seq))).alias(col))


# ------------------------------------------------------------------ A11
def state_counter(log: DataFrame, key: str = "session_id", has_key: str = "has_retry",
                  value: str = "retry_inc", out: str = "retry_count") -> DataFrame:
    """Sum of increments (present key without value = 1, absent = 0)."""
    return log.groupBy(key).agg(F.sum(retry_increment(has_key, value)).cast("bigint").alias(out))


def fold_state(log: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """A8 + A10 + A11 in one aggregation pass: the final run state per key."""
    return log.groupBy(key).agg(
        *_channels(log, seq),
        F.max_by(F.col("validation_errors"), F.when(F.col("has_validation_errors"), F.col(seq))).alias("validation_errors"),
        F.sum(retry_increment()).cast("bigint").alias("retry_count"))


# ------------------------------------------------------------------ W1
def running_state(log: DataFrame, key: str = "session_id", seq: str = "seq",
                  width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """The run state *after* each update (A8, A10, A11 as running folds)."""
    d = log.withColumn("__inc", retry_increment())
    channels = {c: dflt for c, dflt in LAST_NONNULL_DEFAULTS.items() if c in log.columns}
    runs = [Run("__" + c, "last_nonnull", c) for c in channels]
    runs += [Run("__ve", "last_where", "validation_errors", "has_validation_errors"),
             Run("__rc", "sum", "__inc")]
    r = running(d, [key], seq, runs, width, bucketed)
    return r.select(key, seq, "node",
                    *[F.coalesce(F.col("__" + c), F.lit(dflt).cast("string")).alias(c) for c, dflt in channels.items()],
                    F.col("__ve").alias("validation_errors"),
                    F.col("__rc").cast("bigint").alias("retry_count"))


# ------------------------------------------------------------------ W2
def route_expr(node: Column, status: Column, strategy: Column, retries: Column,
               max_retries: int = MAX_RETRIES) -> Column:
    """Next node from the state after ``node`` ran (fixed and conditional
    edges of the workflow graph)."""
    after_plan = (F.when(status == "FATAL_ERROR", F.lit(END))
                   .when(strategy == "DATA_ANALYSIS", F.lit("data-ops"))
                   .otherwise(F.lit("pipeline-coder")))
    after_deploy = (F.when(status == "FATAL_ERROR", F.lit(END))
                     .when((status == "FAILED") & (retries >= max_retries), F.lit(END))
                     .when(status == "FAILED", F.lit("pipeline-coder"))
                     .otherwise(F.lit("data-ops")))
    return (F.when(node == "architect", after_plan)
             .when(node == "deployer", after_deploy)
             .when(node == "pipeline-coder", F.lit("deployer"))
             .when(node == "data-ops", F.lit(END)))


def route_next(log: DataFrame, key: str = "session_id", seq: str = "seq",
               max_retries: int = MAX_RETRIES, width: int = DEFAULT_WIDTH,
               bucketed: bool = True) -> DataFrame:
    """For every update, the node the workflow routes to next."""
    rs = running_state(log, key, seq, width, bucketed)
    return rs.select(key, seq, "node",
                     route_expr(F.col("node"), F.col("deployment_status"), F.col("execution_strategy"),
                                F.col("retry_count"), max_retries).alias("next_node"))


# ------------------------------------------------------------------ W3
def retry_halt(log: DataFrame, key: str = "session_id", seq: str = "seq",
               max_retries: int = MAX_RETRIES, width: int = DEFAULT_WIDTH,
               bucketed: bool = True) -> DataFrame:
    """Per session, the first update at which counted failures reach the
    limit (the run halts there). Sessions that never halt are absent."""
    # rows that add nothing can't be the first to reach a limit
    d = log.select(key, seq, retry_increment().alias("__inc")).where(F.col("__inc") != 0)
    r = running(d, [key], seq, [Run("__rc", "sum", "__inc")], width, bucketed)
    return (r.where(F.col("__rc") >= max_retries)
             .groupBy(key).agg(F.min(seq).alias("halt_seq")))


# ------------------------------------------------------------------ J10 / W7
def transitions(log: DataFrame, key: str = "session_id", seq: str = "seq", node: str = "node",
                width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """Every step transition of every run, START and END included:
    ``(key, src_seq, src, dst_seq, dst)`` (``src_seq`` NULL for START,
    ``dst_seq`` NULL for END)."""
    n, firsts = next_in_group(log.select(key, seq, node), [key], seq, [node], width, bucketed, with_firsts=True)
    inner = n.select(key, F.col(seq).alias("src_seq"), F.col(node).alias("src"),
                     F.col("next_" + seq).alias("dst_seq"),
                     F.coalesce(F.col("next_" + node), F.lit(END)).alias("dst"))
    # START edges from each key's first row (from the per-bucket table, not a
    # second pass over the log)
    first = firsts.select(key, F.lit(None).cast(log.schema[seq].dataType).alias("src_seq"), F.lit(START).alias("src"),
                          F.col("first").getField(seq).alias("dst_seq"), F.col("first").getField(node).alias("dst"))
    return inner.unionByName(first)


def edge_table(spark) -> DataFrame:
    return spark.createDataFrame(WORKFLOW_EDGES, "src string, dst string")


def transition_conformance(log: DataFrame, edges: DataFrame, key: str = "session_id", seq: str = "seq",
                           node: str = "node", width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """Transitions the workflow graph does not allow (anti join to the
    edge table, which Spark broadcasts while it is small)."""
    t = transitions(log, key, seq, node, width, bucketed)
    return t.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def stage_edges(log: DataFrame, key: str = "session_id", seq: str = "seq", node: str = "node",
                width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """Directly-follows graph over all runs: ``(src, dst, n_transitions,
    n_runs)`` between neighbouring stages (START/END excluded)."""
    n = next_in_group(log.select(key, seq, node), [key], seq, [node], width, bucketed)
    e = n.where(F.col("next_" + node).isNotNull())
    return (e.groupBy(F.col(node).alias("src"), F.col("next_" + node).alias("dst"))
             .agg(F.count(F.lit(1)).alias("n_transitions"),
                  F.count_distinct(F.col(key)).alias("n_runs")))


def stage_nodes(log: DataFrame, key: str = "session_id", seq: str = "seq", node: str = "node",
                width: int = DEFAULT_WIDTH, bucketed: bool = True) -> DataFrame:
    """W7 node table: ``(key, position, stage)`` with positions from 1."""
    r = running(log.select(key, seq, node), [key], seq, [Run("position", "count")], width, bucketed)
    return r.select(key, "position", F.col(node).alias("stage"))


# ------------------------------------------------------------------ A14
def run_trace_summary(log: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """Per session: updates, updates with errors (red), last node and
    last step shown (a missing step shows as ``Processing``)."""
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(F.col("validation_errors").isNotNull()).alias("n_errors"),
        F.max_by(F.col("node"), F.col(seq)).alias("last_node"),
        F.max_by(F.coalesce(F.col("current_step"), F.lit("Processing")), F.col(seq)).alias("last_step"))


# ------------------------------------------------------------------ F10
def node_update(log: DataFrame, messages: str = "messages") -> DataFrame:
    """each update projected to the published fields; ``message`` is the
    text of the update's last message (a fixed text when it is not text, ''
    when the update has no message). ``diagram`` (JSON text) and the two code
    texts pass through when the log has them; code defaults to ''."""
    last = F.try_element_at(F.col(messages), F.lit(-1))
    msg = (F.when(F.coalesce(F.size(F.col(messages)), F.lit(0)) <= 0, F.lit(""))
            .when(last.getField("is_text"), last.getField("content"))
            .otherwise(F.lit(EXECUTED_TASK_TEXT)))
    cols = set(log.columns)
    diagram = F.col("diagram") if "diagram" in cols else F.lit(None).cast("string")
    pulumi = F.coalesce(F.col("code_pulumi"), F.lit("")) if "code_pulumi" in cols else F.lit("")
    pyspark = F.coalesce(F.col("code_pyspark"), F.lit("")) if "code_pyspark" in cols else F.lit("")
    return log.select("session_id", "seq", F.col("node"), F.col("deployment_status").alias("status"),
                      F.col("current_step").alias("step"), F.col("execution_strategy").alias("strategy"),
                      msg.alias("message"), F.col("validation_errors").alias("errors"),
                      diagram.alias("diagram"), pulumi.alias("code_pulumi"), pyspark.alias("code_pyspark"))


# ------------------------------------------------------------------ A12
def job_latest_status(runs: DataFrame, job: str = "job", ts: str = "ts", tiebreak: str = "run_id",
                      status: str = "status", terminal=("SUCCEEDED", "FAILED")) -> DataFrame:
    """Latest status per job (by ``(ts, tiebreak)``), first and last
    seen, processing seconds and whether the job reached a terminal state."""
    o = F.struct(F.col(ts), F.col(tiebreak))
    return (runs.groupBy(job)
                .agg(F.max_by(F.col(status), o).alias("latest_status"),
                     F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
                     F.count(F.lit(1)).alias("n_polls"))
                # whole seconds between wall-clock times, independent of the session time zone
                .withColumn("processing_seconds",
                            F.timestamp_diff("SECOND", F.col("first_seen"), F.col("last_seen")).cast("bigint"))
                .withColumn("is_terminal", F.col("latest_status").isin(*terminal)))
