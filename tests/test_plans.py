"""Plan-shape checks: filters and projections reach the scan, broadcasts only
on fixed small tables, and the skew-safe operators keep their shape."""

import contextlib
import io

from pyspark.sql import functions as F

from runfold.operators import policy
from runfold.plans import QUERIES
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_prefix_filter_pushed_to_parquet(spark):
    p = plan(QUERIES["prefix_filter"](spark, SF_SMALL))
    assert "StringStartsWith(s_name,Supplier#0000000)" in p


def test_high_value_summary_prunes_and_pushes(spark):
    p = plan(QUERIES["high_value_summary"](spark, SF_SMALL))
    assert "GreaterThan(o_totalprice,450000.0)" in p
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in p


def test_ack_join_pushes_event_type_and_forms_no_pairs(spark):
    p = plan(QUERIES["ack_interval_join"](spark, SF_SMALL))
    assert "EqualTo(event_type,click)" in p and "EqualTo(event_type,purchase)" in p
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_role_grants_joins_on_equalities(spark):
    p = plan(QUERIES["role_grants"](spark, SF_SMALL))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_include_filter_never_joins_the_raw_list_on_the_server_alone(spark):
    """Without broadcasts: the list's side of a join on the server is its distinct
    servers, and the joins are semi and anti joins (AQE splits their skew)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES["include_semi"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ExistenceJoin" not in p and "LeftAnti" in p and "LeftSemi" in p and "HashAggregate" in p


def test_rule_table_uses_equi_semi_join(spark):
    reqs = spark.createDataFrame([(1, "commands", "execute", "rmdir")],
                                 "req_id long, category string, operation string, target string")
    rules = spark.createDataFrame([("commands", "rm", "all")], "category string, target string, operation string")
    p = plan(policy.allowlist_match(reqs, rules))
    assert "NestedLoopJoin" not in p


def test_running_state_shuffles_rows_once_by_session_and_piece(spark):
    from runfold.operators import state
    from runfold.sources import tables as tb
    p = plan(QUERIES["running_state"](spark, SF_SMALL))
    assert "hashpartitioning(session_id" in p and "Join" not in p         # no session has several pieces
    # with sessions cut in pieces, no window that folds rows is keyed by the session alone
    p = plan(state.running_state(tb.state_log(spark, SF_SMALL), width=4))
    assert "SortMergeJoin" not in p
    assert "__piece0" in p and "Window" in p


def test_object_listing_does_not_read_content(spark):
    from runfold.sources import files
    p = plan(files.object_listing(spark, SF_SMALL, "*.parquet"))
    assert "content" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_numbered_topk_is_take_ordered(spark):
    p = plan(QUERIES["numbered_topk"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_csv_money_is_never_double(spark):
    """Money is stored, summed and returned as DECIMAL."""
    assert dict(QUERIES["column_total"](spark, SF_SMALL).dtypes)["total"] == "decimal(38,2)"
    from runfold.operators import clean
    from runfold.plans.bindings import RAW_CUSTOMER_COLUMNS
    from runfold.session import staging_path
    from runfold.sources import files, tables as tb
    src = files.write_csv(tb.raw_customers(spark, SF_SMALL), staging_path(spark, "t-raw"))
    dst = staging_path(spark, "t-clean")
    df = clean.csv_to_parquet(spark, src, dst, RAW_CUSTOMER_COLUMNS)
    assert dict(df.dtypes)["amount"] == "decimal(18,2)"
    assert dict(spark.read.parquet(dst).dtypes)["amount"] == "decimal(18,2)"
    tot = clean.column_total(tb.table(spark, SF_SMALL, "lineitem"), "l_extendedprice")
    assert dict(tot.dtypes)["total"] == "decimal(38,2)"
    assert tot.where(F.col("total").isNull()).count() == 0


def test_no_plan_uses_a_cartesian_product_or_single_partition_window(spark):
    for key in ["transition_conformance", "stage_edges", "route_next", "rewind", "state_append", "role_grants",
                "layered_defaults", "numbered_topk", "capped_matches", "tool_output_context"]:
        p = plan(QUERIES[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p, key
        # role_grants gathers one row per task there: the set of rule lengths, no rows of a table
        assert "SinglePartition" not in p or key in ("numbered_topk", "capped_matches", "role_grants"), key
        assert key != "role_grants" or "Window" not in p


def test_size_shuffles(spark):
    from runfold.session import size_shuffles
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10 * (256 << 20) + 1) == 11
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
