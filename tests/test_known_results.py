"""Results published for sf 0.01 in FIXTURES.md, reproduced."""

from pyspark.sql import functions as F

from runfold.plans import QUERIES
from tests.conftest import SF_MID


def test_llm_out_counts(spark):
    x = QUERIES["llm_json_extract"](spark, SF_MID)
    assert x.count() == 10000
    assert x.where("json_text IS NULL").count() == 1429
    assert x.agg(F.sum("k")).first()[0] == 427496


def test_click_purchase_matches(spark):
    a = QUERIES["ack_interval_join"](spark, SF_MID)
    assert a.count() == 2006 and a.where("answer_id IS NOT NULL").count() == 6


def test_grep_mail_lines(spark):
    assert QUERIES["regex_grep"](spark, SF_MID).count() == 12


def test_errors_over_users(spark):
    s = QUERIES["run_trace_summary"](spark, SF_MID)
    assert s.count() == 150 and s.agg(F.sum("n_errors")).first()[0] == 2014


def test_orders_over_threshold(spark):
    h = QUERIES["high_value_summary"](spark, SF_MID)
    assert h.agg(F.sum("n_orders")).first()[0] == 1493
