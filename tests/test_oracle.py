"""Every query against its DuckDB oracle (same rows, columns, values)."""

import pytest

from runfold.plans import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, key):
    r = compare(spark, duck_small, key, SF_SMALL)
    assert r["ok"], r


def test_every_survey_key_registered():
    keys = """csv_scan csv_to_parquet text_line_scan object_listing resolve_source gated_write incremental_copy
    delete_by_key registry_flatten multi_read regex_grep binary_detect path_policy command_policy ignored_names
    role_filter_remap prefix_filter keyword_assert error_classify node_update tool_output_context allowlist_match
    permission_decision include_semi role_grants variable_resolution insert_if_absent remove_by_target
    ack_interval_join output_existence transition_conformance column_total high_value_summary pass_score
    tool_call_count storage_usage ordered_concat state_append state_last_nonnull state_map_merge state_overwrite
    state_counter job_latest_status validation_report run_trace_summary running_state route_next retry_halt rewind
    upsert_last_wins first_last_match stage_edges numbered_topk capped_matches registry_union llm_json_extract
    schema_contract json_remainder_summary truncate_with_length email_clean amount_date_clean namespaced_name
    uri_build_check layered_defaults path_parts conversation_format update_stream streaming_state
    poll_until_terminal stream_ack_join""".split()
    assert len(keys) == 70
    assert set(keys) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
