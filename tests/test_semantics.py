"""One small case per easy-to-get-wrong rule and per trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from runfold.constants import END, START
from runfold.operators import policy, registry, state, text


def _log(spark, rows):
    schema = ("session_id long, seq long, node string, current_step string, deployment_status string, "
              "execution_strategy string, has_validation_errors boolean, validation_errors string, "
              "has_retry boolean, retry_inc int")
    return spark.createDataFrame(rows, schema)


def test_routing_after_planning_and_deployment(spark):
    rows = [
        (1, 1, "architect", "planning", None, "DATA_ANALYSIS", False, None, False, None),
        (2, 1, "architect", "planning", None, "WHATEVER", False, None, False, None),
        (3, 1, "architect", "planning-failed", "FATAL_ERROR", None, True, "x", False, None),
        (4, 1, "deployer", "deploying-failed", "FAILED", None, True, "e", True, 1),
        (4, 2, "deployer", "deploying-failed", "FAILED", None, True, "e", True, 1),
        (4, 3, "deployer", "deploying-failed", "FAILED", None, True, "e", True, None),
        (5, 1, "deployer", "deployment-success", "SUCCESS", None, True, None, False, None),
    ]
    r = {(x.session_id, x.seq): x.next_node for x in state.route_next(_log(spark, rows)).collect()}
    assert r[(1, 1)] == "data-ops"
    assert r[(2, 1)] == "pipeline-coder"          # unknown strategy → code generation
    assert r[(3, 1)] == END
    assert r[(4, 1)] == "pipeline-coder" and r[(4, 2)] == "pipeline-coder"
    assert r[(4, 3)] == END                        # third counted failure halts
    assert r[(5, 1)] == "data-ops"


def test_counter_absent_vs_null(spark):
    rows = [(1, 1, "deployer", None, "FAILED", None, True, "w", False, None),   # empty workspace: no count
            (1, 2, "deployer", None, "FAILED", None, True, "p", True, 1),
            (1, 3, "deployer", None, "FAILED", None, True, "s", True, None)]    # present, no value → 1
    assert state.state_counter(_log(spark, rows)).first()["retry_count"] == 2
    assert state.retry_halt(_log(spark, rows), max_retries=2).first()["halt_seq"] == 3


def test_overwrite_keeps_null_and_last_nonnull_skips_it(spark):
    rows = [(1, 1, "deployer", "a", "FAILED", None, True, "boom", False, None),
            (1, 2, "pipeline-coder", None, None, None, True, None, False, None),
            (1, 3, "data-ops", None, None, None, False, None, False, None)]
    log = _log(spark, rows)
    assert state.state_overwrite(log).first()["validation_errors"] is None
    f = state.state_last_nonnull(log).first()
    assert f["current_step"] == "a" and f["deployment_status"] == "FAILED" and f["execution_strategy"] == "PENDING"


def test_transitions_start_end_and_edges(spark):
    rows = [(1, 1, "architect", None, None, None, False, None, False, None),
            (1, 2, "pipeline-coder", None, None, None, False, None, False, None),
            (1, 3, "data-ops", None, None, None, False, None, False, None),
            (2, 5, "pipeline-coder", None, None, None, False, None, False, None)]
    bad = state.transition_conformance(_log(spark, rows), state.edge_table(spark))
    got = sorted((r.session_id, r.src, r.dst) for r in bad.collect())
    assert got == [(1, "pipeline-coder", "data-ops"), (2, START, "pipeline-coder"), (2, "pipeline-coder", END)]


def test_allowlist_prefix_on_raw_text(spark):
    reqs = spark.createDataFrame([(1, "commands", "execute", "rmdir"), (2, "commands", "execute", "ls"),
                                  (3, "files", "write", "/w/a"), (4, "files", "write", "/w/ab")],
                                 "req_id long, category string, operation string, target string")
    rules = spark.createDataFrame([("commands", "rm", "all"), ("files", "/w/a", "write")],
                                  "category string, target string, operation string")
    assert sorted(r.req_id for r in policy.allowlist_match(reqs, rules).collect()) == [1, 3]
    # many more rules (and a plan without broadcasts) give the same answer
    more = rules.union(spark.range(300_000).selectExpr("'commands'", "concat('zz', id)", "'execute'"))
    assert sorted(r.req_id for r in policy.allowlist_match(reqs, more).collect()) == [1, 3]


@pytest.mark.parametrize("cmd,blocked,base,segment", [
    ("sudo x && ls", False, "ls", "ls"),
    ("cd /w && sudo rm", True, "sudo", "sudo rm"),
    ("pkill skillful", True, "pkill", "pkill skillful"),
    ("tool --output-format json", True, "tool", "tool --output-format json"),
    ("ls && ", False, "ls", "ls && "),
    (" ls -la", False, " ls -la", " ls -la"),
])
def test_command_policy(spark, cmd, blocked, base, segment):
    r = policy.command_policy(spark.createDataFrame([(cmd,)], "command string")).first()
    assert (r["blocked"], r["base_command"], r["segment"]) == (blocked, base, segment)


def test_command_policy_all_segments_option(spark):
    r = policy.command_policy(spark.createDataFrame([("sudo x && ls",)], "command string"), all_segments=True).first()
    assert r["blocked"]


@pytest.mark.parametrize("path,op,reason", [
    ("/w/distribution/x.py", "write", "Path is not within allowed directories."),
    ("/w/CodeSandBox/distribution/x.py", "write", "Path matches a blocked pattern."),
    ("/w/CodeSandBox/../../etc/passwd", "write", "Path traversal detected."),
    ("/w/..x", "write", "Path traversal detected."),
    ("CodeSandBox/a/../b.SH", "write", "File extension '.sh' is strictly prohibited."),
    ("/w/CodeSandBox/package.json", "delete", "File 'package.json' is read-only."),
    ("/w/CodeSandBox/package.json", "read", "File does not exist."),
    ("/w/CodeSandBox/run.py", "execute", "Direct execution disabled."),
    ("/w/CodeSandBox/.bashrc", "write", None),
])
def test_path_policy(spark, path, op, reason):
    df = spark.createDataFrame([(path, op)], "path string, operation string")
    existing = spark.createDataFrame([("/w/CodeSandBox/run.py",)], "path string")
    r = policy.path_policy(df, existing=existing).first()
    assert r["reason"] == reason and r["safe"] == (reason is None)


@pytest.mark.parametrize("path,ext,base,dir_", [
    ("/w/.bashrc", "", ".bashrc", "/w"),
    ("/w/x.tar.gz", ".gz", "x.tar.gz", "/w"),
    ("/w/a.", ".", "a.", "/w"),
    ("/w/..x", ".x", "..x", "/w"),
    ("/top", "", "top", "/"),
    ("rel/./a/../B.PY", ".py", "B.PY", "/w/rel"),
])
def test_path_parts(spark, path, ext, base, dir_):
    r = policy.path_parts(spark.createDataFrame([(path,)], "path string")).first()
    assert (r["ext"], r["base"], r["dir"]) == (ext, base, dir_)


def test_llm_json_extract_fences_and_greedy(spark):
    raws = [(1, "  <THINK>a</think>\n```json\n{\"strategy\": \"GREENFIELD\", \"plan\": \"p\"}\n```  "),
            (2, "```\n{\"a\": 1}\n``` then ```x``` {\"b\": 2}"),
            (3, "no json here"),
            (4, "Sure! {\"strategy\": \"DATA_ANALYSIS\"} Done.")]
    x = text.llm_json_extract(spark.createDataFrame(raws, "id long, raw string"))
    c = text.schema_contract(x, {"strategy": "string"}, {"strategy": ["GREENFIELD", "BROWNFIELD_ETL", "DATA_ANALYSIS"]})
    s = text.json_remainder_summary(c)
    r = {row.id: row for row in s.collect()}
    assert r[1].status == "ok" and r[1].strategy == "GREENFIELD"
    assert r[2].reason == "bad_json"           # greedy span joins two objects
    assert r[3].reason == "no_json" and r[3].summary is None
    assert r[4].summary.startswith("Sure!  Done.") and "`DATA_ANALYSIS`" in r[4].summary
    assert r[1].summary.startswith("I have successfully analyzed")


def test_js_trim_strips_newlines_and_tabs(spark):
    from runfold.functions.text import js_trim
    r = spark.createDataFrame([("\t\n x  \n",)], "s string").select(js_trim("s").alias("t")).first()
    assert r["t"] == "x"


def test_truncate_with_length(spark):
    r = spark.createDataFrame([("a" * 501,), ("b" * 500,)], "s string").select(
        text.F.col("s"), __import__("runfold.functions.text", fromlist=["x"]).truncate_with_length("s").alias("t")).collect()
    assert r[0]["t"] == "a" * 500 + "\n... [TRUNCATED, TOTAL LENGTH: 501]"
    assert r[1]["t"] == "b" * 500


def test_first_request_is_first_user_row(spark):
    rows = [(1, 0, "assistant", "greeting"), (1, 1, "user", "do it"), (1, 2, "assistant", "done"),
            (2, 0, "", ""), (2, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = {x.conv_id: x for x in text.first_last_match(df).collect()}
    assert r[1].first_request == "do it" and r[1].last_message == "done"
    alt = {x.conv_id: x for x in text.first_last_match(df, mode="first_nonempty_else_last").collect()}
    assert alt[1].first_request == "greeting" and alt[2].first_request == "x"


def test_insert_and_remove_rules(spark):
    existing = spark.createDataFrame([("commands", "ls", "execute", "t0")],
                                     "category string, target string, operation string, added_at string")
    new = spark.createDataFrame([("commands", "ls", "execute"), ("commands", "ls", "all"), ("commands", "ls", "all")],
                                "category string, target string, operation string")
    once = policy.insert_if_absent(existing, new, "t1")
    twice = policy.insert_if_absent(once, new, "t2")
    assert once.count() == 2 and sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    removed = policy.remove_by_target(twice, spark.createDataFrame([("commands", "ls")], "category string, target string"))
    assert removed.count() == 0                    # every operation of the target goes


def test_ack_join_earliest_within_timeout(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    req = spark.createDataFrame([(1, 7, t0), (2, 7, t0 + dt.timedelta(seconds=1000))], "rid long, u long, ts timestamp_ntz")
    ans = spark.createDataFrame([(10, 7, t0 + dt.timedelta(seconds=299)), (11, 7, t0 + dt.timedelta(seconds=100)),
                                 (12, 7, t0 + dt.timedelta(seconds=1301))], "aid long, u long, ats timestamp_ntz")
    r = {x.rid: x for x in policy.ack_interval_join(req, ans, "u", "rid", "ts", "aid", "ats").collect()}
    assert r[1].answer_id == 11 and r[1].decision == "allow"
    assert r[2].answer_id is None and r[2].decision == "deny"


def test_map_merge_repeated_keys_later_wins(spark):
    """Trap T4: folding rows never hits DUPLICATED_MAP_KEY."""
    log = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "z")],
                                "session_id long, seq long, map_key string, map_value string")
    m = state.state_map(state.state_map_merge(log)).first()["context"]
    assert m == {"a": "y", "b": "z"}


def test_role_grants(spark):
    tools = spark.createDataFrame([("x", "aws-data-processing_list_s3_buckets"), ("x", "aws-data-processing_upload_to_s3"),
                                   ("fs", "write_files"), ("x", "aws-api_call_aws")], "source string, name string")
    g = {(r.role, r.name) for r in registry.role_grants(tools, registry.role_rules(spark)).collect()}
    assert ("architect", "aws-data-processing_list_s3_buckets") in g
    assert ("architect", "aws-data-processing_upload_to_s3") not in g
    assert ("pipeline-coder", "aws-data-processing_upload_to_s3") in g
    assert ("data-ops", "write_files") not in g and ("pipeline-coder", "write_files") in g


def test_include_semi_empty_list_keeps_all(spark):
    offered = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1")], "server string, tool string")
    inc = spark.createDataFrame([("a", "t1")], "server string, tool string")
    kept, rep = registry.include_semi(offered, inc)
    assert sorted(map(tuple, kept.collect())) == [("a", "t1"), ("b", "t1")]
    assert {r.server: r.n_excluded for r in rep.collect()} == {"a": 1, "b": 0}


def test_variable_resolution(spark):
    e = spark.createDataFrame([("A", "$X"), ("B", "$Y"), ("C", "lit"), ("D", "$E")], "k string, value string")
    env = spark.createDataFrame([("X", "1"), ("E", "")], "name string, env_value string")
    r = {x.k: (x.resolved, x.unresolved) for x in registry.variable_resolution(e, env).collect()}
    assert r == {"A": ("1", False), "B": ("", True), "C": ("lit", False), "D": ("", True)}


def test_layered_defaults_replace_vs_merge(spark):
    dflt = [("pulumi", "backend", "cloud"), ("safety", "a", "1"), ("safety", "b", "2")]
    loaded = spark.createDataFrame([(1, "pulumi", "stack", "dev"), (1, "safety", "a", "9")],
                                   "tenant long, section string, key string, value string")
    tenants = spark.createDataFrame([(1,), (2,)], "tenant long")
    r = {(x.tenant, x.section, x.key): x.value for x in
         registry.layered_defaults(loaded, dflt, tenants, ["safety"]).collect()}
    assert (1, "pulumi", "backend") not in r and r[(1, "pulumi", "stack")] == "dev"
    assert r[(1, "safety", "a")] == "9" and r[(1, "safety", "b")] == "2"
    assert r[(2, "pulumi", "backend")] == "cloud"


def test_upsert_last_wins(spark):
    regs = spark.createDataFrame([("t", 1, "old"), ("t", 5, "new"), ("u", 2, "only")], "name string, seq long, v string")
    r = {x.name: (x.v, x.overwrites) for x in registry.upsert_last_wins(regs).collect()}
    assert r == {"t": ("new", 1), "u": ("only", 0)}


def test_join_text_blocks_keeps_text_only(spark):
    from runfold.functions.text import join_text_blocks
    df = spark.createDataFrame([([("text", "a"), ("image", "x"), ("text", "b")],)],
                               "blocks array<struct<type:string,text:string>>")
    assert df.select(join_text_blocks("blocks").alias("t")).first()["t"] == "a\nb"


def test_first_where_finds_first_python_file(spark):
    files = spark.createDataFrame([(1, 0, "__main__.py"), (1, 1, "README.md"), (1, 2, "etl_job.py"), (1, 3, "z.py"),
                                   (2, 0, "__main__.py")], "ws long, pos long, name string")
    cond = F.col("name").endswith(".py") & (F.col("name") != "__main__.py")
    r = {x.ws: x.first_match for x in text.first_where(files, "ws", "pos", cond, "name").collect()}
    assert r == {1: "etl_job.py", 2: None}


def test_ansi_bad_text_becomes_null_not_failure(spark):
    """Trap T5: ANSI is on; cleaning uses try_ casts, so bad rows survive as NULL."""
    from runfold.operators import clean as cl
    df = spark.createDataFrame([("1", " 12.50 ", "2024-02-30"), ("2", "abc", "2024-01-05")],
                               "id string, amount string, date string")
    r = {x.id: x for x in cl.clean_amount_date(df).collect()}
    assert str(r["1"].amount) == "12.50" and r["1"].date is None
    assert r["2"].amount is None and str(r["2"].date) == "2024-01-05"


def test_rewind_array(spark):
    from runfold.functions.text import rewind_array
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "h array<string>")
    assert df.select(rewind_array("h", 1).alias("r")).first()["r"] == ["a", "b"]


def test_allowlist_repeated_rows_shared_keys_and_nulls(spark):
    """One rule or 300,000: repeated requests stay repeated, requests that share an
    id are judged by their own target, NULL keys are judged like others."""
    rows = [(1, "commands", "execute", "rmdir")] * 3 + [(2, "commands", "execute", "rm x"), (2, "commands", "execute", "ls"),
            (None, "commands", "execute", "rm"), (4, "commands", None, "rm"), (5, None, "execute", "rm"), (6, "commands", "execute", None)]
    reqs = spark.createDataFrame(rows, "req_id long, category string, operation string, target string")
    one = spark.createDataFrame([("commands", "rm", "all")], "category string, target string, operation string")
    many = one.union(spark.range(300_000).selectExpr("'commands'", "concat('zz', id)", "'execute'"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for rules, threshold in ((one, old), (many, old), (many, "-1")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            kept = sorted(str(tuple(r)) for r in policy.allowlist_match(reqs, rules).collect())
            flags = [tuple(r) for r in policy.allowlist_flag(reqs, rules).collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert kept == sorted(str(r) for r in rows[:4] + [rows[5], rows[6]])
        assert sorted(map(str, flags)) == sorted(str((*r, r in rows[:4] + [rows[5], rows[6]])) for r in rows)


def test_permission_replay_with_timeout(spark):
    t = dt.datetime(2024, 1, 1)
    sec = lambda n: t + dt.timedelta(seconds=n)
    reqs = spark.createDataFrame([(i, "commands", "execute", "x", t, i != 6) for i in range(1, 7)] + [(7, "commands", "execute", "x", t, None)],
                                 "req_id long, category string, operation string, target string, at timestamp_ntz, live boolean")
    rules = spark.createDataFrame([], "category string, target string, operation string")
    answers = spark.createDataFrame([(1, "allow_once", sec(300)), (2, "allow_once", sec(301)), (3, "deny", sec(9)), (3, "allow_once", sec(10)),
                                     (4, "allow_always", sec(-1)), (6, "allow_once", sec(1)), (7, "allow_once", sec(1))],
                                    "req_id long, answer string, given timestamp_ntz")
    got = {r.req_id: r.reason for r in policy.permission_decision(reqs, rules, answers, has_session="live", req_ts="at", ans_ts="given").collect()}
    assert got == {1: "allow_once", 2: "timeout", 3: "denied", 4: "timeout", 5: "timeout", 6: "no_session", 7: "no_session"}


def test_contract_takes_no_other_types(spark):
    raws = [(1, '{"k": "12"}'), (2, '{"k": 1.7}'), (3, '{"k": true}'), (4, '{"k": 12}'), (5, '{"s": {"a": 1}}'), (6, '{"s": "x"}')]
    x = text.llm_json_extract(spark.createDataFrame(raws, "id long, raw string"))
    k = {r.id: (r.k, r.reason) for r in text.schema_contract(x, {"k": "bigint"}).collect()}
    assert [k[i] for i in (1, 2, 3, 4)] == [(None, "type:k")] * 3 + [(12, None)]
    s = {r.id: (r.s, r.reason) for r in text.schema_contract(x, {"s": "string"}).collect()}
    assert s[5] == (None, "type:s") and s[6] == ("x", None)


def test_no_summary_of_invalid_json(spark):
    raws = [(1, '{"strategy": "GREENFIELD",}'), (2, '{"strategy": null}'), (3, '{"a": 1}')]
    s = {r.id: r.summary for r in text.json_remainder_summary(text.llm_json_extract(spark.createDataFrame(raws, "id long, raw string"))).collect()}
    assert s[1] is None and "`null`" in s[2] and "`undefined`" in s[3]


def test_null_tool_texts_and_results(spark):
    from runfold.operators import reports
    c = spark.createDataFrame([(1, 0, "tool", None), (2, 0, "tool", "a"), (2, 1, "tool", None), (3, 0, "user", "x")],
                              "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.context for r in text.tool_output_context(c, F.col("role") == "tool").collect()}
    assert got == {1: "[Discovery Tool Output]: null", 2: "[Discovery Tool Output]: a\n[Discovery Tool Output]: null",
                   3: "No infrastructure discovered."}
    r = reports.pass_score(spark.createDataFrame([("s", True), ("s", None)], "suite string, success boolean"), "suite").first()
    assert (r["passed"], r["total"], r["all_passed"]) == (1, 2, False)


def test_settings_update_cannot_touch_safety(spark):
    cur = spark.createDataFrame([(1, "safety", "blockedCommands", "[x]"), (1, "allowList", "files", "[a]"), (1, "allowList", "mcp", "[b]"),
                                 (1, "pulumi", "backend", "cloud"), (2, "version", "version", "1")], "tenant long, section string, key string, value string")
    req = spark.createDataFrame([(1, "safety", "blockedCommands", "[]"), (1, "allowList", "files", "[]"), (1, "pulumi", "stack", "dev"),
                                 (2, "version", "version", "9")], "tenant long, section string, key string, value string")
    got = {(r.tenant, r.section, r.key): r.value for r in registry.settings_update(cur, req).collect()}
    assert got == {(1, "safety", "blockedCommands"): "[x]", (1, "allowList", "files"): "[]", (1, "pulumi", "backend"): "cloud",
                   (1, "pulumi", "stack"): "dev", (2, "version", "version"): "1"}


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from runfold import session

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("a folder was chosen")

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        fake = type("S", (), {"conf": Conf(), "sparkContext": Context(master)})()
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.staging_root(fake)
    assert session.staging_root(spark)


def test_gated_write_writes_the_allowed_batches(spark):
    from runfold.session import staging_path
    from runfold.sources.versions import VersionedTable
    rows = [(i, f"/w/CodeSandBox/f{i}.csv", "good") for i in range(20)] + [(99, "/etc/x", "bad"), (98, "/w/CodeSandBox/ok.csv", "bad")]
    dst = staging_path(spark, "t-gated")
    df = spark.createDataFrame(rows, "id long, path string, batch string").repartition(5)
    report = {r.batch: r.status for r in policy.gated_write(df, "batch", "id", dst).collect()}
    assert report == {"good": "written", "bad": "refused"}
    got = VersionedTable(spark, dst, "batch").read()
    assert {r.id for r in got.collect()} == set(range(20)) and len([f for f in got.inputFiles() if "/data/" in f]) == 1


def test_allowlist_flag_few_and_many_rules_agree(spark):
    reqs = spark.createDataFrame([(1, "commands", "execute", "rmdir"), (2, "commands", "execute", "ls"),
                                  (3, "files", "write", "/w/a"), (4, "files", "read", "/w/a")],
                                 "req_id long, category string, operation string, target string")
    rules = spark.createDataFrame([("commands", "rm", "all"), ("files", "/w/a", "write")],
                                  "category string, target string, operation string")
    small = {r.req_id: r.allowlisted for r in policy.allowlist_flag(reqs, rules).collect()}
    more = rules.union(spark.range(300_000).selectExpr("'commands'", "concat('zz', id)", "'execute'"))
    large = {r.req_id: r.allowlisted for r in policy.allowlist_flag(reqs, more).collect()}
    assert small == large == {1: True, 2: False, 3: True, 4: False}


def test_repeated_json_keys_last_wins(spark):
    df = spark.createDataFrame([(1, 'x {"strategy": "GREENFIELD", "strategy": "DATA_ANALYSIS"} y')], "id long, raw string")
    r = text.schema_contract(text.llm_json_extract(df), {"strategy": "string"}).first()
    assert r["status"] == "ok" and r["strategy"] == "DATA_ANALYSIS"


def test_split_contract(spark):
    raws = [(1, '{"strategy": "GREENFIELD"}'), (2, "nothing"), (3, '{"strategy": "OTHER"}')]
    x = text.llm_json_extract(spark.createDataFrame(raws, "id long, raw string"))
    good, bad = text.split_contract(text.schema_contract(x, {"strategy": "string"},
                                                         {"strategy": ["GREENFIELD", "BROWNFIELD_ETL", "DATA_ANALYSIS"]}))
    assert [r.id for r in good.collect()] == [1]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(2, "no_json"), (3, "enum:strategy")]


def test_csv_multi_line_fields(spark, tmp_path):
    from runfold.sources import files
    d = tmp_path / "ml"
    d.mkdir()
    (d / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    rows = {r.id: r.note for r in files.csv_scan(spark, str(d), columns=["id", "note"], multi_line=True).collect()}
    assert rows == {"1": "two\nlines", "2": "plain"}


def test_contract_missing_vs_wrong_type(spark):
    raws = [(1, '{"a": 1}'), (2, '{"k": "x"}'), (3, '{"k": null}'), (4, '{"k": 7}')]
    x = text.llm_json_extract(spark.createDataFrame(raws, "id long, raw string"))
    r = {row.id: row.reason for row in text.schema_contract(x, {"k": "bigint"}).collect()}
    assert r == {1: "missing:k", 2: "type:k", 3: "type:k", 4: None}


def test_a_session_without_a_diagram_has_the_empty_one(spark):
    log = spark.createDataFrame([("s", 1, None), ("t", 1, None), ("t", 2, '{"nodes":[1]}')], "session_id string, seq long, diagram string")
    got = {r.session_id: r.diagram for r in state.state_last_nonnull(log, defaults={"diagram": state.LAST_NONNULL_DEFAULTS["diagram"]}).collect()}
    assert got == {"s": '{"nodes":[],"edges":[]}', "t": '{"nodes":[1]}'}


def test_settings_of_a_section_with_many_keys(spark):
    """30,000 keys of one section: one row per key, no arrays in the plan."""
    cur = spark.range(30_000).selectExpr("'t' tenant", "'preferences' section", "concat('k', id) key", "'old' value")
    req = spark.range(15_000).selectExpr("'t' tenant", "'preferences' section", "concat('k', id * 2) key", "'new' value") \
        .union(spark.sql("SELECT 't', 'allowList', 'a', 'new'"))
    cur = cur.union(spark.sql("SELECT 't', 'allowList', k, 'old' FROM VALUES ('a'), ('b'), (NULL) AS x(k)"))
    got = registry.settings_update(cur, req)
    counts = {(r.section, r.value): r["count"] for r in got.groupBy("section", "value").count().collect()}
    assert counts == {("preferences", "old"): 15_000, ("preferences", "new"): 15_000, ("allowList", "new"): 1}
    assert "collect_list" not in got._jdf.queryExecution().toString()
