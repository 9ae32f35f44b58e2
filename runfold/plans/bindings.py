"""One callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every binding reads the driver tables (or data Spark derives from them) in
full: no id subsets, no sampling, no row caps beyond the operator's own
feature (top-k, capped search). Column names match ``runfold.plans.oracle``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.constants import (ALLOWED_PATHS, BLOCKED_COMMANDS, BLOCKED_PATTERNS, NOT_ALLOWED_EXTENSIONS,
                               READ_ONLY_FILES)
from runfold.operators import clean, policy, registry, reports, search_index, state, storage, text
from runfold.session import staging_path
from runfold.sources import files, tables as tb
from runfold.sources.kept import KeptTable
from runfold.sources.versions import VersionedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


RAW_CUSTOMER_COLUMNS = ["id", "customer_email", "amount", "c_nationkey"]


# ============================================================ clean and load
@q("csv_scan")
def csv_scan(spark, sf):
    dst = files.write_csv(tb.raw_customers(spark, sf), staging_path(spark, "raw_customers_csv"))
    return files.csv_scan(spark, dst, columns=RAW_CUSTOMER_COLUMNS)


@q("csv_to_parquet")
def csv_to_parquet(spark, sf):
    src = files.write_csv(tb.raw_customers(spark, sf), staging_path(spark, "raw_customers_csv"))
    return clean.csv_to_parquet(spark, src, staging_path(spark, "customers_clean"),
                                RAW_CUSTOMER_COLUMNS, casts={"id": "bigint", "c_nationkey": "int"})


def _loaded(spark, sf):
    """S2 over the customers' lines: the clean table's folder and the quarantine's."""
    src, dst, bad = (staging_path(spark, n) for n in ("customer-lines", "customers-loaded", "customers-quarantine"))
    tb.raw_customer_lines(spark, sf).write.text(src)
    clean.csv_to_parquet(spark, src, dst, RAW_CUSTOMER_COLUMNS, casts={"id": "bigint", "c_nationkey": "int"},
                         partition_by=["c_nationkey"], quarantine=bad, header=False)
    return dst, bad


@q("csv_load_checked")
def csv_load_checked(spark, sf):
    """S2 with malformed lines set apart: the rows that were loaded."""
    return spark.read.parquet(_loaded(spark, sf)[0])


@q("csv_quarantine")
def csv_quarantine(spark, sf):
    """The malformed lines, whole."""
    return spark.read.parquet(_loaded(spark, sf)[1]).select("line", "n_fields", "reason", "fields.id", "fields.c_nationkey")


@q("email_clean")
def email_clean(spark, sf):
    return clean.clean_email(tb.raw_customers(spark, sf)).select("id", "customer_email", "email_valid")


@q("amount_date_clean")
def amount_date_clean(spark, sf):
    return clean.clean_amount_date(tb.raw_orders(spark, sf)).select("id", "amount", "date")


@q("column_total")
def column_total(spark, sf):
    return clean.column_total(tb.table(spark, sf, "lineitem"), "l_extendedprice")


@q("high_value_summary")
def high_value_summary(spark, sf):
    return clean.high_value_summary(tb.table(spark, sf, "orders"), tb.table(spark, sf, "customer"))


@q("validation_report")
def validation_report(spark, sf):
    c = clean.clean_amount_date(clean.clean_email(tb.raw_customers(spark, sf)), "amount", None)
    cust = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("job"), "c_nationkey")
    runs = tb.job_runs(spark, sf).join(cust, "job")
    return clean.validation_report(c, "c_nationkey", runs=runs)


@q("validation_report_outputs")
def validation_report_outputs(spark, sf):
    """A13 over a load: malformed lines are counted, and each nation (and one more per
    nation that was never loaded) is expected as a folder of the loaded files (J9)."""
    dst, bad = _loaded(spark, sf)
    nation = "c_nationkey"
    n = F.col("n_nationkey").cast("int")
    expected = tb.table(spark, sf, "nation").select(F.explode(F.array(n, n + 25)).alias(nation))
    folder = F.regexp_extract("path", f"{nation}=([0-9]+)/[^/]*$", 1).try_cast("int")
    outputs = storage.output_existence(expected, files.object_listing(spark, dst), folder, nation)
    quarantined = spark.read.parquet(bad).select(F.col("fields.c_nationkey").try_cast("int").alias(nation))
    return clean.validation_report(spark.read.parquet(dst), nation, quarantined=quarantined, outputs=outputs)


# ============================================================ run-state log
@q("state_append")
def state_append(spark, sf):
    return state.state_append(tb.table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])


@q("state_last_nonnull")
def state_last_nonnull(spark, sf):
    return state.state_last_nonnull(tb.state_log(spark, sf))


@q("state_map_merge")
def state_map_merge(spark, sf):
    log = tb.state_log(spark, sf).withColumn("map_value", F.get_json_object("props", "$.k"))
    return state.state_map_merge(log)


@q("state_overwrite")
def state_overwrite(spark, sf):
    return state.state_overwrite(tb.state_log(spark, sf))


@q("state_counter")
def state_counter(spark, sf):
    return state.state_counter(tb.state_log(spark, sf))


@q("running_state")
def running_state(spark, sf):
    return state.running_state(tb.state_log(spark, sf))


@q("route_next")
def route_next(spark, sf):
    return state.route_next(tb.state_log(spark, sf))


@q("retry_halt")
def retry_halt(spark, sf):
    return state.retry_halt(tb.state_log(spark, sf))


@q("transition_conformance")
def transition_conformance(spark, sf):
    return state.transition_conformance(tb.state_log(spark, sf), state.edge_table(spark))


@q("run_trace_summary")
def run_trace_summary(spark, sf):
    return state.run_trace_summary(tb.state_log(spark, sf))


@q("node_update")
def node_update(spark, sf):
    return state.node_update(tb.with_messages(tb.state_log(spark, sf)))


@q("rewind")
def rewind(spark, sf):
    return text.rewind(tb.table(spark, sf, "conversations"), "conv_id", "turn", 2)


@q("first_last_match")
def first_last_match(spark, sf):
    return text.first_last_match(tb.table(spark, sf, "conversations"))


@q("stage_edges")
def stage_edges(spark, sf):
    return state.stage_edges(tb.state_log(spark, sf))


@q("job_latest_status")
def job_latest_status(spark, sf):
    return state.job_latest_status(tb.job_runs(spark, sf))


# ============================================================ policy and rules
@q("path_parts")
def path_parts(spark, sf):
    return policy.path_parts(tb.paths(spark, sf)).select("page_id", "path", "resolved", "dir", "base", "ext")


@q("path_resolution")
def path_resolution(spark, sf):
    """X10 on paths with ``.``, ``..``, empty parts and on relative ones."""
    p = F.col("path")
    messy = (F.when(F.col("page_id") % 4 == 0, F.replace(p, F.lit("/w/"), F.lit("/w/./")))
              .when(F.col("page_id") % 4 == 1, F.replace(p, F.lit("/w/"), F.lit("/w/x/../")))
              .when(F.col("page_id") % 4 == 2, F.concat(F.lit("//"), F.substring(p, 2, 1000)))
              .otherwise(F.regexp_replace(p, "^/w/", "")))
    return policy.path_parts(tb.paths(spark, sf).select("page_id", messy.alias("path"))).select("page_id", "path", "resolved", "dir")


@q("path_policy")
def path_policy(spark, sf):
    d = policy.path_policy(tb.paths(spark, sf), existing=tb.existing_files(spark, sf))
    return d.select("page_id", "path", "operation", "safe", "reason")


def _entries(spark, sf):
    p = policy.path_parts(tb.paths(spark, sf))
    files_ = p.select(F.col("dir").alias("parent"), F.col("base").alias("name"), F.lit(False).alias("is_dir"))
    dirs = (p.select("dir").distinct()
             .select(F.regexp_extract("dir", "^(.*)/[^/]*$", 1).alias("parent"),
                     F.regexp_extract("dir", "([^/]*)$", 1).alias("name"), F.lit(True).alias("is_dir")))
    return files_.unionByName(dirs)


@q("ignored_names")
def ignored_names(spark, sf):
    return policy.ignored_names(_entries(spark, sf))


@q("command_policy")
def command_policy(spark, sf):
    return policy.command_policy(tb.commands(spark, sf)).select(
        "req_id", "command", "segment", "base_command", "blocked_token", "blocked")


def _requests(spark, sf):
    return tb.requests_from_commands(tb.commands(spark, sf))


@q("allowlist_match")
def allowlist_match(spark, sf):
    return policy.allowlist_match(_requests(spark, sf), tb.rules(spark))


def _decisions(spark, sf):
    return policy.permission_decision(tb.timed_requests(_requests(spark, sf)), tb.rules(spark), tb.answers(spark, sf),
                                      req_ts="req_ts", ans_ts="answer_ts")


@q("permission_decision")
def permission_decision(spark, sf):
    return _decisions(spark, sf).select("req_id", "target", "reason", "allowed")


RULES_ADDED_AT = "2024-01-01T00:00:00.000Z"
NEW_RULES_AT = "2024-06-01T00:00:00.000Z"


def _rules_after_insert(spark, sf):
    existing = tb.rules(spark).withColumn("added_at", F.lit(RULES_ADDED_AT))
    new = _decisions(spark, sf).where(F.col("reason") == "allow_always")
    return policy.insert_if_absent(existing, new, NEW_RULES_AT)


@q("insert_if_absent")
def insert_if_absent(spark, sf):
    return _rules_after_insert(spark, sf)


@q("remove_by_target")
def remove_by_target(spark, sf):
    blocked = policy.command_policy(tb.commands(spark, sf)).where("blocked")
    removals = blocked.select("category", F.col("base_command").alias("target"))
    return policy.remove_by_target(_rules_after_insert(spark, sf), removals)


@q("rules_kept")
def rules_kept(spark, sf):
    """J6 and J7 as three change sets on a kept table: the first rules, those allowed for
    good, then without the blocked commands. Rows as ``remove_by_target``."""
    kept = KeptTable(spark, staging_path(spark, "rules"), "category string, target string, operation string, added_at string",
                     ["category", "target"])
    kept.insert_if_absent(tb.rules(spark), RULES_ADDED_AT)
    kept.insert_if_absent(_decisions(spark, sf).where(F.col("reason") == "allow_always"), NEW_RULES_AT)
    blocked = policy.command_policy(tb.commands(spark, sf)).where("blocked")
    kept.remove_by_target(blocked.select("category", F.col("base_command").alias("target")))
    return kept.read()


@q("ack_interval_join")
def ack_interval_join(spark, sf):
    e = tb.table(spark, sf, "events")
    req = e.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    ans = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("ans_event_id"), "user_id",
                                                            F.col("ts").alias("ans_ts"))
    return policy.ack_interval_join(req, ans, "user_id", "event_id", "ts", "ans_event_id", "ans_ts")


def _batches(spark, sf):
    return policy.path_parts(tb.paths(spark, sf)).select("page_id", "path", F.col("dir").alias("batch"))


@q("gated_write")
def gated_write(spark, sf):
    b = _batches(spark, sf)
    return policy.gated_write(b, "batch", "page_id", staging_path(spark, "gated_write"))


@q("delete_by_key")
def delete_by_key(spark, sf):
    table_ = tb.paths(spark, sf)
    reqs = _batches(spark, sf).join(table_.where(F.col("operation") == "delete").select("page_id"), "page_id")
    remaining, _report = policy.delete_by_key(table_, reqs, "batch", "page_id")
    dst = staging_path(spark, "delete_by_key")
    remaining.write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def _small_batches(spark, sf):
    part = F.concat((F.col("page_id") % 5).cast("string"), F.lit("-"), F.expr("page_id div 20").cast("string"))
    return tb.paths(spark, sf).select("page_id", "path", part.alias("batch"))


def _stored(spark, sf):
    """Four gated writes into one versioned folder: even and odd batches, some batches
    anew with their first page only, and batches that are all refused."""
    dest, b = staging_path(spark, "gated-files"), _small_batches(spark, sf)
    n = F.expr("page_id div 20")
    for some in (b.where(n % 2 == 0), b.where(n % 2 == 1), b.where((n % 4 == 0) & (F.col("page_id") % 20 < 5)),
                 b.where(F.col("page_id") % 5 == 3)):
        policy.gated_write(some, "batch", "page_id", dest)
    return VersionedTable(spark, dest, "batch")


@q("gated_write_files")
def gated_write_files(spark, sf):
    return _stored(spark, sf).read()


def _deletes(spark, sf):
    paths = tb.paths(spark, sf).where(F.col("operation") == "delete").select("page_id")
    return _small_batches(spark, sf).join(paths, "page_id")


@q("gated_delete_files")
def gated_delete_files(spark, sf):
    stored = _stored(spark, sf)
    policy.gated_delete(stored, _deletes(spark, sf), "batch", "page_id")
    return stored.read()


@q("delete_report")
def delete_report(spark, sf):
    return policy.gated_delete(_stored(spark, sf), _deletes(spark, sf), "batch", "page_id")


# ============================================================ text and JSON
def _extracted(spark, sf):
    return text.llm_json_extract(tb.llm_out(spark, sf))


@q("llm_json_extract")
def llm_json_extract(spark, sf):
    x = _extracted(spark, sf)
    return x.select("id", "json_text", F.try_variant_get("parsed", "$.k", "bigint").alias("k"))


K_ENUM = list(range(50))


@q("schema_contract")
def schema_contract(spark, sf):
    x = text.llm_json_extract(tb.llm_mixed(spark, sf))
    return text.schema_contract(x, {"k": "bigint"}, {"k": K_ENUM}).select("id", "k", "status", "reason")


@q("json_remainder_summary")
def json_remainder_summary(spark, sf):
    x = text.llm_json_extract(tb.llm_mixed(spark, sf))
    return text.json_remainder_summary(x).select("id", "summary")


@q("truncate_with_length")
def truncate_with_length(spark, sf):
    from runfold.functions.text import truncate_with_length as tw
    d = tb.table(spark, sf, "documents")
    return d.select("doc_id", tw("text").alias("truncated"))


@q("namespaced_name")
def namespaced_name(spark, sf):
    from runfold.functions.text import namespaced_name as nn
    t = tb.tool_catalog(spark, sf)
    return t.select("seq", nn("brand", "tool").alias("name"))


@q("conversation_format")
def conversation_format(spark, sf):
    return text.conversation_format(tb.table(spark, sf, "conversations"))


@q("ordered_concat")
def ordered_concat(spark, sf):
    return text.ordered_concat(tb.table(spark, sf, "conversations"), "conv_id", "turn", "text")


PART_ROWS = 2


@q("ordered_concat_parts")
def ordered_concat_parts(spark, sf):
    """A6 with a small part width, so that keys really have several parts."""
    return text.ordered_concat(tb.table(spark, sf, "conversations"), "conv_id", "turn", "text", width=PART_ROWS)


@q("conversation_parts")
def conversation_parts(spark, sf):
    """X11 with a small part width."""
    return text.conversation_format(tb.table(spark, sf, "conversations"), width=PART_ROWS)


@q("text_block_concat")
def text_block_concat(spark, sf):
    """A6 on content blocks: only blocks of type ``text`` are joined."""
    from runfold.functions.text import join_text_blocks
    c = tb.table(spark, sf, "conversations")
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    blocks = F.array(block("text", F.col("role")), block("image", F.col("text")), block("text", F.col("text")))
    return c.select("conv_id", "turn", join_text_blocks(blocks).alias("content"))


@q("role_filter_remap")
def role_filter_remap(spark, sf):
    return text.role_filter_remap(tb.table(spark, sf, "conversations"))


@q("tool_output_context")
def tool_output_context(spark, sf):
    c = tb.table(spark, sf, "conversations")
    some_null = c.withColumn("text", F.when(F.col("conv_id") % 5 != 0, F.col("text")))
    return text.tool_output_context(some_null, F.col("role") == "system", width=PART_ROWS)


# FIXED VALUES: keyword families of the report checks (any-of per family).
KEYWORD_CHECKS = {
    "has_total": ["50.00", "50"],
    "has_report": ["report", "status"],
    "has_error": ["entitynotfoundexception", "not found", "does not exist", "error"],
}


# every word must stand in the text
KEYWORD_ALL = {"licence_named": ["license", "version"]}


@q("keyword_assert")
def keyword_assert(spark, sf):
    d = tb.table(spark, sf, "documents")
    return text.keyword_assert(d.select("doc_id", "text"), "text", KEYWORD_CHECKS, KEYWORD_ALL).drop("text")


@q("error_classify")
def error_classify(spark, sf):
    d = tb.table(spark, sf, "documents")
    return text.error_classify(d.select("doc_id", "text")).select("doc_id", "error_class")


def _doc_lines(spark, sf):
    return files.split_lines(tb.doc_files(spark, sf))


@q("text_line_scan")
def text_line_scan(spark, sf):
    return _doc_lines(spark, sf)


@q("text_file_scan")
def text_file_scan(spark, sf):
    """S3 on files: the documents written as one text file per language, in parts,
    scanned line by line; lines, last line number and characters per file."""
    dst = staging_path(spark, "documents_text")
    d = tb.table(spark, sf, "documents").select("lang", "text")
    d.write.partitionBy("lang").text(dst)
    lines = files.text_line_scan(spark, dst, in_parts=True)
    return lines.groupBy(F.regexp_extract("path", "lang=([^/]*)$", 1).alias("lang")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("n_chars"))


GREP_PATTERN = "@mail[0-9]+"


@q("regex_grep")
def regex_grep(spark, sf):
    return text.regex_grep(_doc_lines(spark, sf), GREP_PATTERN).select("path", "line_no", "match")


INDEXED_PATTERN = "erwhon [a-z]+"


@q("indexed_grep")
def indexed_grep(spark, sf):
    """F1 through a trigram index of the documents."""
    d = tb.table(spark, sf, "documents")
    corpus = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    index = search_index.write_index(corpus, staging_path(spark, "trigrams"))
    return search_index.indexed_grep(corpus, index, INDEXED_PATTERN).select("path", "line_no", "match")


CAPPED_PATTERN = "[0-9]"


@q("capped_matches")
def capped_matches(spark, sf):
    d = tb.table(spark, sf, "documents")
    lines = files.split_lines(d.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    m = text.regex_grep(lines, CAPPED_PATTERN)
    return text.capped_matches(m, ["path", "line_no"], 50).select(
        F.col("path").alias("doc_id"), "line_no", "match")


@q("numbered_topk")
def numbered_topk(spark, sf):
    p = tb.table(spark, sf, "pages").withColumn("score", F.length("html"))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    snippet = F.regexp_replace("html", "<[^>]*>", "")
    return text.numbered_topk(p, "score", "page_id", title, F.col("url"), snippet).select(
        "rank", "id", "score", "result")


# ============================================================ registry, storage
def _registry_lines(spark, sf):
    p = tb.table(spark, sf, "part")
    inc = F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("array<string>")).otherwise(F.split("p_name", " ", -1))
    rows = p.select(F.concat(F.lit("srv-"), F.col("p_partkey").cast("string")).alias("name"),
                    F.lit("docker").alias("command"),
                    F.array(F.lit("run"), F.lit("-i"), F.lit("--rm"), F.col("p_brand")).alias("args"),
                    F.create_map(F.lit("REGION"), F.lit("us-east-1"),
                                 F.lit("TOKEN"), F.concat(F.lit("$TOKEN_"), F.col("p_size").cast("string"))).alias("env"),
                    inc.alias("includeTools"))
    dst = staging_path(spark, "registry_jsonl")
    rows.write.mode("overwrite").json(dst)
    return dst


@q("registry_flatten")
def registry_flatten(spark, sf):
    flat = files.registry_flatten(spark, _registry_lines(spark, sf), multi_line=False)
    return flat.select("server", "command", "tool")


def _remote(spark, sf):
    t = tb.tool_catalog(spark, sf)
    return registry.remote_tools(t.select("server", "tool", "seq"))


@q("registry_union")
def registry_union(spark, sf):
    return registry.registry_union(registry.local_tools(spark), _remote(spark, sf).select("source", "name"))


@q("upsert_last_wins")
def upsert_last_wins(spark, sf):
    t = tb.tool_catalog(spark, sf)
    regs = t.select(F.concat("server", F.lit("_"), F.regexp_extract("tool", "_([a-z]+)$", 1)).alias("name"),
                    "seq", "brand")
    return registry.upsert_last_wins(regs)


@q("registry_kept")
def registry_kept(spark, sf):
    """W5 as three change sets on a kept table, not in the order of registration."""
    t = tb.tool_catalog(spark, sf)
    regs = t.select(F.concat("server", F.lit("_"), F.regexp_extract("tool", "_([a-z]+)$", 1)).alias("name"), "seq", "brand")
    kept = KeptTable(spark, staging_path(spark, "registry"), "name string, seq long, brand string, overwrites long", ["name"])
    for part in (1, 0, 2):
        kept.upsert(regs.where(F.col("seq") % 3 == part))
    return kept.read()


def _include_list(spark, sf):
    t = tb.tool_catalog(spark, sf)
    return t.where((F.col("server") != "aws-documentation") & (F.col("size") > 25)).select("server", "tool")


@q("include_semi")
def include_semi(spark, sf):
    kept, _ = registry.include_semi(tb.tool_catalog(spark, sf).select("seq", "server", "tool"),
                                    _include_list(spark, sf))
    return kept.select("seq", "server", "tool")


@q("role_grants")
def role_grants(spark, sf):
    # the registry holds each tool name once (a map by name)
    tools = registry.registry_union(registry.local_tools(spark), _remote(spark, sf).select("source", "name")).distinct()
    return registry.role_grants(tools, registry.role_rules(spark)).select("role", "source", "name")


def _env_entries(spark, sf):
    s = tb.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    v = (F.when(k % 3 == 0, F.concat(F.lit("$NATION_"), F.col("s_nationkey").cast("string")))
          .when(k % 3 == 1, F.concat(F.lit("$MISSING_"), k.cast("string")))
          .otherwise(F.col("s_name")))
    return s.select("s_suppkey", v.alias("value"))


def _env(spark, sf):
    n = tb.table(spark, sf, "nation")
    return n.select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"),
                    F.when(F.col("n_nationkey") % 6 == 0, F.lit("")).otherwise(F.col("n_name")).alias("env_value"))


@q("variable_resolution")
def variable_resolution(spark, sf):
    return registry.variable_resolution(_env_entries(spark, sf), _env(spark, sf)).select(
        "s_suppkey", "value", "resolved", "unresolved")


@q("uri_build_check")
def uri_build_check(spark, sf):
    s = tb.table(spark, sf, "supplier")
    b = F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    key = F.when(F.col("s_suppkey") % 4 == 0, F.concat(b, F.lit("/raw/data.csv"))).otherwise(
        F.concat(F.lit("raw/"), F.col("s_suppkey").cast("string"), F.lit(".csv")))
    d = s.select("s_suppkey", b.alias("bucket"), key.alias("key"))
    return registry.uri_build_check(d).select("s_suppkey", "uri", "doubled_bucket")


# Default settings as (section, key, value) rows; lists as JSON text.
SETTINGS_DEFAULTS = [
    ("version", "version", "1.1.0"),
    ("preferences", "confirmationMode", "manual"),
    ("pulumi", "backend", "cloud"),
    *[("safety", k, json.dumps(v, separators=(",", ":"))) for k, v in [
        ("allowedPaths", ALLOWED_PATHS), ("blockedPatterns", BLOCKED_PATTERNS), ("blockedCommands", BLOCKED_COMMANDS),
        ("readOnlyFiles", READ_ONLY_FILES), ("notAllowedExtensions", NOT_ALLOWED_EXTENSIONS)]],
    *[("allowList", k, "[]") for k in ("files", "commands", "mcp")],
]
LOAD_MERGE_SECTIONS = ["safety", "allowList"]


def _setting(section, key, value):
    return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"),
                    (value if not isinstance(value, str) else F.lit(value)).alias("value"))


def _loaded_settings(spark, sf):
    """Each customer's loaded settings layer: one of three override shapes,
    chosen by key (every customer has a layer; nothing is filtered out)."""
    c = tb.table(spark, sf, "customer")
    k = F.col("c_custkey")
    layer = (F.when(k % 3 == 0, F.array(_setting("preferences", "confirmationMode", "auto"),
                                        _setting("preferences", "theme", "dark")))
              .when(k % 3 == 1, F.array(_setting("safety", "blockedCommands", '["sudo"]')))
              .otherwise(F.array(_setting("pulumi", "stack", F.col("c_mktsegment")))))
    return c.select(k.alias("tenant"), F.inline(layer))


@q("layered_defaults")
def layered_defaults(spark, sf):
    tenants = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant"))
    return registry.layered_defaults(_loaded_settings(spark, sf), SETTINGS_DEFAULTS, tenants, LOAD_MERGE_SECTIONS)


@q("settings_update")
def settings_update(spark, sf):
    """X9, update mode: a request per customer over the effective settings."""
    current = layered_defaults(spark, sf).drop("layer")
    k = F.col("c_custkey")
    request = (F.when(k % 4 == 0, F.array(_setting("preferences", "confirmationMode", "auto"),
                                          _setting("safety", "blockedCommands", "[]")))
                .when(k % 4 == 1, F.array(_setting("allowList", "commands", '["ls"]')))
                .when(k % 4 == 2, F.array(_setting("pulumi", "backend", "local"), _setting("version", "version", "9")))
                .otherwise(F.array().cast("array<struct<section:string,key:string,value:string>>")))
    c = tb.table(spark, sf, "customer").select(k.alias("tenant"), F.inline(request))
    return registry.settings_update(current, c)


def _listing(spark, sf):
    """The pages as an object store's listing: address, size, time of change."""
    p = tb.table(spark, sf, "pages")
    return p.select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length"),
                    F.timestamp_seconds(F.col("page_id") * 60).cast("timestamp_ntz").alias("modificationTime"))


def _host(path):
    return F.regexp_extract(path, "^[a-z]+://([^/?#]*)", 1)


@q("object_listing")
def object_listing(spark, sf):
    """S4 as keys and sizes below one prefix of the store."""
    return storage.prefix_filter(_listing(spark, sf), "path", "https://")


@q("binary_detect")
def binary_detect(spark, sf):
    """F2 on file bodies held in a table: some documents get a NUL byte."""
    d = tb.table(spark, sf, "documents")
    nul = F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("text"), F.lit("\u0000"))).otherwise(F.col("text"))
    return files.binary_detect_content(d.select("doc_id", F.encode(nul, "UTF-8").alias("content"))).select("doc_id", "is_binary")


@q("storage_usage")
def storage_usage(spark, sf):
    return storage.storage_usage(_listing(spark, sf), _host(F.col("path")))


@q("output_existence")
def output_existence(spark, sf):
    """Each page's host and a host of the nation's name, as expected outputs."""
    hosts = _listing(spark, sf).select(_host(F.col("path")).alias("prefix")).distinct()
    named = tb.table(spark, sf, "nation").select(F.lower("n_name").alias("prefix"))
    return storage.output_existence(hosts.unionByName(named), _listing(spark, sf), _host(F.col("path")))


SEARCH_PATTERN = "[0-9]{2}"


@q("corpus_search")
def corpus_search(spark, sf):
    """Search of a file corpus: path policy, extension, text check, grep, cap."""
    d = tb.table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.concat(F.when(k % 5 == 0, "/w/other/d").when(k % 5 == 1, "/w/CodeSandBox/dist/d").otherwise("/w/CodeSandBox/d"),
                    F.format_string("%08d", k), F.when(k % 3 == 0, ".csv").when(k % 3 == 1, ".py").otherwise(".sh"))
    body = F.when(k % 11 == 0, F.concat(F.lit("\u0000"), F.col("text"))).otherwise(F.col("text"))
    corpus = d.select(path.alias("path"), body.alias("content"))
    return files.corpus_search(corpus, SEARCH_PATTERN, extensions=[".csv", ".py"]).select("path", "line_no", "match")


@q("resolve_source")
def resolve_source(spark, sf):
    return files.resolve_source(spark, "runfold_orders_catalog", f"{sf.rstrip('/')}/orders.parquet")


@q("resolve_source_catalog")
def resolve_source_catalog(spark, sf):
    """S5 where the catalog has the table: it is read, not the path."""
    tb.table(spark, sf, "customer").createOrReplaceTempView("runfold_customer_catalog")
    return files.resolve_source(spark, "runfold_customer_catalog", f"{sf.rstrip('/')}/orders.parquet")


@q("multi_read")
def multi_read(spark, sf):
    lab = tb.table(spark, sf, "labels")
    reqs = lab.select(F.col("doc_id").alias("req_id"),
                      F.concat(F.lit("doc-"), (F.col("doc_id") * 3).cast("string")).alias("path"))
    return files.multi_read(spark, reqs, tb.doc_files(spark, sf).select("path", "content"))


@q("prefix_filter")
def prefix_filter(spark, sf):
    return storage.prefix_filter(tb.table(spark, sf, "supplier"), "s_name", "Supplier#0000000")


@q("pass_score")
def pass_score(spark, sf):
    lab = tb.table(spark, sf, "labels").join(tb.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    passed = (F.col("quality") == 1) & (F.col("toxic") == 0)
    # a suite's result can be missing
    res = lab.select(F.col("lang").alias("suite"), F.when(F.col("doc_id") % 7 != 0, passed).alias("success"))
    return reports.pass_score(res, "suite")


TOOL_WORDS = ["read", "write", "list", "search", "delete", "get"]


@q("tool_call_count")
def tool_call_count(spark, sf):
    c = tb.table(spark, sf, "conversations")
    words = F.split(F.lower("text"), "[^a-z_]+", -1)
    calls = F.when(F.col("role") == "assistant",
                   F.filter(words, lambda w: w.isin(*TOOL_WORDS))).otherwise(F.array().cast("array<string>"))
    return reports.tool_call_count(c, "conv_id", calls)


# ============================================================ streaming
@q("update_stream")
def update_stream(spark, sf):
    from runfold.streaming import streams
    return streams.update_stream(spark, sf)


@q("streaming_state")
def streaming_state(spark, sf):
    from runfold.streaming import streams
    return streams.streaming_state(spark, sf)


@q("streaming_context")
def streaming_context(spark, sf):
    from runfold.streaming import streams
    return streams.streaming_context(spark, sf)


@q("streaming_messages")
def streaming_messages(spark, sf):
    from runfold.streaming import streams
    return streams.streaming_messages(spark, sf)


@q("incremental_copy")
def incremental_copy(spark, sf):
    from runfold.streaming import streams
    return streams.incremental_copy(spark, sf, "events")


@q("poll_until_terminal")
def poll_until_terminal(spark, sf):
    from runfold.streaming import streams
    return streams.poll_until_terminal(spark, sf)


@q("stream_ack_join")
def stream_ack_join(spark, sf):
    from runfold.streaming import streams
    return streams.stream_ack_join(spark, sf)
