"""DuckDB SQL equal to each binding in ``runfold.plans.bindings``.

The derived inputs are CTEs over the pre-registered driver views; column names
match the Spark results. Keys whose input is the file system or a stream have
no entry here (the driver then checks rows only).
"""

from __future__ import annotations

from runfold.constants import (BLOCKED_COMMANDS, IGNORED_NAMES, JS_WS_CODEPOINTS, NO_DISCOVERY_TEXT,
                               NO_SUMMARY_TEXT, SEARCH_CAP, TOOL_OUTPUT_PREFIX, WORKFLOW_EDGES)
from runfold.functions.text import EMAIL_PATTERN
from runfold.operators.registry import LOCAL_TOOL_GROUPS, ROLE_RULES
from runfold.operators.text import STRATEGY_LINE
from runfold.plans import bindings as B
from runfold.sources.tables import MIXED_BODIES, RULES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WS = "concat(" + ", ".join(f"chr({c})" for c in JS_WS_CODEPOINTS) + ")"


def js_trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def values(rows, cols) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "[" + ", ".join(lit(i) for i in x) + "]"
        return lit(x) if isinstance(x, str) else str(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


STATE_LOG = """state_log AS (
  SELECT user_id AS session_id, event_id AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'architect' WHEN 'view' THEN 'pipeline-coder'
      WHEN 'error' THEN 'deployer' WHEN 'purchase' THEN 'deployer' ELSE 'data-ops' END AS node,
    CASE event_type WHEN 'signup' THEN 'planning' WHEN 'view' THEN 'pipeline-coding'
      WHEN 'error' THEN 'deploying-failed' WHEN 'purchase' THEN 'deployment-success' END AS current_step,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' END AS deployment_status,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN 'DATA_ANALYSIS' ELSE 'GREENFIELD' END END
      AS execution_strategy,
    event_type IN ('error', 'purchase') AS has_validation_errors,
    CASE event_type WHEN 'error' THEN concat('err-', CAST(event_id AS VARCHAR)) END AS validation_errors,
    (event_type = 'error' AND event_id % 5 <> 0) AS has_retry,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 END AS retry_inc,
    event_type AS map_key, props,
    CASE event_type WHEN 'signup' THEN concat('{"nodes":[', CAST(event_id AS VARCHAR), ']}') END AS diagram,
    CASE event_type WHEN 'view' THEN props END AS cloud_plan,
    CASE event_type WHEN 'purchase' THEN concat('/w/s', CAST(user_id AS VARCHAR)) END AS workspace_path,
    CASE event_type WHEN 'view' THEN concat('code ', CAST(event_id AS VARCHAR)) END AS code_pulumi,
    CASE event_type WHEN 'click' THEN concat('job ', CAST(event_id AS VARCHAR)) END AS code_pyspark
  FROM events)"""

RAW_CUSTOMERS = """raw_customers AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 10 = 0 THEN ' invalid-email'
         ELSE concat(' ', upper(replace(c_name, '#', '.')), '@Example.com ') END AS customer_email,
    concat(' ', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) AS amount, c_nationkey
  FROM customer)"""

EMAIL_E = f"lower({js_trim('customer_email')})"
EMAIL_VALID = f"coalesce(regexp_matches({EMAIL_E}, {lit(EMAIL_PATTERN)}), false)"
EMAIL_CLEAN = f"CASE WHEN {EMAIL_VALID} THEN {EMAIL_E} END"

COMMANDS = """commands AS (
  SELECT p_partkey AS req_id,
    CASE p_partkey % 5 WHEN 0 THEN concat('cd /w && sudo ', p_name)
      WHEN 1 THEN concat('cd /w && ', p_name) WHEN 2 THEN concat('sudo x && ', p_name)
      WHEN 3 THEN concat(p_name, ' --output-format json') ELSE p_name END AS command,
    'commands' AS category,
    CASE p_partkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'execute' END AS operation
  FROM part)"""

_LAST_SEG = js_trim("string_split(command, '&&')[-1]")
ACTUAL = f"CASE WHEN contains(command, '&&') THEN coalesce(nullif({_LAST_SEG}, ''), command) ELSE command END"
TOKEN_CASE = "CASE " + " ".join(f"WHEN contains(lower(segment), {lit(t.lower())}) THEN {lit(t.lower())}"
                                for t in BLOCKED_COMMANDS) + " END"
COMMAND_POLICY = f"""command_policy AS (
  SELECT req_id, command, category, operation, segment,
    coalesce(nullif(string_split(segment, ' ')[1], ''), segment) AS base_command,
    {TOKEN_CASE} AS blocked_token,
    ({TOKEN_CASE}) IS NOT NULL AS blocked
  FROM (SELECT *, {ACTUAL} AS segment FROM commands))"""

RULES_CTE = f"rules AS {values(RULES, ['category', 'target', 'operation'])}"
REQUESTS = "requests AS (SELECT req_id, category, operation, base_command AS target FROM command_policy)"
RULE_HIT = """EXISTS (SELECT 1 FROM rules u WHERE u.category = r.category
    AND (u.operation = r.operation OR u.operation = 'all')
    AND CASE WHEN r.category = 'commands' THEN starts_with(r.target, u.target) ELSE r.target = u.target END)"""
ANSWERS = """answers AS (
  SELECT p_partkey AS req_id,
    -- an answer after more than 300 s (ten times the size) is none
    CASE WHEN p_size * 10 <= 300 THEN
      CASE p_size % 4 WHEN 0 THEN 'allow_always' WHEN 1 THEN 'allow_once' WHEN 2 THEN 'deny' END END AS answer
  FROM part)"""
DECISIONS = f"""decisions AS (
  SELECT r.*, CASE WHEN r.operation = 'read' THEN 'read' WHEN {RULE_HIT} THEN 'allowlist'
      WHEN a.answer = 'allow_always' THEN 'allow_always' WHEN a.answer = 'allow_once' THEN 'allow_once'
      WHEN a.answer IS NULL THEN 'timeout' ELSE 'denied' END AS reason
  FROM requests r LEFT JOIN answers a ON a.req_id = r.req_id)"""
POLICY_PREFIX = f"WITH {COMMANDS}, {COMMAND_POLICY}, {RULES_CTE}, {REQUESTS}, {ANSWERS}, {DECISIONS}"
RULES_AFTER_INSERT = f"""rules_after AS (
  SELECT category, target, operation, {lit(B.RULES_ADDED_AT)} AS added_at FROM rules
  UNION ALL
  SELECT DISTINCT category, target, operation, {lit(B.NEW_RULES_AT)} AS added_at FROM decisions d
  WHERE reason = 'allow_always' AND NOT EXISTS (SELECT 1 FROM rules x WHERE x.category = d.category
    AND x.target = d.target AND x.operation = d.operation))"""

PATHS = """paths AS (
  SELECT page_id,
    concat(CASE page_id % 5 WHEN 0 THEN '/w/CodeSandBox/' WHEN 1 THEN '/w/CodeSandBox/dist/'
      WHEN 2 THEN '/w/other/' WHEN 3 THEN '/etc/' ELSE '/w/CodeSandBox/.cache/' END,
      'p', CAST(page_id AS VARCHAR),
      CASE page_id % 7 WHEN 0 THEN '.sh' WHEN 1 THEN '.py' WHEN 2 THEN '' ELSE '.csv' END) AS path,
    CASE page_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'delete' END AS operation
  FROM pages)"""
PATH_PARTS = """path_parts AS (
  SELECT *, path AS resolved,
    CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir,
    regexp_extract(path, '([^/]*)$', 1) AS base,
    lower(CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '..' THEN ''
          ELSE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(?s)^.+(\\.[^.]*)$', 1) END) AS ext
  FROM paths)"""
EXISTING = """existing AS (
  SELECT p.path FROM paths p JOIN pages g ON g.page_id = p.page_id WHERE starts_with(g.url, 'https://'))"""


def within(x: str, base: str) -> str:
    prefix = base.rstrip("/") + "/"
    return (f"({x} = {lit(base)} OR (starts_with({x}, {lit(prefix)}) AND NOT "
            f"starts_with(substring({x}, {len(prefix) + 1}), '..')))")


def policy_reason(op: str, exists: str) -> str:
    return f"""CASE WHEN NOT {within('resolved', '/w')} THEN 'Path traversal detected.'
      WHEN NOT {within('resolved', '/w/CodeSandBox')} THEN 'Path is not within allowed directories.'
      WHEN regexp_matches(resolved, '(node_modules)|(\\.git)|(dist)|(build)') THEN 'Path matches a blocked pattern.'
      WHEN ext IN ('.exe', '.sh', '.bat', '.cmd') THEN concat('File extension ', chr(39), ext, chr(39), ' is strictly prohibited.')
      WHEN {op} IN ('write', 'delete') AND base IN ('package.json', 'package-lock.json')
        THEN concat('File ', chr(39), base, chr(39), ' is read-only.')
      WHEN {op} IN ('read', 'delete') AND NOT ({exists}) THEN 'File does not exist.'
      WHEN {op} = 'execute' THEN 'Direct execution disabled.' END"""


LLM = f"""llm_out AS (
  SELECT event_id AS id,
    concat('<think>', event_type, '</think>```json', chr(10),
           CASE WHEN event_id % 7 = 0 THEN 'no json' ELSE props END, chr(10), '```') AS raw
  FROM events),
s1 AS (SELECT id, {js_trim("regexp_replace(" + js_trim('raw') + ", '(?is)<think>.*?</think>', '', 'g')")} AS t FROM llm_out),
s2 AS (SELECT id, {js_trim("regexp_replace(regexp_replace(t, '(?i)^```(?:json)?', ''), '```\\z', '')")} AS cleaned FROM s1),
ext AS (SELECT id, cleaned, nullif(regexp_extract(cleaned, '(?s)\\{{.*\\}}', 0), '') AS json_text FROM s2),
parsed AS (SELECT *, CASE WHEN json_valid(json_text) THEN TRY_CAST(json_extract_string(json_text, '$.k') AS BIGINT) END AS k,
  coalesce(json_valid(json_text), false) AS valid FROM ext)"""

TOOL_CATALOG = """tool_catalog AS (
  SELECT p_partkey AS seq,
    CASE p_partkey % 4 WHEN 0 THEN 'aws-api' WHEN 1 THEN 'aws-data-processing'
      WHEN 2 THEN 'aws-documentation' ELSE 'azure-catalog' END AS server,
    concat(lower(replace(p_name, ' ', '_')), '_', lower(p_type)) AS tool, p_brand AS brand, p_size AS size
  FROM part)"""
LOCAL_TOOLS = values([(g, t) for g, ts in LOCAL_TOOL_GROUPS.items() for t in ts], ["source", "name"])
REMOTE = "SELECT server AS source, concat(regexp_replace(server, '[^a-zA-Z0-9_-]', '_', 'g'), '_', tool) AS name FROM tool_catalog"
UNION_TOOLS = f"tools AS (SELECT source, name FROM {LOCAL_TOOLS} l UNION ALL {REMOTE})"

CONVS_LINES = """lines AS (
  SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents))"""

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------ clean and load
ORACLE["csv_scan"] = f"""WITH {RAW_CUSTOMERS}
SELECT CAST(id AS VARCHAR) AS id, customer_email, amount, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM raw_customers"""

ORACLE["csv_to_parquet"] = f"""WITH {RAW_CUSTOMERS}
SELECT CAST(id AS BIGINT) AS id, {EMAIL_CLEAN} AS customer_email,
  CAST(TRY_CAST({js_trim('amount')} AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(c_nationkey AS INTEGER) AS c_nationkey,
  {EMAIL_VALID} AS email_valid
FROM raw_customers"""

ORACLE["email_clean"] = f"""WITH {RAW_CUSTOMERS}
SELECT id, {EMAIL_CLEAN} AS customer_email, {EMAIL_VALID} AS email_valid FROM raw_customers"""

ORACLE["amount_date_clean"] = f"""WITH raw_orders AS (
  SELECT o_orderkey AS id, concat(' ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS amount,
    strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)
SELECT id, CAST(TRY_CAST({js_trim('amount')} AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  TRY_CAST({js_trim('date')} AS DATE) AS date
FROM raw_orders"""

ORACLE["column_total"] = """SELECT CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS DOUBLE) AS total
FROM lineitem"""

ORACLE["high_value_summary"] = """WITH per_cust AS (
  SELECT c_mktsegment, o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, max(o_totalprice) AS m
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000 GROUP BY c_mktsegment, o_custkey)
SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_orders, CAST(CAST(sum(s) AS DECIMAL(38,2)) AS DOUBLE) AS total_value,
  CAST(sum(s) AS DOUBLE) / sum(n) AS avg_value, max(m) AS max_value,
  arg_max(o_custkey, {'s': s, 'k': -o_custkey}) AS top_customer
FROM per_cust GROUP BY c_mktsegment"""

ORACLE["validation_report"] = f"""WITH {RAW_CUSTOMERS},
c AS (SELECT c_nationkey, {EMAIL_VALID} AS email_valid, TRY_CAST({js_trim('amount')} AS DECIMAL(18,2)) AS amount
      FROM raw_customers),
r AS (SELECT c_nationkey, count(*) AS n_rows, count(*) FILTER (WHERE NOT email_valid) AS n_bad_email,
        count(*) FILTER (WHERE amount IS NULL) AS n_bad_amount,
        CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS DOUBLE) AS total_amount,
        CAST(CAST(min(amount) AS DECIMAL(38,2)) AS DOUBLE) AS min_amount,
        CAST(CAST(max(amount) AS DECIMAL(38,2)) AS DOUBLE) AS max_amount
      FROM c GROUP BY c_nationkey)
SELECT r.*, CASE WHEN n_bad_email + n_bad_amount = 0 THEN 'PASSED'
    WHEN (n_bad_email + n_bad_amount) * 10 < n_rows THEN 'WARNING' ELSE 'FAILED' END AS status,
  n_bad_email + n_bad_amount AS issues,
  CASE WHEN n_bad_email + n_bad_amount = 0 THEN 'none' ELSE concat_ws('; ',
    CASE WHEN n_bad_email > 0 THEN 'quarantine rows with invalid e-mail' END,
    CASE WHEN n_bad_amount > 0 THEN 'fix non-numeric amounts at the source' END) END AS remedy,
  x.execution_status, x.processing_seconds
FROM r LEFT JOIN (
  SELECT c_nationkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'SUCCEEDED' ELSE 'RUNNING' END,
      {{'ts': o_orderdate, 'id': o_orderkey}}) AS execution_status,
    date_diff('second', min(o_orderdate), max(o_orderdate)) AS processing_seconds
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey) x USING (c_nationkey)"""

LINES = f"""{RAW_CUSTOMERS},
lines AS (
  SELECT *, CASE WHEN id % 10 = 3 THEN 'extra_fields' WHEN id % 10 = 7 THEN 'missing_fields' WHEN id % 20 = 9 THEN 'unclosed_quote' END AS reason,
    concat_ws(',', id, customer_email, amount, c_nationkey) AS fine
  FROM raw_customers),
loaded AS (
  SELECT id, {EMAIL_CLEAN} AS customer_email, TRY_CAST({js_trim('amount')} AS DECIMAL(18,2)) AS amount, c_nationkey, {EMAIL_VALID} AS email_valid
  FROM lines WHERE reason IS NULL)"""

ORACLE["csv_load_checked"] = f"""WITH {LINES}
SELECT id, customer_email, CAST(amount AS DOUBLE) AS amount, email_valid, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM loaded"""

ORACLE["csv_quarantine"] = f"""WITH {LINES}
SELECT CASE reason WHEN 'extra_fields' THEN concat(fine, ',EXTRA') WHEN 'missing_fields' THEN concat(id, ',', customer_email)
    ELSE concat(id, ',"', customer_email, ',', amount, ',', c_nationkey) END AS line,
  CASE reason WHEN 'extra_fields' THEN 5 ELSE 2 END AS n_fields, reason, CAST(id AS VARCHAR) AS id,
  CASE reason WHEN 'extra_fields' THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey
FROM lines WHERE reason IS NOT NULL"""

ORACLE["validation_report_outputs"] = f"""WITH {LINES},
each AS (
  SELECT c_nationkey, 1 AS n, NOT email_valid AS bad_email, amount IS NULL AS bad_amount, amount, 0 AS q, false AS expected FROM loaded
  UNION ALL
  SELECT CASE reason WHEN 'extra_fields' THEN c_nationkey END, 0, false, false, NULL, 1, false FROM lines WHERE reason IS NOT NULL
  UNION ALL
  SELECT n_nationkey + a.x, 0, false, false, NULL, 0, true FROM nation, (VALUES (0), (25)) a(x)),
r AS (
  SELECT CAST(c_nationkey AS INTEGER) AS c_nationkey, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE bad_email) AS n_bad_email,
    count(*) FILTER (WHERE bad_amount) AS n_bad_amount, CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS DOUBLE) AS total_amount,
    CAST(CAST(min(amount) AS DECIMAL(38,2)) AS DOUBLE) AS min_amount, CAST(CAST(max(amount) AS DECIMAL(38,2)) AS DOUBLE) AS max_amount,
    CAST(sum(q) AS BIGINT) AS n_quarantined,
    CASE WHEN bool_or(expected) THEN CASE WHEN sum(n) > 0 THEN 'ok' ELSE 'missing' END END AS output_status
  FROM each GROUP BY c_nationkey),
i AS (SELECT *, n_bad_email + n_bad_amount + n_quarantined + CASE WHEN output_status = 'missing' THEN 1 ELSE 0 END AS issues FROM r)
SELECT *, CASE WHEN issues = 0 THEN 'PASSED'
    WHEN coalesce(output_status, '') <> 'missing' AND issues * 10 < n_rows + n_quarantined THEN 'WARNING' ELSE 'FAILED' END AS status,
  CASE WHEN issues = 0 THEN 'none' ELSE concat_ws('; ',
    CASE WHEN n_bad_email > 0 THEN 'quarantine rows with invalid e-mail' END,
    CASE WHEN n_bad_amount > 0 THEN 'fix non-numeric amounts at the source' END,
    CASE WHEN n_quarantined > 0 THEN 'repair malformed lines in quarantine' END,
    CASE WHEN output_status = 'missing' THEN 'load again, output is missing' END) END AS remedy
FROM i"""

# ------------------------------------------------------------ run-state log
ORACLE["state_append"] = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  turn, role, text FROM conversations"""

ORACLE["streaming_messages"] = ORACLE["state_append"]

ORACLE["state_last_nonnull"] = f"""WITH {STATE_LOG}
SELECT session_id,
  coalesce(arg_max(current_step, seq) FILTER (WHERE current_step IS NOT NULL), 'reception') AS current_step,
  coalesce(arg_max(execution_strategy, seq) FILTER (WHERE execution_strategy IS NOT NULL), 'PENDING') AS execution_strategy,
  coalesce(arg_max(deployment_status, seq) FILTER (WHERE deployment_status IS NOT NULL), 'PENDING') AS deployment_status,
  coalesce(arg_max(diagram, seq) FILTER (WHERE diagram IS NOT NULL), '{{"nodes":[],"edges":[]}}') AS diagram,
  arg_max(cloud_plan, seq) FILTER (WHERE cloud_plan IS NOT NULL) AS cloud_plan,
  coalesce(arg_max(workspace_path, seq) FILTER (WHERE workspace_path IS NOT NULL), '') AS workspace_path
FROM state_log GROUP BY session_id"""

ORACLE["state_map_merge"] = f"""WITH {STATE_LOG}
SELECT session_id, map_key, arg_max(json_extract_string(props, '$.k'), seq) AS map_value
FROM state_log WHERE map_key IS NOT NULL GROUP BY session_id, map_key"""

ORACLE["state_overwrite"] = f"""WITH {STATE_LOG}
SELECT session_id, arg_max_null(validation_errors, seq) FILTER (WHERE has_validation_errors) AS validation_errors
FROM state_log GROUP BY session_id"""

RETRY_INC = "CASE WHEN has_retry THEN coalesce(retry_inc, 1) ELSE 0 END"
ORACLE["state_counter"] = f"""WITH {STATE_LOG}
SELECT session_id, CAST(sum({RETRY_INC}) AS BIGINT) AS retry_count FROM state_log GROUP BY session_id"""

RUNNING = f"""running AS (
  SELECT session_id, seq, node,
    coalesce(last_value(current_step IGNORE NULLS) OVER w, 'reception') AS current_step,
    coalesce(last_value(execution_strategy IGNORE NULLS) OVER w, 'PENDING') AS execution_strategy,
    coalesce(last_value(deployment_status IGNORE NULLS) OVER w, 'PENDING') AS deployment_status,
    coalesce(last_value(diagram IGNORE NULLS) OVER w, '{{"nodes":[],"edges":[]}}') AS diagram, last_value(cloud_plan IGNORE NULLS) OVER w AS cloud_plan,
    coalesce(last_value(workspace_path IGNORE NULLS) OVER w, '') AS workspace_path,
    (last_value(CASE WHEN has_validation_errors THEN {{'v': validation_errors}} END IGNORE NULLS) OVER w).v
      AS validation_errors,
    CAST(sum({RETRY_INC}) OVER w AS BIGINT) AS retry_count
  FROM state_log
  WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ORACLE["running_state"] = f"WITH {STATE_LOG}, {RUNNING} SELECT * FROM running"

ORACLE["route_next"] = f"""WITH {STATE_LOG}, {RUNNING}
SELECT session_id, seq, node,
  CASE node
    WHEN 'architect' THEN CASE WHEN deployment_status = 'FATAL_ERROR' THEN '__end__'
      WHEN execution_strategy = 'DATA_ANALYSIS' THEN 'data-ops' ELSE 'pipeline-coder' END
    WHEN 'deployer' THEN CASE WHEN deployment_status = 'FATAL_ERROR' THEN '__end__'
      WHEN deployment_status = 'FAILED' AND retry_count >= 3 THEN '__end__'
      WHEN deployment_status = 'FAILED' THEN 'pipeline-coder' ELSE 'data-ops' END
    WHEN 'pipeline-coder' THEN 'deployer'
    WHEN 'data-ops' THEN '__end__' END AS next_node
FROM running"""

ORACLE["retry_halt"] = f"""WITH {STATE_LOG}, {RUNNING}
SELECT session_id, min(seq) AS halt_seq FROM running WHERE retry_count >= 3 GROUP BY session_id"""

EDGES = values(WORKFLOW_EDGES, ["src", "dst"])
ORACLE["transition_conformance"] = f"""WITH {STATE_LOG},
t AS (
  SELECT session_id, seq AS src_seq, node AS src, lead(seq) OVER w AS dst_seq,
    coalesce(lead(node) OVER w, '__end__') AS dst
  FROM state_log WINDOW w AS (PARTITION BY session_id ORDER BY seq)
  UNION ALL
  SELECT session_id, NULL AS src_seq, '__start__' AS src, min(seq) AS dst_seq, arg_min(node, seq) AS dst
  FROM state_log GROUP BY session_id)
SELECT session_id, CAST(src_seq AS DOUBLE) AS src_seq, src, CAST(dst_seq AS DOUBLE) AS dst_seq, dst
FROM t WHERE NOT EXISTS (SELECT 1 FROM {EDGES} e WHERE e.src = t.src AND e.dst = t.dst)"""

ORACLE["run_trace_summary"] = f"""WITH {STATE_LOG}
SELECT session_id, count(*) AS n_steps, count(*) FILTER (WHERE validation_errors IS NOT NULL) AS n_errors,
  arg_max(node, seq) AS last_node, arg_max(coalesce(current_step, 'Processing'), seq) AS last_step
FROM state_log GROUP BY session_id"""

ORACLE["node_update"] = f"""WITH {STATE_LOG}
SELECT session_id, seq, node, deployment_status AS status, current_step AS step, execution_strategy AS strategy,
  CASE WHEN map_key IN ('click', 'view') THEN props WHEN map_key = 'purchase' THEN 'Executed Task.' ELSE '' END AS message,
  validation_errors AS errors, diagram, coalesce(code_pulumi, '') AS code_pulumi, coalesce(code_pyspark, '') AS code_pyspark
FROM state_log"""

ORACLE["rewind"] = """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3"""

ORACLE["first_last_match"] = """SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_request,
  arg_max(text, turn) AS last_message, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id"""

ORACLE["stage_edges"] = f"""WITH {STATE_LOG},
n AS (SELECT session_id, node, lead(node) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM state_log)
SELECT node AS src, nxt AS dst, count(*) AS n_transitions, count(DISTINCT session_id) AS n_runs
FROM n WHERE nxt IS NOT NULL GROUP BY node, nxt"""

ORACLE["job_latest_status"] = """WITH runs AS (
  SELECT o_custkey AS job, o_orderkey AS run_id, o_orderdate AS ts,
    CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status FROM orders),
a AS (SELECT job, arg_max(status, {'ts': ts, 'id': run_id}) AS latest_status, min(ts) AS first_seen,
        max(ts) AS last_seen, count(*) AS n_polls FROM runs GROUP BY job)
SELECT *, date_diff('second', first_seen, last_seen) AS processing_seconds,
  latest_status IN ('SUCCEEDED', 'FAILED') AS is_terminal FROM a"""

# ------------------------------------------------------------ policy and rules
ORACLE["path_parts"] = f"WITH {PATHS}, {PATH_PARTS} SELECT page_id, path, resolved, dir, base, ext FROM path_parts"

ORACLE["path_resolution"] = f"""WITH {PATHS}, {PATH_PARTS}
SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(path, '/w/', '/w/./') WHEN 1 THEN replace(path, '/w/', '/w/x/../')
    WHEN 2 THEN concat('/', path) ELSE regexp_replace(path, '^/w/', '') END AS path,
  path AS resolved, dir FROM path_parts"""

ORACLE["path_policy"] = f"""WITH {PATHS}, {PATH_PARTS}, {EXISTING},
d AS (SELECT *, {policy_reason('operation', 'EXISTS (SELECT 1 FROM existing e WHERE e.path = resolved)')} AS reason
      FROM path_parts)
SELECT page_id, path, operation, reason IS NULL AS safe, reason FROM d"""

ORACLE["ignored_names"] = f"""WITH {PATHS}, {PATH_PARTS},
entries AS (
  SELECT dir AS parent, base AS name, false AS is_dir FROM path_parts
  UNION ALL
  SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(dir, '([^/]*)$', 1) AS name, true AS is_dir
  FROM (SELECT DISTINCT dir FROM path_parts))
SELECT *, CASE WHEN is_dir THEN concat('[DIR]  ', name) ELSE concat('[FILE] ', name) END AS entry
FROM entries WHERE NOT starts_with(name, '.') AND name NOT IN ({', '.join(lit(n) for n in IGNORED_NAMES)})"""

ORACLE["command_policy"] = f"""WITH {COMMANDS}, {COMMAND_POLICY}
SELECT req_id, command, segment, base_command, blocked_token, blocked FROM command_policy"""

ORACLE["allowlist_match"] = f"""{POLICY_PREFIX}
SELECT * FROM requests r WHERE {RULE_HIT}"""

ORACLE["permission_decision"] = f"""{POLICY_PREFIX}
SELECT req_id, target, reason, reason IN ('auto', 'read', 'allowlist', 'allow_always', 'allow_once') AS allowed
FROM decisions"""

ORACLE["insert_if_absent"] = f"""{POLICY_PREFIX}, {RULES_AFTER_INSERT}
SELECT * FROM rules_after"""

ORACLE["remove_by_target"] = f"""{POLICY_PREFIX}, {RULES_AFTER_INSERT}
SELECT * FROM rules_after a WHERE NOT EXISTS (SELECT 1 FROM command_policy c
  WHERE c.blocked AND c.category = a.category AND c.base_command = a.target)"""

ORACLE["rules_kept"] = ORACLE["remove_by_target"]

ORACLE["ack_interval_join"] = """WITH req AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
ans AS (SELECT event_id AS ans_event_id, user_id, ts AS ans_ts FROM events WHERE event_type = 'purchase'),
best AS (
  SELECT r.event_id, arg_min({'aid': a.ans_event_id, 'ats': a.ans_ts}, {'t': a.ans_ts, 'i': a.ans_event_id}) AS b
  FROM req r JOIN ans a ON a.user_id = r.user_id AND a.ans_ts >= r.ts AND a.ans_ts <= r.ts + INTERVAL 300 SECOND
  GROUP BY r.event_id)
SELECT r.event_id, r.user_id, r.ts, CAST(b.b.aid AS DOUBLE) AS answer_id, b.b.ats AS answer_ts,
  CASE WHEN b.b IS NOT NULL THEN 'allow' ELSE 'deny' END AS decision
FROM req r LEFT JOIN best b ON b.event_id = r.event_id"""

GATE = """gate AS (
  SELECT batch, count(*) AS n_files,
    arg_min(path, page_id) FILTER (WHERE reason IS NOT NULL) AS first_path,
    arg_min(reason, page_id) FILTER (WHERE reason IS NOT NULL) AS first_reason,
    count(*) FILTER (WHERE reason IS NOT NULL) = 0 AS allowed
  FROM g GROUP BY batch)"""

ORACLE["gated_write"] = f"""WITH {PATHS}, {PATH_PARTS},
g AS (SELECT page_id, path, dir AS batch, {policy_reason("'write'", 'true')} AS reason FROM path_parts),
{GATE}
SELECT *, CASE WHEN allowed THEN 'written' ELSE 'refused' END AS status FROM gate"""

ORACLE["delete_by_key"] = f"""WITH {PATHS}, {PATH_PARTS},
g AS (SELECT page_id, path, dir AS batch,
        {policy_reason("'delete'", 'EXISTS (SELECT 1 FROM paths e WHERE e.path = resolved)')} AS reason
      FROM path_parts WHERE operation = 'delete'),
{GATE}
SELECT * FROM paths p WHERE NOT EXISTS (
  SELECT 1 FROM g JOIN gate USING (batch) WHERE gate.allowed AND g.path = p.path)"""

STORED = f"""{PATHS}, {PATH_PARTS},
judged AS (SELECT page_id, path, concat(CAST(page_id % 5 AS VARCHAR), '-', CAST(page_id // 20 AS VARCHAR)) AS batch,
             page_id // 20 AS n, {policy_reason("'write'", 'true')} IS NULL AS fine FROM path_parts),
first_write AS (SELECT batch, bool_and(fine) AS fine FROM judged GROUP BY batch),
second_write AS (SELECT batch, bool_and(fine) AS fine FROM judged WHERE n % 4 = 0 AND page_id % 20 < 5 GROUP BY batch),
stored AS (SELECT j.page_id, j.path, j.batch FROM judged j JOIN first_write f USING (batch) LEFT JOIN second_write s USING (batch)
           WHERE CASE WHEN s.fine THEN j.page_id % 20 < 5 ELSE f.fine END)"""
ORACLE["gated_write_files"] = f"WITH {STORED} SELECT * FROM stored"
DELETES = f"""{STORED},
g AS (SELECT page_id, path, concat(CAST(page_id % 5 AS VARCHAR), '-', CAST(page_id // 20 AS VARCHAR)) AS batch,
        {policy_reason("'delete'", 'EXISTS (SELECT 1 FROM stored e WHERE e.path = resolved)')} AS reason
      FROM path_parts WHERE operation = 'delete'),
{GATE}"""
ORACLE["gated_delete_files"] = f"""WITH {DELETES}
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM g JOIN gate USING (batch) WHERE gate.allowed AND g.path = s.path)"""
ORACLE["delete_report"] = f"WITH {DELETES} SELECT *, CASE WHEN allowed THEN 'deleted' ELSE 'refused' END AS status FROM gate"

# ------------------------------------------------------------ text and JSON
MIXED = " ".join(f"WHEN {i} THEN {lit(b)}" for i, b in enumerate(MIXED_BODIES))
LLM_MIXED = f"""llm_mixed AS (
  SELECT event_id AS id, CASE event_id % 20 {MIXED} ELSE props END AS cleaned FROM events),
-- DuckDB lets a comma stand before a closing brace; JSON doesn't
mixed AS (SELECT *, coalesce(json_valid(json_text) AND NOT regexp_matches(json_text, ',[[:space:]]*}}'), false) AS valid FROM (
  SELECT *, nullif(regexp_extract(cleaned, '(?s)\\{{.*\\}}', 0), '') AS json_text FROM llm_mixed)),
typed AS (SELECT *, CASE WHEN valid THEN json_type(json_extract(json_text, '$.k')) END AS k_type,
  CASE WHEN valid THEN json_type(json_extract(json_text, '$.strategy')) END AS s_type FROM mixed)"""

ORACLE["llm_json_extract"] = f"WITH {LLM} SELECT id, json_text, CAST(k AS DOUBLE) AS k FROM parsed"

ORACLE["schema_contract"] = f"""WITH {LLM_MIXED}
SELECT id, CAST(k AS DOUBLE) AS k, CASE WHEN reason IS NULL THEN 'ok' ELSE 'quarantine' END AS status, reason FROM (
  SELECT id, k, CASE WHEN json_text IS NULL THEN 'no_json' WHEN NOT valid THEN 'bad_json'
      WHEN k_type IS NULL THEN 'missing:k' WHEN k IS NULL THEN 'type:k'
      WHEN k NOT IN ({', '.join(str(i) for i in B.K_ENUM)}) THEN 'enum:k' END AS reason
  FROM (SELECT *, CASE WHEN k_type IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(json_text, '$.k') AS BIGINT) END AS k
        FROM typed))"""

_HEAD, _TAIL = STRATEGY_LINE.split("{s}")
ORACLE["json_remainder_summary"] = f"""WITH {LLM_MIXED}
SELECT id, CASE WHEN valid THEN concat(
    coalesce(nullif({js_trim("regexp_replace(cleaned, '(?s)\\{.*\\}', '', 'g')")}, ''), {lit(NO_SUMMARY_TEXT)}),
    {lit(_HEAD.replace(chr(10), "<NL>"))},
    CASE WHEN s_type IS NULL THEN 'undefined' WHEN s_type = 'NULL' THEN 'null'
         ELSE json_extract_string(json_text, '$.strategy') END,
    {lit(_TAIL.replace(chr(10), "<NL>"))}) END AS summary
FROM typed""".replace("<NL>", "' || chr(10) || '")

ORACLE["truncate_with_length"] = """SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), chr(10),
  '... [TRUNCATED, TOTAL LENGTH: ', CAST(length(text) AS VARCHAR), ']') ELSE text END AS truncated FROM documents"""

ORACLE["namespaced_name"] = f"""WITH {TOOL_CATALOG}
SELECT seq, concat(regexp_replace(brand, '[^a-zA-Z0-9_-]', '_', 'g'), '_', tool) AS name FROM tool_catalog"""

ORACLE["conversation_format"] = """SELECT conv_id, turn // 1024 AS part,
  string_agg(concat(r, ': ', text), chr(10) ORDER BY turn) AS transcript
FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS r
      FROM conversations WHERE role IS DISTINCT FROM 'system') GROUP BY conv_id, turn // 1024"""

ORACLE["ordered_concat"] = """SELECT conv_id, turn // 1024 AS part, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, turn // 1024"""

ORACLE["conversation_parts"] = f"""SELECT conv_id, turn // {B.PART_ROWS} AS part,
  string_agg(concat(r, ': ', text), chr(10) ORDER BY turn) AS transcript
FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS r
      FROM conversations WHERE role IS DISTINCT FROM 'system') GROUP BY conv_id, turn // {B.PART_ROWS}"""

ORACLE["ordered_concat_parts"] = f"""SELECT conv_id, turn // {B.PART_ROWS} AS part,
  string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // {B.PART_ROWS}"""

ORACLE["text_block_concat"] = "SELECT conv_id, turn, concat(role, chr(10), text) AS content FROM conversations"

ORACLE["role_filter_remap"] = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text
FROM conversations WHERE role IS DISTINCT FROM 'system'"""

ORACLE["tool_output_context"] = f"""WITH parts AS (
  SELECT conv_id, turn // {B.PART_ROWS} AS part,
    string_agg(concat({lit(TOOL_OUTPUT_PREFIX)}, CASE WHEN conv_id % 5 <> 0 THEN text ELSE 'null' END), chr(10) ORDER BY turn)
      AS context
  FROM conversations WHERE role = 'system' GROUP BY conv_id, turn // {B.PART_ROWS})
SELECT * FROM parts
UNION ALL
SELECT DISTINCT conv_id, 0 AS part, {lit(NO_DISCOVERY_TEXT)} AS context FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.conv_id = c.conv_id)"""


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {lit(w.lower())})" for w in words) + ")"


def _all(col: str, words) -> str:
    return _any(col, words).replace(" OR ", " AND ")


ORACLE["keyword_assert"] = ("SELECT doc_id, " + ", ".join(f"{_any('text', ws)} AS {n}" for n, ws in B.KEYWORD_CHECKS.items())
                            + ", " + ", ".join(f"{_all('text', ws)} AS {n}" for n, ws in B.KEYWORD_ALL.items())
                            + ", " + " AND ".join([_any('text', ws) for ws in B.KEYWORD_CHECKS.values()]
                                                  + [_all('text', ws) for ws in B.KEYWORD_ALL.values()])
                            + " AS passed FROM documents")

ORACLE["error_classify"] = f"""SELECT doc_id, CASE WHEN starts_with(text, 'Command failed:') THEN 'failed'
  WHEN {_any('text', ['entitynotfoundexception', 'not found', 'does not exist'])} THEN 'not_found'
  WHEN {_any('text', ['error'])} THEN 'error' ELSE 'ok' END AS error_class FROM documents"""

ORACLE["text_line_scan"] = f"""WITH {CONVS_LINES}
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS path, line_no, line FROM lines"""

ORACLE["text_file_scan"] = f"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
-- each file ends with a line break, so it has a last empty line
SELECT lang, count(*) + 1 AS n_lines, count(*) + 1 AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM l GROUP BY lang"""

ORACLE["regex_grep"] = f"""WITH {CONVS_LINES}
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS path, line_no,
  concat('doc-', CAST(doc_id AS VARCHAR), ':', CAST(line_no AS VARCHAR), ': ', {js_trim('line')}) AS match
FROM lines WHERE regexp_matches(line, {lit(B.GREP_PATTERN)})"""

ORACLE["indexed_grep"] = ORACLE["regex_grep"].replace(lit(B.GREP_PATTERN), lit(B.INDEXED_PATTERN))

ORACLE["capped_matches"] = f"""WITH {CONVS_LINES}
SELECT doc_id, line_no, concat(CAST(doc_id AS VARCHAR), ':', CAST(line_no AS VARCHAR), ': ', {js_trim('line')}) AS match
FROM lines WHERE regexp_matches(line, {lit(B.CAPPED_PATTERN)}) ORDER BY doc_id, line_no LIMIT 50"""

ORACLE["numbered_topk"] = """WITH top AS (
  SELECT page_id AS id, length(html) AS score, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url,
    regexp_replace(html, '<[^>]*>', '', 'g') AS snippet
  FROM pages ORDER BY score DESC, page_id LIMIT 3),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM top)
SELECT rank, id, score, concat('[', CAST(rank AS VARCHAR), '] ', title, chr(10), 'URL: ', url, chr(10),
  'Snippet: ', snippet, chr(10)) AS result FROM r"""

# ------------------------------------------------------------ registry
ORACLE["registry_flatten"] = """SELECT concat('srv-', CAST(p_partkey AS VARCHAR)) AS server, 'docker' AS command,
  unnest(CASE WHEN p_size % 10 = 0 THEN [NULL::VARCHAR] ELSE string_split(p_name, ' ') END) AS tool
FROM part"""

ORACLE["registry_union"] = f"WITH {TOOL_CATALOG}, {UNION_TOOLS} SELECT * FROM tools"

ORACLE["upsert_last_wins"] = f"""WITH {TOOL_CATALOG},
regs AS (SELECT concat(server, '_', regexp_extract(tool, '_([a-z]+)$', 1)) AS name, seq, brand FROM tool_catalog)
SELECT name, max(seq) AS seq, arg_max(brand, seq) AS brand, count(*) - 1 AS overwrites FROM regs GROUP BY name"""

ORACLE["registry_kept"] = ORACLE["upsert_last_wins"]

ORACLE["include_semi"] = f"""WITH {TOOL_CATALOG},
inc AS (SELECT DISTINCT server, tool FROM tool_catalog WHERE server <> 'aws-documentation' AND size > 25)
SELECT seq, server, tool FROM tool_catalog o
WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.server = o.server)
   OR EXISTS (SELECT 1 FROM inc i WHERE i.server = o.server AND i.tool = o.tool)"""

_RULE_ROWS = [(r, k, t.lower(), c) for r, k, t, c in ROLE_RULES]
ORACLE["role_grants"] = f"""WITH {TOOL_CATALOG}, {UNION_TOOLS},
rr AS {values(_RULE_ROWS, ['role', 'kind', 'text', 'contains'])}
SELECT DISTINCT rr.role, t.source, t.name FROM tools t JOIN rr ON
  (rr.kind = 'exact' AND lower(t.name) = rr.text)
  OR (rr.kind = 'prefix' AND starts_with(lower(t.name), rr.text))
  OR (rr.kind = 'prefix_contains' AND starts_with(lower(t.name), rr.text)
      AND len(list_filter(rr.contains, lambda c: contains(lower(t.name), c))) > 0)"""

ORACLE["variable_resolution"] = """WITH e AS (
  SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN concat('$NATION_', CAST(s_nationkey AS VARCHAR))
      WHEN 1 THEN concat('$MISSING_', CAST(s_suppkey AS VARCHAR)) ELSE s_name END AS value FROM supplier),
env AS (SELECT concat('NATION_', CAST(n_nationkey AS VARCHAR)) AS name,
          CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS env_value FROM nation)
SELECT s_suppkey, value,
  CASE WHEN starts_with(value, '$') THEN coalesce(env_value, '') ELSE value END AS resolved,
  starts_with(value, '$') AND nullif(env_value, '') IS NULL AS unresolved
FROM e LEFT JOIN env ON starts_with(e.value, '$') AND env.name = substring(e.value, 2)"""

ORACLE["uri_build_check"] = """WITH d AS (
  SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS bucket,
    CASE WHEN s_suppkey % 4 = 0 THEN concat(lower(replace(s_name, '#', '-')), '/raw/data.csv')
      ELSE concat('raw/', CAST(s_suppkey AS VARCHAR), '.csv') END AS key FROM supplier)
SELECT s_suppkey, concat('s3://', bucket, '/', key) AS uri, starts_with(key, concat(bucket, '/')) AS doubled_bucket FROM d"""

ORACLE["layered_defaults"] = f"""WITH dflt AS {values(B.SETTINGS_DEFAULTS, ['section', 'key', 'value'])},
loaded AS (
  SELECT tenant, s.section AS section, s.key AS key, s.value AS value FROM (
    SELECT c_custkey AS tenant, unnest(CASE
      WHEN c_custkey % 3 = 0 THEN [{{'section': 'preferences', 'key': 'confirmationMode', 'value': 'auto'}},
                                   {{'section': 'preferences', 'key': 'theme', 'value': 'dark'}}]
      WHEN c_custkey % 3 = 1 THEN [{{'section': 'safety', 'key': 'blockedCommands', 'value': '["sudo"]'}}]
      ELSE [{{'section': 'pulumi', 'key': 'stack', 'value': c_mktsegment}}] END) AS s
    FROM customer)),
replaced AS (SELECT DISTINCT tenant, section FROM loaded
  WHERE section NOT IN ({', '.join(lit(s) for s in B.LOAD_MERGE_SECTIONS)})),
base AS (SELECT c.c_custkey AS tenant, d.section, d.key, d.value, 0 AS layer FROM customer c, dflt d
  WHERE NOT EXISTS (SELECT 1 FROM replaced r WHERE r.tenant = c.c_custkey AND r.section = d.section)),
both_ AS (SELECT * FROM base UNION ALL SELECT tenant, section, key, value, 1 AS layer FROM loaded)
SELECT tenant, section, key, arg_max(value, layer) AS value, max(layer) AS layer FROM both_ GROUP BY tenant, section, key"""

ORACLE["settings_update"] = f"""WITH cur AS ({ORACLE["layered_defaults"]}),
request AS (
  SELECT tenant, s.section AS section, s.key AS key, s.value AS value FROM (
    SELECT c_custkey AS tenant, unnest(CASE c_custkey % 4
      WHEN 0 THEN [{{'section': 'preferences', 'key': 'confirmationMode', 'value': 'auto'}}]
      WHEN 1 THEN [{{'section': 'allowList', 'key': 'commands', 'value': '["ls"]'}}]
      WHEN 2 THEN [{{'section': 'pulumi', 'key': 'backend', 'value': 'local'}}]
      ELSE [] END) AS s FROM customer))
SELECT tenant, section, key, value, 1 AS layer FROM request
UNION ALL
SELECT tenant, section, key, value, 0 AS layer FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM request r WHERE r.tenant = c.tenant AND r.section = c.section
                    AND (r.section = 'allowList' OR r.key = c.key))"""

LISTING = """listing AS (SELECT url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS length,
  TIMESTAMP '1970-01-01 00:00:00' + page_id * INTERVAL 60 SECOND AS modificationTime,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS prefix FROM pages)"""

ORACLE["object_listing"] = f"""WITH {LISTING}
SELECT path, length, modificationTime FROM listing WHERE starts_with(path, 'https://')"""

ORACLE["storage_usage"] = f"""WITH {LISTING}
SELECT prefix, count(*) AS n_objects, CAST(sum(length) AS BIGINT) AS total_bytes, max(modificationTime) AS last_modified
FROM listing GROUP BY prefix"""

ORACLE["output_existence"] = f"""WITH {LISTING},
expected AS (SELECT DISTINCT prefix FROM listing UNION ALL SELECT lower(n_name) AS prefix FROM nation),
per AS (SELECT prefix, count(*) AS n, sum(length) AS b FROM listing GROUP BY prefix)
SELECT e.prefix, coalesce(n, 0) AS n_objects, CAST(coalesce(b, 0) AS BIGINT) AS total_bytes,
  CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN b = 0 THEN 'empty' ELSE 'ok' END AS status,
  coalesce(n, 0) > 0 AND b > 0 AS passed
FROM expected e LEFT JOIN per ON per.prefix = e.prefix"""

ORACLE["binary_detect"] = """SELECT doc_id, doc_id % 9 = 0 AND octet_length(encode(text)) < 4000 AS is_binary FROM documents"""

ORACLE["corpus_search"] = f"""WITH f AS (
  SELECT concat('/w/CodeSandBox/d', lpad(CAST(doc_id AS VARCHAR), 8, '0'),
           CASE doc_id % 3 WHEN 0 THEN '.csv' ELSE '.py' END) AS path, text
  FROM documents WHERE doc_id % 5 > 1 AND doc_id % 3 < 2 AND doc_id % 11 <> 0),
l AS (SELECT path, unnest(arr) AS line, generate_subscripts(arr, 1) AS line_no
      FROM (SELECT path, string_split(text, chr(10)) AS arr FROM f))
SELECT path, line_no, concat(path, ':', CAST(line_no AS VARCHAR), ': ', {js_trim('line')}) AS match
FROM l WHERE regexp_matches(line, {lit(B.SEARCH_PATTERN)}) ORDER BY path, line_no LIMIT {SEARCH_CAP}"""

ORACLE["multi_read"] = """WITH req AS (SELECT doc_id AS req_id, concat('doc-', CAST(doc_id * 3 AS VARCHAR)) AS path FROM labels),
f AS (SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS path, text AS content FROM documents)
SELECT req_id, req.path,
  CASE WHEN content IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN content IS NULL THEN concat('[', req.path, ']: Error - file not found')
    ELSE concat('--- BEGIN ', req.path, ' ---', chr(10), CASE WHEN content = '' THEN '[File is empty]' ELSE content END,
                chr(10), '--- END ', req.path, ' ---') END AS result
FROM req LEFT JOIN f ON f.path = req.path"""

ORACLE["prefix_filter"] = "SELECT * FROM supplier WHERE starts_with(s_name, 'Supplier#0000000')"

ORACLE["pass_score"] = """SELECT lang AS suite, count(*) FILTER (WHERE ok) AS passed, count(*) AS total,
  count(*) FILTER (WHERE ok) = count(*) AS all_passed, count(*) FILTER (WHERE ok) / count(*) AS score
FROM (SELECT doc_id, quality = 1 AND toxic = 0 AND doc_id % 7 <> 0 AS ok FROM labels) l JOIN documents USING (doc_id) GROUP BY lang"""

ORACLE["tool_call_count"] = f"""WITH c AS (
  SELECT conv_id, CASE WHEN role = 'assistant' THEN list_filter(regexp_split_to_array(lower(text), '[^a-z_]+'),
      lambda w: w IN ({', '.join(lit(w) for w in B.TOOL_WORDS)})) ELSE [] END AS calls FROM conversations),
e AS (SELECT conv_id, unnest(calls) AS tool FROM c)
SELECT conv_id, tool, count(*) AS n_calls FROM e GROUP BY conv_id, tool
UNION ALL
SELECT conv_id, NULL AS tool, 0 AS n_calls FROM c GROUP BY conv_id HAVING sum(len(calls)) = 0"""

# ------------------------------------------------------------ sources and streams with table twins
ORACLE["resolve_source"] = "SELECT * FROM orders"

ORACLE["incremental_copy"] = "SELECT * FROM events"

ORACLE["resolve_source_catalog"] = "SELECT * FROM customer"

ORACLE["update_stream"] = ORACLE["node_update"]

ORACLE["streaming_context"] = ORACLE["state_map_merge"]

ORACLE["stream_ack_join"] = f"""SELECT event_id AS req_id, user_id AS req_user, ts AS req_ts, answer_id, answer_ts, decision
FROM ({ORACLE["ack_interval_join"]})"""

ORACLE["streaming_state"] = f"""WITH {STATE_LOG}
SELECT session_id,
  coalesce(arg_max(current_step, seq) FILTER (WHERE current_step IS NOT NULL), 'reception') AS current_step,
  coalesce(arg_max(execution_strategy, seq) FILTER (WHERE execution_strategy IS NOT NULL), 'PENDING') AS execution_strategy,
  coalesce(arg_max(deployment_status, seq) FILTER (WHERE deployment_status IS NOT NULL), 'PENDING') AS deployment_status,
  coalesce(arg_max(diagram, seq) FILTER (WHERE diagram IS NOT NULL), '{{"nodes":[],"edges":[]}}') AS diagram,
  arg_max(cloud_plan, seq) FILTER (WHERE cloud_plan IS NOT NULL) AS cloud_plan,
  coalesce(arg_max(workspace_path, seq) FILTER (WHERE workspace_path IS NOT NULL), '') AS workspace_path,
  arg_max_null(validation_errors, seq) FILTER (WHERE has_validation_errors) AS validation_errors,
  CAST(sum({RETRY_INC}) AS BIGINT) AS retry_count
FROM state_log GROUP BY session_id"""

ORACLE["poll_until_terminal"] = """WITH runs AS (
  SELECT o_custkey AS job, o_orderkey AS run_id, o_orderdate AS ts,
    CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status FROM orders)
SELECT job, arg_max(status, {'ts': ts, 'id': run_id}) AS latest_status, min(ts) AS first_seen, max(ts) AS last_seen,
  count(*) AS n_polls, arg_max(status, {'ts': ts, 'id': run_id}) IN ('SUCCEEDED', 'FAILED') AS is_terminal
FROM runs GROUP BY job"""
