"""The test tables, and run-log / policy inputs derived from them.

Each derived input is a pure projection (no filter, no sample) of a base table,
so its size grows with the table. The same definitions, as SQL, back the DuckDB
oracle (``runfold.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-state update log: one row per finished node (from ``events``).

    ``has_*`` flags keep an absent key apart from a present NULL."""
    return state_log_from(table(spark, sf_dir, "events"))


def state_log_from(e: DataFrame) -> DataFrame:
    """``state_log`` over any events frame (batch or streaming)."""
    et = F.col("event_type")
    node = (F.when(et == "signup", "architect").when(et == "view", "pipeline-coder")
             .when(et.isin("error", "purchase"), "deployer").otherwise("data-ops"))
    step = (F.when(et == "signup", "planning").when(et == "view", "pipeline-coding")
             .when(et == "error", "deploying-failed").when(et == "purchase", "deployment-success"))
    status = F.when(et == "error", "FAILED").when(et == "purchase", "SUCCESS")
    strategy = F.when(et == "signup", F.when(F.col("value") > 50, "DATA_ANALYSIS").otherwise("GREENFIELD"))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts",
        node.alias("node"), step.alias("current_step"), status.alias("deployment_status"),
        strategy.alias("execution_strategy"),
        et.isin("error", "purchase").alias("has_validation_errors"),
        F.when(et == "error", F.concat(F.lit("err-"), F.col("event_id").cast("string"))).alias("validation_errors"),
        ((et == "error") & (F.col("event_id") % 5 != 0)).alias("has_retry"),
        F.when((et == "error") & (F.col("event_id") % 3 == 0), F.lit(1)).alias("retry_inc"),
        et.alias("map_key"), "props",
        F.when(et == "signup", F.concat(F.lit('{"nodes":['), F.col("event_id").cast("string"), F.lit("]}"))).alias("diagram"),
        F.when(et == "view", F.col("props")).alias("cloud_plan"),
        F.when(et == "purchase", F.concat(F.lit("/w/s"), F.col("user_id").cast("string"))).alias("workspace_path"),
        F.when(et == "view", F.concat(F.lit("code "), F.col("event_id").cast("string"))).alias("code_pulumi"),
        F.when(et == "click", F.concat(F.lit("job "), F.col("event_id").cast("string"))).alias("code_pyspark"))


def with_messages(log: DataFrame) -> DataFrame:
    """``state_log`` with each update's message list: text, not text, or none."""
    msg = F.struct(F.lit("assistant").alias("role"), F.col("props").alias("content"))
    return log.withColumn("messages", (
        F.when(F.col("map_key").isin("click", "view"), F.array(msg.withField("is_text", F.lit(True))))
         .when(F.col("map_key") == "purchase", F.array(msg.withField("is_text", F.lit(False))))
         .otherwise(F.array().cast("array<struct<role:string,content:string,is_text:boolean>>"))))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty sales rows (padded, mixed-case e-mails, padded money text)."""
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_custkey") % 10 == 0, F.lit(" invalid-email")).otherwise(
        F.concat(F.lit(" "), F.upper(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@Example.com ")))
    amount = F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), email.alias("customer_email"),
                    amount.alias("amount"), "c_nationkey")


def raw_customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_customers`` as lines of a delimited file, some with a field too many, some
    cut after the second, some with a quote that is never closed."""
    c = raw_customers(spark, sf_dir)
    k, rest = F.col("id"), F.concat_ws(",", "customer_email", "amount", "c_nationkey")
    line = (F.when(k % 10 == 3, F.concat_ws(",", "id", rest, F.lit("EXTRA")))
             .when(k % 10 == 7, F.concat_ws(",", "id", "customer_email"))
             .when(k % 20 == 9, F.concat(k.cast("string"), F.lit(',"'), rest))
             .when(k % 20 == 1, F.concat(k.cast("string"), F.lit(',"'), F.col("customer_email"), F.lit('",'),
                                         F.concat_ws(",", "amount", "c_nationkey")))
             .otherwise(F.concat_ws(",", "id", rest)))
    return c.select(line.alias("value"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delimited-text rows: padded money text and ISO date text."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
                    F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("date"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log (from ``part``)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cmd = (F.when(k % 5 == 0, F.concat(F.lit("cd /w && sudo "), "p_name"))
            .when(k % 5 == 1, F.concat(F.lit("cd /w && "), "p_name"))
            .when(k % 5 == 2, F.concat(F.lit("sudo x && "), "p_name"))
            .when(k % 5 == 3, F.concat("p_name", F.lit(" --output-format json")))
            .otherwise(F.col("p_name")))
    op = F.when(k % 4 == 0, "read").when(k % 4 == 1, "write").otherwise("execute")
    return p.select(k.alias("req_id"), cmd.alias("command"), F.lit("commands").alias("category"),
                    op.alias("operation"))


RULES = [("commands", "small", "execute"), ("commands", "red", "all"),
         ("files", "/w/CodeSandBox", "write"), ("mcp", "aws-api_call_aws", "mcp")]


def rules(spark: SparkSession) -> DataFrame:
    """The allow-list rule table used with ``commands``."""
    return spark.createDataFrame(RULES, "category string, target string, operation string")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Already-normal file paths with a requested operation (from ``pages``)."""
    pg = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    d = (F.when(k % 5 == 0, "/w/CodeSandBox/").when(k % 5 == 1, "/w/CodeSandBox/dist/")
          .when(k % 5 == 2, "/w/other/").when(k % 5 == 3, "/etc/").otherwise("/w/CodeSandBox/.cache/"))
    ext = F.when(k % 7 == 0, ".sh").when(k % 7 == 1, ".py").when(k % 7 == 2, "").otherwise(".csv")
    op = F.when(k % 3 == 0, "read").when(k % 3 == 1, "write").otherwise("delete")
    return pg.select(k, F.concat(d, F.lit("p"), k.cast("string"), ext).alias("path"), op.alias("operation"))


def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of ``paths`` exist: pages served over https (a listing stand-in)."""
    pg = table(spark, sf_dir, "pages")
    p = paths(spark, sf_dir)
    return (p.join(pg.select("page_id", "url"), "page_id")
             .where(F.startswith(F.col("url"), F.lit("https://")))
             .select("path"))


def llm_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output with a think block, a fence and JSON (from ``events``)."""
    return llm_out_from(table(spark, sf_dir, "events"))


def llm_out_from(e: DataFrame) -> DataFrame:
    body = F.when(F.col("event_id") % 7 == 0, F.lit("no json")).otherwise(F.col("props"))
    raw = F.concat(F.lit("<think>"), "event_type", F.lit("</think>```json\n"), body, F.lit("\n```"))
    return e.select(F.col("event_id").alias("id"), raw.alias("raw"))


#: what a model may wrongly put where a whole number ``k`` is expected, by key
MIXED_BODIES = ['{"k": "12"}', '{"k": 1.7}', '{"k": null}', '{"strategy": "GREENFIELD",}', '{"strategy": null, "k": 3}',
                '{"k": {"a": 1}}', 'Sure. {"strategy": "DATA_ANALYSIS", "k": 5} Done.', '{"k": true}', '{"strategy": "GREENFIELD"}']


def llm_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output with invalid JSON, wrong types, JSON nulls and missing fields
    among the good rows (from ``events``)."""
    e = table(spark, sf_dir, "events")
    body = F.col("props")
    for i, b in enumerate(MIXED_BODIES):
        body = F.when(F.col("event_id") % 20 == i, F.lit(b)).otherwise(body)
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("<think>x</think>\n"), body).alias("raw"))


def tool_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote tools offered by servers (from ``part``): each part is a tool
    ``lower(p_name with '_')`` offered by one of four servers, by key."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    server = (F.when(k % 4 == 0, "aws-api").when(k % 4 == 1, "aws-data-processing")
               .when(k % 4 == 2, "aws-documentation").otherwise("azure-catalog"))
    tool = F.concat(F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), F.lit("_"), F.lower(F.col("p_type")))
    return p.select(k.alias("seq"), server.alias("server"), tool.alias("tool"),
                    F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def requests_from_commands(cmds: DataFrame) -> DataFrame:
    """Permission requests of a command log: the target is the base command
    of the last ``&&`` segment (what the allow-list is matched on)."""
    from runfold.operators.policy import actual_command, base_command
    return cmds.select("req_id", "category", "operation",
                       base_command(actual_command(F.col("command"))).alias("target"))


def timed_requests(requests: DataFrame) -> DataFrame:
    """Requests with the time they were made: one a second, by id."""
    return requests.withColumn("req_ts", F.timestamp_seconds(F.col("req_id")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval answers per request (from ``part``), given up to 500 s after it;
    NULL = no answer."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_size")
    a = (F.when(s % 4 == 0, "allow_always").when(s % 4 == 1, "allow_once")
          .when(s % 4 == 2, "deny"))
    return p.select(F.col("p_partkey").alias("req_id"), a.alias("answer"),
                    F.timestamp_seconds(F.col("p_partkey") + s * 10).alias("answer_ts"))


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job status polls (from ``orders``): job = customer, F/P/O = FAILED /
    SUCCEEDED / RUNNING, ordered by (date, order key)."""
    o = table(spark, sf_dir, "orders")
    st = (F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "SUCCEEDED")
           .otherwise("RUNNING"))
    return o.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run_id"),
                    F.col("o_orderdate").alias("ts"), st.alias("status"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file corpus ``(path, content)``: path ``doc-<id>``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"),
                    F.col("text").alias("content"), "doc_id")
