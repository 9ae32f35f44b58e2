"""Tool registry, settings and rule tables as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.functions.text import namespaced_name
from runfold.operators.policy import prefix_probes

# FIXED VALUES: local tool groups (file system, terminal, web) by name.
LOCAL_TOOL_GROUPS = {
    "fs": ["read_files", "write_files", "delete_files", "list_files", "search_file_content"],
    "terminal": ["execute_command", "setup_environment"],
    "web": ["search_web"],
}

# FIXED VALUES: role grants. kind = exact name, prefix, or prefix plus any of
# the listed substrings. Names are compared in lower case.
ROLE_RULES = [
    ("architect", "exact", "search_web", None),
    ("architect", "prefix", "aws-api", None),
    ("architect", "prefix", "azure-catalog", None),
    ("architect", "prefix", "aws-documentation", None),
    ("architect", "prefix_contains", "aws-data-processing", ["list", "get", "analyze", "describe"]),
    ("pipeline-coder", "exact", "read_files", None),
    ("pipeline-coder", "exact", "write_files", None),
    ("pipeline-coder", "exact", "delete_files", None),
    ("pipeline-coder", "exact", "list_files", None),
    ("pipeline-coder", "exact", "search_file_content", None),
    ("pipeline-coder", "exact", "execute_command", None),
    ("pipeline-coder", "exact", "setup_environment", None),
    ("pipeline-coder", "exact", "search_web", None),
    ("pipeline-coder", "prefix", "aws-documentation", None),
    ("pipeline-coder", "exact", "aws-data-processing_upload_to_s3", None),
    ("data-ops", "exact", "search_web", None),
    ("data-ops", "prefix", "aws-api", None),
    ("data-ops", "prefix", "aws-data-processing", None),
    ("data-ops", "prefix", "azure-catalog", None),
    ("data-ops", "exact", "execute_command", None),
]


def local_tools(spark: SparkSession) -> DataFrame:
    rows = [(g, t) for g, ts in LOCAL_TOOL_GROUPS.items() for t in ts]
    return spark.createDataFrame(rows, "source string, name string")


def role_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_RULES, "role string, kind string, text string, contains array<string>")


# ------------------------------------------------------------------ X7 / U1
def remote_tools(flat: DataFrame, server: str = "server", tool: str = "tool") -> DataFrame:
    """Namespaced remote tool names ``server_tool`` (X7) with their source."""
    return flat.select(F.col(server).alias("source"), namespaced_name(server, tool).alias("name"), *[
        c for c in flat.columns if c not in (server, tool)])


def registry_union(*groups: DataFrame) -> DataFrame:
    """All tool groups into one registry (UNION ALL by name)."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ W5
def upsert_last_wins(registrations: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """One entry per name, the latest registration wins; ``overwrites``
    counts the earlier registrations it replaced. One partial aggregate per
    name (no per-name sort), so a hot name is combined map-side."""
    others = [c for c in registrations.columns if c != name]
    return (registrations.groupBy(name)
            .agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(seq)).alias("__w"),
                 (F.count(F.lit(1)) - 1).alias("overwrites"))
            .select(name, *[F.col("__w").getField(c).alias(c) for c in others], "overwrites"))


# ------------------------------------------------------------------ J3
def include_semi(offered: DataFrame, include: DataFrame, server: str = "server",
                 tool: str = "tool") -> tuple[DataFrame, DataFrame]:
    """Keep offered tools that are on their server's include list; a
    server with no list keeps all. Returns ``(kept, report)`` where the report
    has, per server, offered / kept / excluded counts."""
    listed = include.select(server, tool).distinct()
    servers = include.select(server).distinct()
    # a semi join on (server, tool) and an anti join on the distinct servers: no key
    # meets more than one row of the other side, and skewed offers can be split
    kept = offered.join(servers, server, "left_anti").unionByName(offered.join(listed, [server, tool], "left_semi"))
    n = lambda df, name: df.groupBy(server).agg(F.count(F.lit(1)).alias(name))
    both = n(offered, "n_offered").withColumnRenamed(server, "__s")
    counts = n(kept, "n_kept")
    report = (both.join(counts, both["__s"].eqNullSafe(counts[server]), "left")
                  .select(F.col("__s").alias(server), "n_offered", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
                  .withColumn("n_excluded", F.col("n_offered") - F.col("n_kept")))
    return kept, report


# ------------------------------------------------------------------ J4
def role_grants(tools: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Which tool each role may use: exact, prefix, and prefix-plus-any-
    substring rules on the lower-cased name (substring checks run on the whole
    namespaced name, so ``get`` also hits inside words).

    Equalities only, whatever the number of rules: a name is probed whole and with
    its prefixes of the lengths that prefix rules have; substrings are checked on
    the matches. Grants are found per distinct name and joined back, so a tool
    row comes out once per role however many rules grant it."""
    lo = F.lower(F.col("text"))
    exact = rules.where(F.col("kind") == "exact").select("role", lo.alias("__probe"), F.lit(None).cast("array<string>").alias("__c"),
                                                         F.lit(True).alias("__whole"))
    prefix = rules.where(F.col("kind").isin("prefix", "prefix_contains")).select(
        "role", lo.alias("__probe"), F.when(F.col("kind") == "prefix_contains", F.coalesce("contains", F.array())).alias("__c"),
        F.lit(False).alias("__whole"))
    lengths = prefix.select(F.collect_set(F.length("__probe"))).scalar()
    n = F.col("__name")
    names = tools.select(F.lower(F.col(name)).alias("__name")).distinct().withColumn("__lengths", lengths)
    probes = names.select("__name", F.explode(prefix_probes(n, F.col("__lengths"))).alias("__probe"), F.lit(False).alias("__whole")) \
        .unionByName(names.select("__name", n.alias("__probe"), F.lit(True).alias("__whole")))
    granted = (probes.join(exact.unionByName(prefix), ["__probe", "__whole"])
                     .where(F.col("__c").isNull() | F.exists(F.coalesce("__c", F.array().cast("array<string>")),
                                                             lambda c: F.contains(n, c)))
                     .select("role", "__name").distinct())
    return tools.withColumn("__name", F.lower(F.col(name))).join(granted, "__name").select("role", *tools.columns)


# ------------------------------------------------------------------ J5
def variable_resolution(entries: DataFrame, env: DataFrame, value: str = "value",
                        env_name: str = "name", env_value: str = "env_value") -> DataFrame:
    """Values starting with ``$`` are replaced by the named environment
    value (``''`` when absent); other values are kept. ``unresolved`` flags a
    reference whose variable is absent or empty. Equi join on the name."""
    v = F.col(value)
    is_ref = F.coalesce(F.startswith(v, F.lit("$")), F.lit(False))
    # only references take part in the join: literal values (often most rows)
    # would all share a NULL join key and land in one shuffle partition
    refs = entries.where(is_ref).withColumn("__ref", F.substring(v, 2, 1 << 30))
    e = env.select(F.col(env_name).alias("__ref"), F.col(env_value).alias("__val"))
    resolved = (refs.join(e, "__ref", "left")
                    .withColumn("resolved", F.coalesce(F.col("__val"), F.lit("")))
                    .withColumn("unresolved", F.nullif(F.col("__val"), F.lit("")).isNull())
                    .drop("__ref", "__val"))
    literals = (entries.where(~is_ref)
                       .withColumn("resolved", v)
                       .withColumn("unresolved", F.lit(False)))
    return resolved.unionByName(literals)


# ------------------------------------------------------------------ X8
def uri_build_check(df: DataFrame, bucket: str = "bucket", key: str = "key", scheme: str = "s3") -> DataFrame:
    """``s3://bucket/key``; ``doubled_bucket`` flags keys that repeat the
    bucket name as their first component."""
    b, k = F.col(bucket), F.col(key)
    return (df.withColumn("uri", F.concat(F.lit(f"{scheme}://"), b, F.lit("/"), k))
              .withColumn("doubled_bucket", F.startswith(k, F.concat(b, F.lit("/")))))


# ------------------------------------------------------------------ X9
#: Defaults whose bits are in one number, and the least number of tasks that hold whole settings.
MASK_BITS = 32
LAYER_TASKS = 256


def layered_defaults(settings: DataFrame, defaults: list[tuple[str, str, str]], tenants: DataFrame,
                     merge_sections: list[str], tenant: str = "tenant") -> DataFrame:
    """Effective settings per tenant.

    ``settings(tenant, section, key, value)`` is the loaded layer,
    ``defaults`` the base layer as ``(section, key, value)`` tuples. Sections in
    ``merge_sections`` merge one level (per key, the loaded value wins);
    any other section present in the loaded layer replaces the default
    section whole. Defaults are a fixed small table: what a tenant's settings take
    away is one bit per default, and a generator expands the rest behind the last
    shuffle, so only tenants and settings are shuffled, never default values."""
    top: dict[tuple, str | None] = {}  # of a key's repeats the greatest value counts
    for s, k, v in defaults:
        if (s, k) not in top or (v is not None and (top[s, k] is None or v > top[s, k])):
            top[s, k] = v
    rows = [(*at, v) for at, v in top.items()]
    words = range(0, len(rows), MASK_BITS)

    def hits(s, k):
        """Whether a setting takes this default away: by its key, or its section whole."""
        merged = F.coalesce(F.col("section").isin(*merge_sections), F.lit(False))
        return F.col("section").eqNullSafe(F.lit(s)) & (~merged | F.col("key").eqNullSafe(F.lit(k)))

    def mask(lo):
        bits = [F.when(hits(s, k), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (s, k, _) in enumerate(rows[lo:lo + MASK_BITS])]
        return reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"__m{lo}")

    none = F.lit(0).cast("bigint")
    marked = tenants.select(tenant, F.lit(True).alias("__own"), *[none.alias(f"__m{lo}") for lo in words]).unionByName(
        settings.select(tenant, F.lit(False).alias("__own"), *[mask(lo) for lo in words]))
    gone = marked.groupBy(tenant).agg(F.bool_or("__own").alias("__own"), *[F.bit_or(f"__m{lo}").alias(f"__m{lo}") for lo in words])
    arr = F.array(*[F.struct(F.lit(s).cast("string").alias("section"), F.lit(k).cast("string").alias("key"),
                             F.lit(v).cast("string").alias("value"), F.lit(i).alias("at")) for i, (s, k, v) in enumerate(rows)])
    word = F.col("__m0") if len(words) == 1 else F.element_at(F.array(*[f"__m{lo}" for lo in words]), F.expr(f"at div {MASK_BITS} + 1").cast("int"))
    base = (gone.where("__own").select(tenant, *[f"__m{lo}" for lo in words], F.inline(arr))
                .where(F.expr("cast(1 as bigint)").bitwiseAND(F.call_function("shiftright", word, (F.col("at") % MASK_BITS).cast("int"))) == 0)
                .select(tenant, "section", "key", "value", F.lit(0).alias("layer"))) if rows else None
    own = settings.groupBy(tenant, "section", "key").agg(F.max("value").alias("value")).withColumn("layer", F.lit(1))
    return own if base is None else base.unionByName(own)


def _layered(base: DataFrame, over: DataFrame, merge_sections: list[str], tenant: str) -> DataFrame:
    """``base`` rows with ``over`` laid on top. A replaced section drops its base rows by
    an anti join; then the higher layer wins per key. Of a key's repeated rows in a layer
    the greatest value counts. Only the replaced sections are built into tables, and rows
    are sorted once, in tasks whose number is given: values that compress well would
    otherwise make few large ones."""
    merged = F.coalesce(F.col("section").isin(*merge_sections), F.lit(False))
    gone = over.where(~merged).select(F.col(tenant).alias("__t"), F.col("section").alias("__s")).distinct().hint("shuffle_hash")
    kept = base.join(gone, F.col(tenant).eqNullSafe(F.col("__t")) & F.col("section").eqNullSafe(F.col("__s")), "left_anti")
    tasks = max(LAYER_TASKS, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = kept.select(tenant, "section", "key", "value", F.lit(0).alias("layer")) \
        .unionByName(over.select(tenant, "section", "key", "value", F.lit(1).alias("layer")))
    return both.repartition(tasks, tenant, "section", "key").groupBy(tenant, "section", "key").agg(F.max(F.struct("layer", "value")).alias("__top")) \
        .select(tenant, "section", "key", F.col("__top.value").alias("value"), F.col("__top.layer").alias("layer"))


# FIXED VALUES: how a settings request treats the sections it may change.
UPDATE_MERGED = ["preferences", "pulumi"]
UPDATE_REPLACED = ["allowList"]


def settings_update(current: DataFrame, request: DataFrame, tenant: str = "tenant") -> DataFrame:
    """X9, update mode: a request laid over the current settings. ``preferences``
    and ``pulumi`` merge by key, ``allowList`` is replaced whole; any other section
    of the request is ignored, so no request can touch the safety lists."""
    taken = request.where(F.col("section").isin(*UPDATE_MERGED, *UPDATE_REPLACED))
    return _layered(current, taken, UPDATE_MERGED, tenant)
