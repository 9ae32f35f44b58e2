"""Text, JSON-in-text and conversation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.constants import (FAILED_PREFIX, NO_DISCOVERY_TEXT, NO_SUMMARY_TEXT, SEARCH_CAP,
                               TOOL_OUTPUT_PREFIX, WEB_RESULTS)
from runfold.functions.text import contains_all, contains_any, drop_think_blocks, first_brace_span, js_trim, strict_parse_json, strip_fences
from runfold.operators.scan import CONCAT_WIDTH, DEFAULT_WIDTH, ordered_concat as _ordered_concat

# FIXED VALUES: the strategy line appended under the plan summary.
STRATEGY_LINE = ("\n\n✅ **Strategy Selected:** `{s}`\n⚙️ **Status:** Architecture map "
                 "generated successfully. Proceeding to next phase...")
# FIXED VALUES: keyword family of an entity-not-found failure.
NOT_FOUND_WORDS = ["entitynotfoundexception", "not found", "does not exist"]


# ------------------------------------------------------------------ X1
def clean_model_text(c) -> Column:
    """Model text → trim → drop think blocks → trim → drop one leading and one
    trailing fence → trim (JavaScript trim semantics throughout)."""
    s = js_trim(c)
    s = js_trim(drop_think_blocks(s))
    return js_trim(strip_fences(s))


def llm_json_extract(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``cleaned`` text, the greedy ``{…}`` span ``json_text`` (NULL when
    there is none) and ``parsed`` (VARIANT; NULL when not valid JSON)."""
    return (df.withColumn("cleaned", clean_model_text(F.col(raw)))
              .withColumn("json_text", first_brace_span("cleaned"))
              .withColumn("parsed", strict_parse_json(F.col("json_text"))))


#: contract type: the variant types that are of it (a whole number is a double too)
JSON_TYPES = {"bigint": "BIGINT", "long": "BIGINT", "int": "BIGINT", "double": r"DOUBLE|BIGINT|DECIMAL",
              "string": "STRING", "boolean": "BOOLEAN"}


# ------------------------------------------------------------------ X2
def schema_contract(extracted: DataFrame, fields: dict[str, str],
                    enums: dict[str, list] | None = None) -> DataFrame:
    """Check extracted JSON against a contract; add typed ``fields``,
    ``status`` (``ok`` / ``quarantine``) and the first failing ``reason``:
    ``no_json`` → ``bad_json`` → ``missing:<field>`` / ``type:<field>`` (present
    but not of the type, JSON null included) → ``enum:<field>``. The JSON type is
    checked before the value is read: ``"12"`` and ``1.7`` are no ``bigint``, an
    object is no ``string``; nothing is cast into the type.
    Split with ``where(status = 'ok')`` / ``where(status = 'quarantine')``."""
    d = extracted
    for f, t in fields.items():
        found = F.try_variant_get(F.col("parsed"), f"$.{f}", "variant")
        is_type = F.schema_of_variant(found).rlike(f"^(?:{JSON_TYPES[t.lower()]})")
        d = (d.withColumn(f"__has_{f}", found.isNotNull())
              .withColumn(f, F.when(is_type, F.try_variant_get(F.col("parsed"), f"$.{f}", t))))
    reason = F.when(F.col("json_text").isNull(), F.lit("no_json")).when(F.col("parsed").isNull(), F.lit("bad_json"))
    for f in fields:
        reason = (reason.when(~F.col(f"__has_{f}"), F.lit(f"missing:{f}"))
                        .when(F.col(f).isNull(), F.lit(f"type:{f}")))
    for f, allowed in (enums or {}).items():
        reason = reason.when(~F.col(f).isin(*allowed), F.lit(f"enum:{f}"))
    return (d.withColumn("reason", reason)
             .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("quarantine"))
             .drop(*[f"__has_{f}" for f in fields]))


def split_contract(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)`` from ``schema_contract`` output; the
    quarantine keeps each row's ``reason``."""
    return (checked.where(F.col("status") == "ok").drop("reason"),
            checked.where(F.col("status") == "quarantine"))


# ------------------------------------------------------------------ X3
def json_remainder_summary(extracted: DataFrame, strategy_field: str = "strategy") -> DataFrame:
    """The text left once the JSON span is cut out (or a fixed default),
    followed by the strategy line (an absent strategy prints ``undefined``, a JSON
    null ``null``). NULL for rows without valid JSON: those are quarantined, not
    summarised."""
    rest = js_trim(F.regexp_replace(F.col("cleaned"), "(?s)\\{.*\\}", ""))
    found = F.try_variant_get(F.col("parsed"), f"$.{strategy_field}", "variant")
    strategy = (F.when(found.isNull(), F.lit("undefined")).when(F.is_variant_null(found), F.lit("null"))
                 .otherwise(F.try_variant_get(F.col("parsed"), f"$.{strategy_field}", "string")))
    head, tail = STRATEGY_LINE.split("{s}")
    summary = F.concat(F.coalesce(F.nullif(rest, F.lit("")), F.lit(NO_SUMMARY_TEXT)), F.lit(head), strategy, F.lit(tail))
    return extracted.withColumn("summary", F.when(F.col("parsed").isNotNull(), summary))


# ------------------------------------------------------------------ F6 / X11 / A6 / F11
def role_filter_remap(df: DataFrame, role: str = "role") -> DataFrame:
    """drop ``system`` rows; ``user`` stays, every other role becomes
    ``assistant``."""
    r = F.col(role)
    return (df.where(~r.eqNullSafe(F.lit("system")))
              .withColumn(role, F.when(r == "user", F.lit("user")).otherwise(F.lit("assistant"))))


def ordered_concat(df: DataFrame, key: str, order: str, text: str, sep: str = "\n",
                   out: str = "text", width: int = CONCAT_WIDTH, whole: bool = False) -> DataFrame:
    """Texts joined in order with ``sep`` per key (NULL texts skipped),
    as ordered parts ``(key, part, text)`` of at most ``width`` rows each
    (``whole=True``: one string per key, for bounded keys)."""
    return _ordered_concat(df, [key], order, text, sep, out, width, whole)


def conversation_format(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                        text: str = "text", width: int = CONCAT_WIDTH, whole: bool = False) -> DataFrame:
    """X11: role-tagged transcript per conversation (``role: text`` lines),
    in ordered parts like ``ordered_concat``."""
    f = role_filter_remap(df.select(key, order, role, text), role)
    f = f.withColumn("__line", F.concat(F.col(role), F.lit(": "), F.col(text)))
    return ordered_concat(f, key, order, "__line", "\n", "transcript", width, whole)


def tool_output_context(df: DataFrame, is_tool: Column, key: str = "conv_id", order: str = "turn",
                        text: str = "text", width: int = CONCAT_WIDTH) -> DataFrame:
    """per key, tool messages prefixed and joined by newline, in ordered
    parts (a NULL text prints ``null``, as a template does); a key with no tool
    message gets one part 0 holding the fixed default text."""
    t = df.where(is_tool).select(key, order, F.concat(F.lit(TOOL_OUTPUT_PREFIX), F.coalesce(F.col(text), F.lit("null")))
                                 .alias("__t"))
    parts = ordered_concat(t, key, order, "__t", "\n", "context", width)
    # keys without a tool message: one partial aggregate, no join
    idle = (df.groupBy(key).agg(F.count_if(is_tool).alias("__n")).where(F.col("__n") == 0)
              .select(key, F.lit(0).cast("bigint").alias("part"), F.lit(NO_DISCOVERY_TEXT).alias("context")))
    return parts.unionByName(idle)


# ------------------------------------------------------------------ W4 / W6
def rewind(df: DataFrame, key: str, order: str, index, width: int = DEFAULT_WIDTH,
           bucketed: bool = True) -> DataFrame:
    """Keep the first ``index + 1`` items of each history (``index`` an
    int or a column of the row). A constant index is a group limit: every task
    keeps ``index + 1`` rows of a key before the shuffle."""
    from runfold.operators.scan import Run, running
    if not isinstance(index, str):
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumn("__pos", F.row_number().over(w)).where(F.col("__pos") <= int(index) + 1).drop("__pos")
    r = running(df, [key], order, [Run("__pos", "count")], width, bucketed)
    return r.where(F.col("__pos") <= F.col(index) + 1).drop("__pos")


def first_last_match(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                     text: str = "text", mode: str = "first_user") -> DataFrame:
    """Per key the first user request and the last message, as partial
    aggregates (no per-key sort). ``mode='first_nonempty_else_last'`` returns
    the first message, or the last when the first is empty."""
    r, t, o = F.col(role), F.col(text), F.col(order)
    aggs = [F.min_by(t, F.when(r == "user", o)).alias("first_request"),
            F.max_by(t, o).alias("last_message"),
            F.max_by(r, o).alias("last_role")]
    out = df.groupBy(key).agg(*aggs, F.min_by(t, o).alias("__first"))
    if mode == "first_nonempty_else_last":
        out = out.withColumn("first_request", F.coalesce(F.nullif(F.col("__first"), F.lit("")), F.col("last_message")))
    return out.drop("__first")


def first_where(df: DataFrame, key: str, order: str, cond: Column, value: str, out: str = "first_match") -> DataFrame:
    """W6, general form: per key, ``value`` of the first row (in ``order``)
    where ``cond`` holds; NULL when none does. One partial aggregate."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.when(cond, F.col(order))).alias(out))


# ------------------------------------------------------------------ F8 / F9
def keyword_assert(df: DataFrame, text: str, checks: dict[str, list[str]],
                   all_of: dict[str, list[str]] | None = None) -> DataFrame:
    """F8: one flag per check (case-blind: any of its words for ``checks``, every
    word for ``all_of``) and ``passed`` = all checks true."""
    low = df.withColumn("__low", F.lower(F.col(text)))        # lower-case each text once
    every = all_of or {}
    flags = [contains_any(F.col("__low"), words).alias(name) for name, words in checks.items()]
    flags += [contains_all(F.col("__low"), words).alias(name) for name, words in every.items()]
    out = low.select(*df.columns, *flags)
    passed = F.lit(True)
    for name in [*checks, *every]:
        passed = passed & F.col(name)
    return out.withColumn("passed", passed)


def error_classify(df: DataFrame, text: str = "text") -> DataFrame:
    """``failed`` if the text starts with ``Command failed:``;
    ``not_found`` for the entity-not-found family; ``error`` if it mentions
    an error; else ``ok``."""
    t, low = F.col(text), F.col("__low")
    cls = (F.when(F.startswith(t, F.lit(FAILED_PREFIX)), F.lit("failed"))
            .when(contains_any(low, NOT_FOUND_WORDS), F.lit("not_found"))
            .when(contains_any(low, ["error"]), F.lit("error"))
            .otherwise(F.lit("ok")))
    return df.withColumn("__low", F.lower(t)).withColumn("error_class", cls).drop("__low")


# ------------------------------------------------------------------ F1 / K2
def regex_grep(lines: DataFrame, pattern: str, path: str = "path", line_no: str = "line_no",
               line: str = "line") -> DataFrame:
    """lines matching ``pattern`` as ``path:line: trimmed text``."""
    return (lines.where(F.col(line).rlike(pattern))
                 .withColumn("match", F.concat(F.col(path).cast("string"), F.lit(":"), F.col(line_no).cast("string"),
                                               F.lit(": "), js_trim(F.col(line)))))


def capped_matches(df: DataFrame, order: list[str], n: int = SEARCH_CAP, per: str | None = None) -> DataFrame:
    """K2: the first ``n`` rows in ``order`` (exact, unlike a cap checked only
    when entering a directory). With ``per``: first ``n`` per group; Spark
    plans ``row_number() <= n`` with a partial group limit before the shuffle."""
    if per is None:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


# ------------------------------------------------------------------ K1
def numbered_topk(df: DataFrame, score: str, tiebreak: str, title: Column, url: Column, snippet: Column,
                  k: int = WEB_RESULTS) -> DataFrame:
    """K1: top ``k`` by score (ties by ``tiebreak``), numbered from 1 and
    formatted ``[i] title\\nURL: url\\nSnippet: text\\n``. Planned as one
    TakeOrderedAndProject: each task keeps ``k`` rows."""
    # rank first: title and snippet are worked out for the k winners only
    best = (df.withColumn("__score", F.col(score).cast("bigint")).withColumn("__id", F.col(tiebreak))
              .orderBy(F.col("__score").desc(), F.col("__id").asc()).limit(k))
    top = best.select(F.col("__score").alias("score"), F.col("__id").alias("id"), title.alias("title"), url.alias("url"),
                      snippet.alias("snippet"))
    # number the (at most k) winners: sort them as one small array and
    # posexplode, instead of an unpartitioned window
    ranked = (top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "score", "title",
                                                            "url", "snippet"))).alias("__top"))
                 .select(F.posexplode("__top").alias("__pos", "__r"))
                 .select((F.col("__pos") + 1).cast("bigint").alias("rank"), "__r.id", "__r.score", "__r.title",
                         "__r.url", "__r.snippet"))
    return ranked.withColumn("result", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"),
                                                F.lit("\nURL: "), F.col("url"), F.lit("\nSnippet: "), F.col("snippet"),
                                                F.lit("\n")))
