"""Path, command and allow-list policy as column rules and joins.

Everything is a table-level job: classify a whole file inventory or command
log, replay an access-request log against rules and answers, maintain a rule
table, gate batch writes and deletes. Fixed lists live in ``runfold.constants``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.constants import (ACK_TIMEOUT_SECONDS, ALLOWED_PATHS, BLOCKED_COMMANDS, BLOCKED_PATTERNS,
                               IGNORED_NAMES, NOT_ALLOWED_EXTENSIONS, READ_ONLY_FILES)
from runfold.functions.paths import basename, dirname, extname, is_within, resolve_path
from runfold.functions.text import js_trim
from runfold.operators.common import settled
from runfold.operators.scan import DEFAULT_WIDTH, Run, running
from runfold.sources.versions import VersionedTable

# FIXED VALUES: the refusal texts, in the order the checks run.
REASON_TRAVERSAL = "Path traversal detected."
REASON_NOT_ALLOWED = "Path is not within allowed directories."
REASON_BLOCKED = "Path matches a blocked pattern."
REASON_EXTENSION = "File extension '{ext}' is strictly prohibited."
REASON_READ_ONLY = "File '{base}' is read-only."
REASON_MISSING = "File does not exist."
REASON_EXECUTE = "Direct execution disabled."


# ------------------------------------------------------------------ X10
def path_parts(df: DataFrame, path: str = "path", root: str = "/w") -> DataFrame:
    """Resolved path, directory, base name and lower-case extension."""
    r = resolve_path(path, root)
    return (df.withColumn("resolved", r)
              .withColumn("dir", dirname("resolved"))
              .withColumn("base", basename("resolved"))
              .withColumn("ext", extname("resolved")))


def _filled(template: str, column: str) -> Column:
    """A refusal text with its ``{column}`` filled in."""
    before, after = template.split(f"{{{column}}}")
    return F.concat(F.lit(before), F.col(column), F.lit(after))


def _any_pattern(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"({p})" for p in patterns)) if patterns else F.lit(False)


# ------------------------------------------------------------------ F3
def path_policy(df: DataFrame, path: str = "path", operation: str = "operation",
                existing: DataFrame | None = None, root: str = "/w",
                allowed_paths: list[str] = ALLOWED_PATHS, blocked_patterns: list[str] = BLOCKED_PATTERNS,
                read_only: list[str] = READ_ONLY_FILES,
                extensions: list[str] = NOT_ALLOWED_EXTENSIONS) -> DataFrame:
    """classify each (path, operation); the first failing check wins:
    traversal → outside allowed dirs → blocked pattern → bad extension →
    read-only (write/delete) → missing (read/delete) → execute → safe.

    ``existing(path)`` lists files that exist (e.g. an object listing); it is
    joined on the resolved path (equi join, scales with both sides)."""
    d = path_parts(df, path, root)
    if existing is not None:
        ex = existing.select(F.col("path").alias("resolved")).distinct().withColumn("__exists", F.lit(True))
        d = d.join(ex, "resolved", "left")
        exists = F.coalesce(F.col("__exists"), F.lit(False))
    else:
        exists = F.lit(True)
    res = F.col("resolved")
    op = F.col(operation)
    inside_allowed = F.lit(False)
    for a in allowed_paths:
        inside_allowed = inside_allowed | is_within(res, root.rstrip("/") + "/" + a)
    reason = (F.when(~is_within(res, root), F.lit(REASON_TRAVERSAL))
               .when(~inside_allowed, F.lit(REASON_NOT_ALLOWED))
               .when(_any_pattern(res, blocked_patterns), F.lit(REASON_BLOCKED))
               .when(F.col("ext").isin(*extensions),
                     _filled(REASON_EXTENSION, "ext"))
               .when(op.isin("write", "delete") & F.col("base").isin(*read_only),
                     _filled(REASON_READ_ONLY, "base"))
               .when(op.isin("read", "delete") & ~exists, F.lit(REASON_MISSING))
               .when(op == "execute", F.lit(REASON_EXECUTE)))
    return (d.withColumn("reason", reason)
             .withColumn("safe", F.col("reason").isNull())
             .drop("__exists"))


# ------------------------------------------------------------------ F4
def actual_command(cmd: Column) -> Column:
    """The last ``&&`` segment, trimmed; the whole command if that is empty
    or there is no ``&&``."""
    last = js_trim(F.element_at(F.split(cmd, "&&", -1), -1))
    return F.when(F.contains(cmd, F.lit("&&")), F.coalesce(F.nullif(last, F.lit("")), cmd)).otherwise(cmd)


def base_command(actual: Column) -> Column:
    """First word (split on one space); the whole text if that is empty."""
    return F.coalesce(F.nullif(F.split(actual, " ", -1).getItem(0), F.lit("")), actual)


def command_policy(df: DataFrame, command: str = "command", tokens: list[str] = BLOCKED_COMMANDS,
                   all_segments: bool = False) -> DataFrame:
    """blocked if the lower-cased checked text contains any token as a
    substring (so ``kill`` also hits ``skill``). Faithful form checks only the
    last ``&&`` segment; ``all_segments=True`` (ours) checks the whole line."""
    cmd = F.col(command)
    actual = actual_command(cmd)
    d = df.withColumn("segment", actual).withColumn("__checked", F.lower(cmd if all_segments else F.col("segment")))
    # first listed token contained in the checked text, as one CASE chain
    # (stays in generated code; a lambda over an array would not)
    first_hit = F.lit(None).cast("string")
    for t in reversed(tokens):
        first_hit = F.when(F.contains(F.col("__checked"), F.lit(t.lower())), F.lit(t.lower())).otherwise(first_hit)
    return (d.withColumn("base_command", base_command(F.col("segment")))
             .withColumn("blocked_token", first_hit)
             .withColumn("blocked", F.col("blocked_token").isNotNull())
             .drop("__checked"))


# ------------------------------------------------------------------ F5
def ignored_names(entries: DataFrame, name: str = "name", is_dir: str = "is_dir",
                  ignore: list[str] = IGNORED_NAMES) -> DataFrame:
    """drop hidden names (leading '.') and the fixed ignore set; tag each
    remaining entry ``[DIR]  name`` or ``[FILE] name``."""
    n = F.col(name)
    return (entries.where(~F.startswith(n, F.lit(".")) & ~n.isin(*ignore))
                   .withColumn("entry", F.when(F.col(is_dir), F.concat(F.lit("[DIR]  "), n))
                                         .otherwise(F.concat(F.lit("[FILE] "), n))))


# ------------------------------------------------------------------ J1
def prefix_probes(text: Column, lengths: Column) -> Column:
    """The prefixes of ``text`` that have one of ``lengths`` (an array)."""
    fits = F.filter(lengths, lambda n: n <= F.length(text))
    return F.transform(fits, lambda n: F.substring(text, F.lit(1), n))


def _allowed_triples(requests: DataFrame, rules: DataFrame, category: str, operation: str, target: str) -> DataFrame:
    """The distinct (category, operation, target) of the requests that a rule
    allows, as ``__c``, ``__o``, ``__t``. One plan at every size, equalities only:
    a command is probed with its prefixes of the lengths that command rules have
    (a scalar subquery), any operation also as ``all``."""
    r = rules.select(F.col("category").alias("__rc"), F.col("operation").alias("__ro"), F.col("target").alias("__rt"))
    lengths = r.where(F.col("__rc") == "commands").select(F.collect_set(F.length("__rt"))).scalar()
    triples = (requests.select(F.col(category).alias("__c"), F.col(operation).alias("__o"), F.col(target).alias("__t"))
                       .distinct().withColumn("__lengths", lengths))
    targets = F.when(F.col("__c") == "commands", prefix_probes(F.col("__t"), F.col("__lengths"))).otherwise(F.array("__t"))
    probes = (triples.withColumn("__rc", F.col("__c"))
                     .withColumn("__rt", F.explode(targets))
                     .withColumn("__ro", F.explode(F.array(F.col("__o"), F.lit("all")))))
    return probes.join(r.distinct(), ["__rc", "__ro", "__rt"], "left_semi").select("__c", "__o", "__t").distinct()


def _same_triple(requests: DataFrame, hits: DataFrame, category: str, operation: str, target: str) -> Column:
    return (requests[category].eqNullSafe(hits["__c"]) & requests[operation].eqNullSafe(hits["__o"])
            & requests[target].eqNullSafe(hits["__t"]))


def allowlist_match(requests: DataFrame, rules: DataFrame, category: str = "category",
                    operation: str = "operation", target: str = "target") -> DataFrame:
    """Requests with at least one matching rule (existence only, every
    request row as often as it stands in the log).

    A rule matches when categories are equal, the rule's operation is equal or
    ``all``, and the target is equal — or, for ``commands``, the request target
    *starts with* the rule target (raw text: rule ``rm`` allows ``rmdir``). A
    NULL category or target never matches; a NULL operation matches ``all``.
    Whether rules are few or many, the plan and the rows are the same."""
    hits = _allowed_triples(requests, rules, category, operation, target)
    return requests.join(hits, _same_triple(requests, hits, category, operation, target), "left_semi")


def allowlist_flag(requests: DataFrame, rules: DataFrame, out: str = "allowlisted", category: str = "category",
                   operation: str = "operation", target: str = "target") -> DataFrame:
    """J1 as a flag on every request (for the permission cascade): true on
    exactly the rows that ``allowlist_match`` keeps."""
    hits = _allowed_triples(requests, rules, category, operation, target).withColumn("__hit", F.lit(True))
    joined = requests.join(hits, _same_triple(requests, hits, category, operation, target), "left")
    return joined.select(*[requests[c] for c in requests.columns], F.coalesce(hits["__hit"], F.lit(False)).alias(out))


# ------------------------------------------------------------------ J2
def answers_in_time(requests: DataFrame, answers: DataFrame, key: str, req_ts: str, ans_ts: str,
                    timeout_seconds: int = ACK_TIMEOUT_SECONDS) -> DataFrame:
    """Per request the earliest answer given at or after it and within the
    time-out: ``(key, answer)``. Rows meet on the request's key, nothing else."""
    asked = requests.groupBy(key).agg(F.min(req_ts).alias("__asked"))
    given = answers.select(F.col(key), "answer", F.col(ans_ts).alias("__given")).where(F.col("answer").isNotNull())
    wait = F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    fits = (F.col("__given") >= F.col("__asked")) & (F.col("__given") <= F.col("__asked") + wait)
    return (given.join(asked, key).where(fits)
                 .groupBy(key).agg(F.min_by("answer", F.struct("__given", "answer")).alias("answer")))


def permission_decision(requests: DataFrame, rules: DataFrame, answers: DataFrame | None = None,
                        key: str = "req_id", mode: str = "manual", has_session: str | None = None,
                        req_ts: str | None = None, ans_ts: str | None = None,
                        timeout_seconds: int = ACK_TIMEOUT_SECONDS) -> DataFrame:
    """The approval cascade per request: auto mode → allow; ``read`` →
    allow; allow-list hit → allow; no session (or an unknown one) → deny; answer
    ``allow_always`` / ``allow_once`` → allow; anything else → deny. With
    ``req_ts`` and ``ans_ts`` the log is replayed: an answer counts only within
    ``timeout_seconds`` of its request, the earliest one wins, and a request
    without one is denied as ``timeout``."""
    d = allowlist_flag(requests, rules, "__hit")
    if answers is not None:
        if req_ts and ans_ts:
            answers = answers_in_time(requests, answers, key, req_ts, ans_ts, timeout_seconds)
        d = d.join(answers.select(key, "answer"), key, "left")
        ans = F.col("answer")
    else:
        ans = F.lit(None).cast("string")
    session = F.coalesce(F.col(has_session), F.lit(False)) if has_session else F.lit(True)
    reason = (F.when(F.lit(mode == "auto"), F.lit("auto"))
               .when(F.col("operation") == "read", F.lit("read"))
               .when(F.col("__hit"), F.lit("allowlist"))
               .when(~session, F.lit("no_session"))
               .when(ans == "allow_always", F.lit("allow_always"))
               .when(ans == "allow_once", F.lit("allow_once"))
               .when(ans.isNull(), F.lit("timeout"))
               .otherwise(F.lit("denied")))
    allowed = reason.isin("auto", "read", "allowlist", "allow_always", "allow_once")
    return d.withColumn("reason", reason).withColumn("allowed", allowed).drop("__hit")


# ------------------------------------------------------------------ J6 / J7
def insert_if_absent(existing: DataFrame, new_rules: DataFrame, added_at: Column | str | None = None,
                     keys=("category", "target", "operation")) -> DataFrame:
    """Add rules whose (category, target, operation) is not there yet,
    each once, stamped with ``added_at`` (ISO text; now by default)."""
    stamp = (F.lit(added_at) if isinstance(added_at, str)
             else added_at if added_at is not None
             else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    fresh = (new_rules.select(*keys).dropDuplicates(list(keys))
                      .join(existing.select(*keys), list(keys), "left_anti")
                      .withColumn("added_at", stamp))
    return existing.select(*keys, "added_at").unionByName(fresh)


def remove_by_target(rules: DataFrame, removals: DataFrame) -> DataFrame:
    """Remove *every* rule of a category with a listed target, whatever
    its operation."""
    return rules.join(removals.select("category", "target").distinct(), ["category", "target"], "left_anti")


# ------------------------------------------------------------------ J8
def ack_interval_join(requests: DataFrame, answers: DataFrame, key: str, req_id: str, req_ts: str,
                      ans_id: str, ans_ts: str, timeout_seconds: int = ACK_TIMEOUT_SECONDS,
                      width: int = DEFAULT_WIDTH) -> DataFrame:
    """Match each request to the earliest answer of the same key within
    ``[req_ts, req_ts + timeout]``; unanswered requests are denied.

    Written as an as-of join, not a range join: requests and answers are put
    in one time-ordered stream per key and a backwards (suffix) scan carries
    "the next answer at or after this row" to every request; the request keeps
    it if it is within the time-out. No request × answer pairs are formed, so a
    key with a huge, dense history costs O(rows), and the scan cuts a key's rows
    by time into pieces of about ``width`` rows, so a hot key never lands in one
    task."""
    T = int(timeout_seconds)
    req_cols = requests.columns
    rq = requests.select(*req_cols, F.col(key).alias("__k"), F.col(req_ts).alias("__ts"), F.lit(0).alias("__kind"),
                         F.col(req_id).alias("__id"))
    an = answers.select(F.col(key).alias("__k"), F.col(ans_ts).alias("__ts"), F.lit(1).alias("__kind"),
                        F.col(ans_id).alias("__id"))
    # request columns ride along in the union (NULL on answer rows), so the
    # result needs no join back to the requests
    u = rq.unionByName(an, allowMissingColumns=True).withColumn(
        "__ans", F.when((F.col("__kind") == 1) & F.col("__k").isNotNull(),      # NULL keys never match
                        F.struct(F.col("__id").alias("aid"), F.col("__ts").alias("ats"))))
    # at equal times the request sorts first, so an answer at req_ts counts
    s = running(u, ["__k"], ["__ts", "__kind", "__id"], [Run("__next", "last_nonnull", "__ans")],
                width=width, descending=True, cut=F.unix_micros(F.col("__ts").cast("timestamp")))
    best = F.when(F.col("__next.ats") <= F.col("__ts") + F.expr(f"INTERVAL {T} SECONDS"), F.col("__next"))
    return (s.where(F.col("__kind") == 0)
             .select(*req_cols,
                     best.getField("aid").alias("answer_id"), best.getField("ats").alias("answer_ts"),
                     F.when(best.isNotNull(), "allow").otherwise("deny").alias("decision")))


# ------------------------------------------------------------------ S6
def gate_batches(batch: DataFrame, batch_col: str, order_col: str, operation: str = "write",
                 path: str = "path", existing: DataFrame | None = None, root: str = "/w") -> DataFrame:
    """Per batch: files, and the first failing path (by ``order_col``) with
    its reason; ``allowed`` when no path fails."""
    d = path_policy(batch.withColumn("__op", F.lit(operation)), path, "__op", existing, root)
    return (d.groupBy(batch_col)
             .agg(F.count(F.lit(1)).alias("n_files"),
                  F.min_by(F.struct(F.col(path).alias("path"), F.col("reason").alias("reason")),
                           F.when(~F.col("safe"), F.col(order_col))).alias("__first"))
             .select(batch_col, "n_files",
                     F.col("__first.path").alias("first_path"), F.col("__first.reason").alias("first_reason"),
                     F.col("__first").isNull().alias("allowed")))


def gated_write(batch: DataFrame, batch_col: str, order_col: str, dest: str, path: str = "path",
                root: str = "/w") -> DataFrame:
    """All-or-nothing batch writes into the versioned folder ``dest``. The batches
    whose every path passes the write policy are published together as its next version,
    replacing batches of the same name; all others that are there stay. A batch with any
    violation writes nothing and reports its first violation; if all are refused there is
    no write. Returns the per-batch report (``status`` written / refused)."""
    report = settled(gate_batches(batch, batch_col, order_col, "write", path, None, root), "gate")
    ok = report.where("allowed").select(F.col(batch_col).alias("__ok"))
    if not ok.isEmpty():
        VersionedTable(batch.sparkSession, dest, batch_col).publish(
            batch.join(ok, F.col(batch_col).eqNullSafe(F.col("__ok")), "left_semi"))
    return report.withColumn("status", F.when(F.col("allowed"), "written").otherwise("refused"))


# ------------------------------------------------------------------ S8
def delete_by_key(table: DataFrame, requests: DataFrame, batch_col: str, order_col: str,
                  path: str = "path", root: str = "/w") -> tuple[DataFrame, DataFrame]:
    """All-or-nothing keyed deletes. A batch is applied only if every key
    exists in ``table`` and passes the delete policy; returns ``(remaining,
    report)`` where ``remaining`` is ``table`` minus the applied keys."""
    report = settled(gate_batches(requests, batch_col, order_col, "delete", path, table.select(path), root), "gate")
    applied = requests.join(report.where("allowed").select(batch_col), batch_col, "left_semi").select(path)
    remaining = table.join(applied.distinct(), path, "left_anti")
    return remaining, report.withColumn("status", F.when(F.col("allowed"), "deleted").otherwise("refused"))


def gated_delete(stored: VersionedTable, requests: DataFrame, batch_col: str, order_col: str, path: str = "path",
                 root: str = "/w") -> DataFrame:
    """S8 on a versioned folder: the keys of the applied requests go with the next version.
    Only stored batches that lose a row are written anew; the files of all others stay the
    same. Returns the report of the requests' batches (``status`` deleted / refused)."""
    version = stored.version()
    rows = stored.read(version)
    report = settled(gate_batches(requests, batch_col, order_col, "delete", path, rows.select(path).distinct(), root), "gate")
    ok = report.where("allowed").select(F.col(batch_col).alias("__ok"))
    keys = requests.join(ok, F.col(batch_col).eqNullSafe(F.col("__ok")), "left_semi").select(path).distinct()
    touched = settled(rows.join(keys, path, "left_semi").select(F.col(stored.key).alias("__batch")).distinct(), "touched")
    kept = rows.join(touched, F.col(stored.key).eqNullSafe(F.col("__batch")), "left_semi").join(keys, path, "left_anti")
    if not touched.isEmpty():
        stored.publish(kept.select(*rows.columns), touched, expect=version)
    return report.withColumn("status", F.when(F.col("allowed"), "deleted").otherwise("refused"))
