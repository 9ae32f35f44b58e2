"""String, JSON-text and cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runfold.constants import JS_WS_CHARS, TRUNCATE_AT

# Our e-mail rule (the source only says "clean"): lower-cased, trimmed, and
# one local part, one domain with at least one dot and a 2+ letter TLD.
EMAIL_PATTERN = "^[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)*\\.[a-z]{2,}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim like JavaScript's ``String.trim`` (all Unicode white space and
    line terminators), not only spaces like Spark's ``trim``. ``btrim`` with
    a character set runs in the JVM without a regex."""
    return F.btrim(_c(c), F.lit(JS_WS_CHARS))


def truncate_with_length(c, n: int = TRUNCATE_AT) -> Column:
    """Over ``n`` characters: the first ``n`` plus a note with the full length.

    Lengths are code points (JavaScript counts UTF-16 units; the two differ
    only for characters outside the Basic Multilingual Plane)."""
    s = _c(c)
    return F.when(F.length(s) > n,
                  F.concat(F.substring(s, 1, n),
                           F.lit("\n... [TRUNCATED, TOTAL LENGTH: "),
                           F.length(s).cast("string"), F.lit("]"))).otherwise(s)


def drop_think_blocks(c) -> Column:
    """Remove every ``<think>…</think>`` block (case-blind, shortest match)."""
    return F.regexp_replace(_c(c), "(?is)<think>.*?</think>", "")


def strip_fences(c) -> Column:
    """Drop one leading ```` ``` ```` / ```` ```json ```` fence and one trailing
    fence; fences in the middle stay."""
    s = F.regexp_replace(_c(c), "(?i)^```(?:json)?", "")
    return F.regexp_replace(s, "```\\z", "")


def first_brace_span(c) -> Column:
    """Greedy span from the first ``{`` to the last ``}``; NULL when absent."""
    return F.nullif(F.regexp_extract(_c(c), "(?s)\\{.*\\}", 0), F.lit(""))


def strict_parse_json(c) -> Column:
    """Parse JSON text to VARIANT like ``JSON.parse``: NULL unless the whole
    text is exactly one valid JSON value. (``try_parse_json`` alone accepts
    trailing text after the first value; the array-wrap length check rejects
    that and a second top-level value.)"""
    s = _c(c)
    one = F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == 1
    return F.when(one, F.try_parse_json(s))


def email_clean(c) -> tuple[Column, Column]:
    """Return ``(clean, valid)``: lower(trim(e)) when it matches the rule,
    else NULL and ``valid = false``."""
    e = F.lower(js_trim(_c(c)))
    valid = F.coalesce(e.rlike(EMAIL_PATTERN), F.lit(False))
    return F.when(valid, e), valid


def amount_clean(c, precision: int = 18, scale: int = 2) -> Column:
    """Trim then cast text money to DECIMAL; bad text becomes NULL (never a
    failed job, never a silently wrong DOUBLE)."""
    return js_trim(_c(c)).try_cast(f"decimal({precision},{scale})")


def iso_date(c) -> Column:
    """ISO ``yyyy-MM-dd`` text to DATE; bad text becomes NULL."""
    return F.try_to_date(js_trim(_c(c)), "yyyy-MM-dd")


def namespaced_name(server, tool) -> Column:
    """``server_tool`` with characters outside ``[A-Za-z0-9_-]`` in the server
    name replaced by ``_``."""
    return F.concat(F.regexp_replace(_c(server), "[^a-zA-Z0-9_-]", "_"), F.lit("_"), _c(tool))


def contains_any(low, words) -> Column:
    """Whether lower-cased text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(_c(low), F.lit(w.lower()))
    return out


def contains_all(low, words) -> Column:
    """Whether lower-cased text holds every word."""
    out = F.lit(True)
    for w in words:
        out = out & F.contains(_c(low), F.lit(w.lower()))
    return out


def join_text_blocks(blocks, sep: str = "\n") -> Column:
    """A6 inside one value: keep the ``type = 'text'`` blocks of an
    ARRAY<STRUCT<type, text>> and join their texts with ``sep``."""
    kept = F.filter(_c(blocks), lambda b: b.getField("type") == "text")
    return F.array_join(F.transform(kept, lambda b: b.getField("text")), sep)


def rewind_array(history, index) -> Column:
    """W4 inside one value: the first ``index + 1`` items of an array."""
    idx = F.col(index) if isinstance(index, str) else F.lit(int(index))
    return F.slice(_c(history), 1, idx + 1)
