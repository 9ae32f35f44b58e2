"""Quality rules, line first: clean line by line, then judge what is left.

Line rules (a line that fails one is removed; lines without a word go with them):

* punctuation: a line of prose ends with a sentence mark, or, cut off, is at least
  ``CUT_WORDS`` words long; not more than half of its words end in doubled marks;
* navigation: separators (``|``, ``»``, ``•``, ``>``) make up less than a quarter of
  the line's words;
* boilerplate: none of the fixed phrases of web furniture stands in it;
* symbols: fewer than ``SYMBOL_SHARE`` symbols per word.

A document is kept when its base checks pass and the lines that stay hold at least
``1 - MAX_LOSS`` of its word characters.

Defined results: null and empty texts have no words and fail the base checks; every
row is judged alone, so repeated rows, ties and null identifiers change nothing;
extra columns are ignored (``clean`` keeps them); an empty table gives an empty
result. All of it is a projection of native functions: no shuffle, one pass.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import SPACE, SPACE_CHARS, let, table, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.5
CUT_WORDS = 10
SYMBOL_SHARE = 0.3

#: Phrases of web furniture.
BOILERPLATE = ["all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
               "terms of service", "enable javascript", "lorem ipsum", "subscribe to our", "sign up for our",
               "click here to", "skip to content", "back to top", "share on facebook", "add to cart"]

SYMBOLS = r"[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SENTENCE_MARKS = ".!?…。:;"
CLOSERS = "\"'”’»)]"
DOUBLED_MARK = r"[.!?]{2,}(?=[\x20\x09-\x0D]|$)"
SEPARATOR = "[|»•>]"


def words(text: Column) -> Column:
    """Words as an array; no word gives an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CHAR + "+"))


def word_counts(words_col: Column) -> Column:
    """Struct of ``n`` words and ``repeated``: words that lie in a 3-word window found twice or more. Windows are sorted by
    hash; a window is repeated where a neighbour is equal; the words covered are
    counted from the sorted starts. n log n in the words of the text."""
    def covered(starts):
        last = F.size(starts)
        return F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda acc, k: acc + F.when(
            k == last, 3).otherwise(F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1))))

    def starts_of(by_hash):
        hit = F.filter(by_hash, lambda p, j: F.coalesce((j > 0) & (F.get(by_hash, j - 1)["h"] == p["h"]), F.lit(False))
                       | F.coalesce(F.get(by_hash, j + 1)["h"] == p["h"], F.lit(False)))
        return F.sort_array(F.transform(hit, lambda p: p["i"]))

    def from_hashes(hashes):
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(some, let(let(by_hash, starts_of), covered)).otherwise(F.lit(0))

    def of(w):
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        repeated = F.when(F.size(w) >= 4, let(windows, from_hashes)).otherwise(F.lit(0))
        return F.struct(F.size(w).cast("long").alias("n"), repeated.cast("long").alias("repeated"))
    return let(words_col, of)


def line_stays(line: Column) -> Column:
    tail = F.rtrim(line, F.lit(CLOSERS + SPACE_CHARS))
    lower = F.lower(line)

    def of(n):
        ends = reduce(or_, [F.endswith(tail, F.lit(m)) for m in SENTENCE_MARKS])
        punctuated = (ends | (n >= CUT_WORDS)) & (F.regexp_count(line, F.lit(DOUBLED_MARK)) * 2 <= n)
        navigation = F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= n
        symbols = F.regexp_count(line, F.lit(SYMBOLS)) > SYMBOL_SHARE * n
        return punctuated & ~navigation & ~symbols & ~reduce(or_, [F.contains(lower, F.lit(p)) for p in BOILERPLATE])
    return let(n_words(line), of)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def _measured(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of our own, so that none clashes, and the struct ``measured``;
    the name of each column."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = text_or_empty(names[text_col])
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_CHAR))

    def by_lines(lines):
        stay = F.filter(lines, line_stays)
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                        F.array_join(stay, "\n").alias("clean_text"))
    step = docs.withColumn("__l", let(full, by_lines)).select(
        *docs.columns, F.col("__l"), word_chars(text).cast("long").alias("__c"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("__s"), word_counts(words(text)).alias("__w"))
    step = step.withColumn("__k", word_chars(F.col("__l.clean_text")).cast("long"))
    n, repeated = F.col("__w.n"), F.col("__w.repeated")
    failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)
    return step.select(*docs.columns, F.struct(
        n.alias("n_words"), F.col("__c").alias("word_chars"), F.col("__s").alias("n_symbols"),
        F.col("__l.n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (F.col("__k") >= (1 - MAX_LOSS) * F.col("__c"))).alias("kept"), F.col("__l.n_lines"),
        F.col("__k").alias("clean_word_chars"), F.col("__l.clean_text")).alias("measured")), names


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality`` (in place of a column of that name): the base
    counts, ``base_failed``, the cleaned text and ``kept``."""
    out, names = _measured(docs, text_col)
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c != "quality"], F.col("measured").alias("quality"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that are kept, with their cleaned text; columns unchanged."""
    out, names = _measured(docs, text_col)
    return out.filter("measured.kept").select(
        *[F.col("measured.clean_text" if c == text_col else n).alias(c) for c, n in names.items()])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict for all documents."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "clean_word_chars"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measures(docs).select("doc_id", *[f"quality.{c}" for c in names])


_PHRASES = "|".join(BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.*, list_filter(l, lambda x:
        (regexp_matches(x, '[.!?\x{{2026}}\x{{3002}}:;]["''\x{{201d}}\x{{2019}}\x{{00bb}})\]]*[\x20\x09-\x0D]*$')
         OR len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {CUT_WORDS})
        AND len(regexp_extract_all(x || ' ', '[.!?]{{2,}}[\x20\x09-\x0D]')) * 2 <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        AND len(regexp_extract_all(x, '[|\x{{00bb}}\x{{2022}}>]')) * 4 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        AND len(regexp_extract_all(x, '[#*$%&|<>]')) <= {SYMBOL_SHARE} * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        AND NOT regexp_matches(lower(x), '{_PHRASES}')) AS stay FROM w),
m AS (SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(length(regexp_replace(array_to_string(stay, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS clean_word_chars
      FROM c LEFT JOIN r ON c.doc_id = r.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND clean_word_chars >= {1 - MAX_LOSS} * word_chars AS kept, clean_word_chars
FROM b
"""
