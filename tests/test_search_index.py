"""Trigram index: required parts of patterns, and the same rows as the scan."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runfold.operators import search_index as ix
from runfold.operators.text import regex_grep
from runfold.session import staging_path
from runfold.sources.files import split_lines
from tests.conftest import SF_SMALL

PATTERNS = ["the", "license", "[0-9]{2}", "data", "a.c", "river|town", "(the )?[a-z]+ing", "ab?c", "[A-Z][a-z]+ the", r"\bof\b",
            r"\.$", "xyzzy never", "qu[ei]", "the .* of", "er+ ", "(?i)THE", "e{2}", "tion ", "", "^the ", r"[0-9]+\.[0-9]+", "é"]


def test_required_runs_by_hand():
    for pattern, runs in {"abc": ["abc"], "abc?d": ["ab", "d"], "ab+c": ["ab", "c"], "a.b": ["a", "b"], "(abc)?de": ["de"], "a|b": [],
                          r"a\.b\d+c": ["a.b", "c"], r"\x41bc": [], r"\Qabc\E": [], "[abc]de": ["de"], "[]a]bc": ["bc"], "[a[b]]cd": [],
                          "(?i)abc": [], "ab{2}c": ["a", "c"], "ab+?cd": ["ab", "cd"], "a((b)c)*d": ["a", "d"], r"\p{L}ab": [],
                          "": [], "ab\\": [], "😀bc?": ["😀b"], "a{,2}b": []}.items():
        assert ix.required_runs(pattern) == runs, pattern


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ".", "[ab]", "[^c]", "(ab)", "(a(b)c)", r"\.", r"\w", "?", "*", "+", "{2}", "{0,1}", "^", "$"]),
                max_size=8), st.text(alphabet="abc.", max_size=12))
def test_every_match_holds_the_runs(parts, text):
    pattern = "".join(parts)
    try:
        m = re.search(pattern, text)
    except re.error:
        return
    if m:
        assert all(r in m.group() for r in ix.required_runs(pattern))


def test_same_rows_as_the_scan(spark):
    corpus = (spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("text").alias("content")))
    extra = spark.createDataFrame([(-1, "x", None), (-2, "y", ""), (-3, "z", "ab"), (-4, "z", "café the 😀😀 river\nthe"), (-5, None, "the data")],
                                  "doc_id long, path string, content string")
    corpus = corpus.unionByName(extra).withColumn("trigram", F.lit(0))
    index = ix.write_index(corpus, staging_path(spark, "index"))
    lines = split_lines(corpus)
    total, opened = corpus.count(), {}
    for pattern in PATTERNS:
        want = sorted((r.path or "", r.line_no, r.match or "") for r in regex_grep(lines, pattern).collect())
        for listed in (0, 1000):
            got = sorted((r.path or "", r.line_no, r.match or "") for r in ix.indexed_grep(corpus, index, pattern, listed=listed).collect())
            assert got == want, pattern
        found = ix.candidates(index, pattern)
        opened[pattern] = 1.0 if found is None else found.count() / total
    assert opened["xyzzy never"] == 0 and opened["river|town"] == 1.0 and opened["license"] < 1


def test_trigrams_of_long_and_odd_texts(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "a😀é\n", "ab" * 500000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ix.trigrams(F.col("t")).alias("g")).collect()
    for r in got:
        t = texts[r.i]
        assert r.g is None if t is None else sorted(r.g) == sorted({t[k:k + 3] for k in range(len(t) - 2)})


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "path string, content string")
    index = ix.write_index(corpus, staging_path(spark, "index"))
    assert ix.indexed_grep(corpus, index, "abc").count() == 0 and index.columns == ["path", "trigram"]
