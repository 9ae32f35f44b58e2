"""Licence scans: the automaton and the chains against brute force."""

import itertools
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from runfold.llm import licences
from runfold.llm.licence_texts import PHRASES, TEMPLATES
from tests.conftest import SF_SMALL


def base_by_hand(text):
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return (len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def test_query_by_hand(spark):
    import __spark_entry__ as e
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = e.queries()["op9_licence_scan"](spark, SF_SMALL).collect()
    assert len(out) == len(docs) and any(r.n_base for r in out)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=2, max_size=9), min_size=1, max_size=4),
       st.lists(st.sampled_from("abcd"), max_size=40))
def test_matching_statistics_by_hand(templates, text):
    s = licences.Scanner({}, {str(i): [" ".join(t)] for i, t in enumerate(templates)})
    ids = s.encode(" ".join(text))
    whole = [" " + " ".join(t) + " " for t in templates]
    stats = s.statistics(ids.tolist())
    for i, (state, n) in enumerate(stats):
        want = next(k for k in range(i + 1, -1, -1) if k == 0 or any(f" {' '.join(text[i + 1 - k:i + 1])} " in t for t in whole))
        assert n == want
        if n:
            places = {(k, j) for k, t in enumerate(templates) for j in range(n - 1, len(t)) if t[j - n + 1:j + 1] == text[i + 1 - n:i + 1]}
            assert places <= set(s.automaton.ends[state])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="gnu apche lisbymt\n.,é", max_size=50), st.lists(st.sampled_from(
    ["gnu", "General", "public", "license", "apache", "cc", "by", "mit", "x", "the"]), max_size=30))
def test_base_by_hand(noise, words):
    s = licences.Scanner(PHRASES, TEMPLATES)
    text = noise + " " + " ".join(words)
    f = s.scan(text)
    assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], ",".join(f["base_labels"])) == base_by_hand(text)


def test_damaged_templates_are_found():
    s = licences.Scanner(PHRASES, TEMPLATES)
    rng = random.Random(3)
    for label, texts in TEMPLATES.items():
        for text in texts:
            w = text.split()
            if len(w) >= 20:
                for i in rng.sample(range(len(w)), len(w) // 20):
                    w[i] = "zzz"
                f = s.scan("Qua re da " * 30 + " ".join(w) + " te ru lo" * 30)
                assert label in f["labels"] and f["score"] >= 0.6, (label, f)
            assert s.scan(text)["score"] == 1.0
    clean = s.scan("The river is free to use and the above software of the hill is at the end of this work. " * 50)
    assert clean["labels"] == [] and clean["score"] < 0.6


def spans_of(text):
    return [(label, lo, hi) for label, lo, hi, _ in licences.Scanner(PHRASES, TEMPLATES).scan(text)["spans"]]


def test_every_copy_is_a_span():
    text = max(TEMPLATES["mit"], key=lambda t: len(t.split()))
    n, noise = len(licences.words(text)), "qua re da " * 10
    one = [(hi - lo) for label, lo, hi in spans_of(text) if label == "mit" and (lo, hi) == (0, n)]
    assert one == [n]
    five = [(lo, hi) for label, lo, hi in spans_of((text + " " + noise) * 5) if label == "mit"]
    assert [(k * (n + 30), k * (n + 30) + n) for k in range(5)] == [x for x in five if x[1] - x[0] == n]
    side_by_side = [(lo, hi) for label, lo, hi in spans_of((text + " ") * 5) if label == "mit"]
    assert {(k * n, k * n + n) for k in range(5)} <= set(side_by_side)
    start = time.time()
    many = [(lo, hi) for label, lo, hi in spans_of((text + " " + noise) * 1000) if label == "mit"]
    assert sum(hi - lo == n for lo, hi in many) == 1000 and time.time() - start < 30


def by_enumeration(found, back):
    """Words covered by the best chain, over all subsequences of the matches."""
    best = 0
    for size in range(1, len(found) + 1):
        for chain in itertools.combinations(sorted(found), size):
            added = [licences.linked(a, b) if b[0] - a[0] <= back else None for a, b in itertools.pairwise(chain)]
            if None not in added:
                best = max(best, chain[0][2] + sum(added))
    return best


@settings(max_examples=300, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 40), st.integers(0, 20), st.integers(1, 9)), min_size=1, max_size=9), st.integers(4, 20))
def test_chains_by_enumeration(found, least):
    back = 30
    best, out = licences.chains(list(found), back, least)
    assert best == by_enumeration(found, back)
    assert bool(out) == (best >= least) and all(n >= least for _, _, n in out)
    rest = {m for m in found if not any(lo <= m[0] and m[0] + m[2] <= hi for lo, hi, _ in out)}
    assert by_enumeration(rest, back) < least


def test_edges(spark):
    schema = "doc_id long, text string, labels string, score double"
    rows = [(1, None, "x", 1.0), (2, "", None, None), (2, "", None, None), (None, "MIT-License", None, None),
            (4, "apache license " * 50000, None, None)]
    out = sorted(licences.scan(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in out] == [
        (None, 2, 1, 0, 0, "mit", 1.0), (1, 0, 0, None, None, "", 0.0), (2, 0, 0, None, None, "", 0.0),
        (2, 0, 0, None, None, "", 0.0), (4, 100000, 50000, 0, 99998, "apache", 1.0)]
    assert licences.scan(spark.createDataFrame([], schema)).count() == 0
