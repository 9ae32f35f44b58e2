"""Sampled segmentations against enumeration, and exact round trips."""

import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from runfold.llm import pieces
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.read_model(pieces.MODEL))


def segmentations(v, text):
    """All segmentations of a normalised text with their probabilities."""
    ids = {v.sp.id_to_piece(i): i for i in range(v.sp.get_piece_size())
           if not (v.sp.is_byte(i) or v.sp.is_control(i) or v.sp.is_unknown(i))}

    def rec(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in ids:
                own = (ids[text[i:j]],)
            elif j == i + 1:
                own = tuple(int(x) for x in v.byte_id[list(text[i].encode())])
            else:
                continue
            lp = v.logp[own[0]] if text[i:j] in ids else len(own) * v.byte_logp
            for rest, p in rec(j):
                yield own + rest, lp + p
    found = list(rec(0))
    total = np.logaddexp.reduce([p for _, p in found])
    return {s: p - total for s, p in found}


def sample(v, text, n, k):
    return pieces.sample_unit(v, [text] * n, [str(i) for i in range(n)], k, 5)


@pytest.mark.parametrize("text", ["the tion", "a漢b", "ab\ncd ef"])
def test_probabilities_by_enumeration(v, text):
    all_ = segmentations(v, v.normalised(text))
    n = 6000
    got = sample(v, text, n, 2)
    first, second = Counter(), Counter()
    for rows in got:
        assert len(rows) == min(2, len(all_)) and all(r[4] for r in rows)
        s = [tuple(r[0].tolist()) for r in rows]
        assert len(set(s)) == len(s)
        for r, x in zip(rows, s):
            assert abs(r[1] - all_[x]) < 1e-6 and r[2] <= 0
        assert rows[0][3] >= rows[-1][3]
        first[s[0]] += 1
        second[s[1]] += 1
    for s, lp in sorted(all_.items(), key=lambda x: -x[1])[:6]:
        p = math.exp(lp)
        assert abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        # without replacement: drawn second in proportion, once another one is gone
        q = sum(math.exp(l2) * p / (1 - math.exp(l2)) for t, l2 in all_.items() if t != s)
        assert abs(second[s] / n - q) < 5 * math.sqrt(max(0, q * (1 - q)) / n) + 1e-3


def test_inclusion_scores_are_unbiased(v):
    text = "those"
    all_ = segmentations(v, v.normalised(text))
    want = sum(math.exp(lp) * len(s) for s, lp in all_.items())
    got = [sum(math.exp(r[1] - r[2]) * len(r[0]) for r in rows) for rows in sample(v, text, 8000, 3)]
    assert abs(np.mean(got) - want) < 5 * np.std(got) / math.sqrt(len(got))


def test_all_segmentations_of_a_short_text(v):
    all_ = segmentations(v, v.normalised("of"))
    for rows in sample(v, "of", 20, 1000):
        assert {tuple(r[0].tolist()) for r in rows} == set(all_) and all(r[2] == 0 for r in rows)


def test_round_trip_and_decoding(spark, v):
    schema = "doc_id long, text string, ids string, sample string"
    texts = [None, "", " ", "a", "  two  spaces ", "tab\tline\n\nend\n", "漢字 \U0001d11e é", "x" * 5000,
             "▁mark", "the " * 3000, "a", "<s> </s> <0x41>"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", "y") for i, t in enumerate(texts)], schema)
    out = pieces.decode(pieces.encode(docs, k=3)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.round_trip and r.n_pieces == len(r.ids) and r.text == sp.decode(r.ids)
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        assert r.text == t.replace("▁", " ")
    for i in range(len(texts)):
        rows = by[None if i == 3 else i]
        assert [r.sample for r in rows] == list(range(len(rows))) and len({tuple(r.ids) for r in rows}) == len(rows)
    assert len(by[0]) == len(by[1]) == 1 and by[0][0].ids == [] and by[0][0].log_inclusion == 0
    assert pieces.encode(spark.createDataFrame([], schema), k=2).count() == 0


def test_rows_do_not_depend_on_neighbours(spark):
    import __spark_entry__ as e
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = {(r.doc_id, r.sample): r for r in e.queries()["op7_sample_pieces"](spark, SF_SMALL).collect()}
    two = pieces.encode(docs.repartition(7, "text"), k=2).collect()
    assert len(two) == len(one) == 2 * docs.filter("length(text) > 0").count() + docs.filter("length(text) = 0").count()
    for r in two:
        o = one[r.doc_id, r.sample]
        assert o.ids == r.ids and abs(o.log_prob - r.log_prob) < 1e-6 and r.round_trip


def test_words_and_their_distinct_characters(v):
    m = pieces.SPACE_MARK
    texts = [f"{m}a{m}{m}b\n\n{m}c", "", f"{m}a", "\n", f"x{m}", f"{m}{m}\nx\U0001d11e{m}a", "a\0b"]
    want = [[f"{m}a", f"{m}{m}b", "\n", "\n", f"{m}c"], [], [f"{m}a"], ["\n"], ["x", m], [f"{m}{m}", "\n", "x\U0001d11e", f"{m}a"], ["a\0b"]]
    for n in (len(texts), 2, 1, 0):
        n_words, word, size, chars = v.words(texts[:n])
        distinct, at = [], 0
        for s in size:
            distinct.append("".join(map(chr, chars[at:at + s])))
            assert chars[at + s] == 0
            at += s + 1
        flat = [w for ws in want[:n] for w in ws]
        assert n_words.tolist() == [len(ws) for ws in want[:n]] and [distinct[i] for i in word] == flat
        assert distinct == list(dict.fromkeys(flat)) and at == len(chars)
