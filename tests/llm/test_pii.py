"""Personal data: base patterns by plain regular expressions, the field by enumeration
and on held-out lines."""

import functools
import hashlib
import itertools
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from runfold.llm import pii
from tests.conftest import SF_SMALL

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_hand(text):
    found = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                  "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [f for _, _, f in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="a1@.-", max_size=30), st.text(alphabet="0125. -+()", max_size=45),
                 st.text(alphabet="a%@.é0\n+5 ", max_size=40)))
def test_base_by_hand(text):
    assert [pii.written([s]) for s in pii.base_spans(text)] == by_hand(text)


def test_query_by_hand(spark):
    import __spark_entry__ as e
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = e.queries()["op5_personal_data"](spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        base = by_hand(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in PLAIN]
        assert set(base) <= set(r.spans.split(",")) or not base
        if not re.search("[0-9@]", docs[r.doc_id]):
            assert r.spans == ""


def test_viterbi_by_enumeration():
    field = pii.train(pii.generated(n=300))
    for text, _ in pii.generated(5, 60):
        for lo, hi in pii.regions(text):
            bounds, ends = pii.candidates(text, lo, hi)
            segs = [(i, j, k, field.score(pii.features(k, text, bounds[i], bounds[j], lo, hi))) for j, x in ends.items() for i, k in x]
            if len(segs) > 11:
                continue
            best = max((sum(s[3] for s in c) for n in range(len(segs) + 1) for c in itertools.combinations(segs, n)
                        if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))))
            got = field.best(text, lo, hi)
            score = sum(field.score(pii.features(k, text, a, b, lo, hi)) for k, a, b in got)
            assert abs(score - best) < 1e-6


def test_held_out_lines():
    field = pii.train(pii.generated())
    right = wrong = missed = 0
    for text, spans in pii.generated(77, 400):
        got = set(field.spans(text))
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + missed) >= 0.95 and right / (right + wrong) >= 0.95
    clean = "The river ran for 12 miles in 1998, see section 4.2 and table 3.1; it cost 1,250 at noon on 2021-03-04. " * 20
    assert field.spans(clean) == []


def test_long_texts_take_linear_time():
    field = pii.Field({})
    for text in ["a" * 200000, "1" * 200000, "1." * 100000, "a@" * 100000, "+" * 200000, "1 " * 100000, "(at) " * 40000]:
        t = time.time()
        pii.base_spans(text)
        assert time.time() - t < 5, text[:5]
    t = time.time()
    pii.find(field, "12 34 " * 20000)
    assert time.time() - t < 60


@functools.cache
def small_field():
    return pii.train(pii.generated(n=300))


def test_many_base_spans_take_linear_time():
    field = small_field()
    t = time.time()
    base, spans = pii.find(field, " ".join(f"u{i}@mail{i}.org" for i in range(100000)))
    assert len(base) == 100000 and set(base) <= set(spans) and time.time() - t < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "10.0.0.1", "+41 44 668 18 00", "4111 1111 1111 1111", "mail", "jo at home dot org",
                                 "key=", "hunter2secret99", "192.168.0.1+4144668180", "x"]), max_size=12))
def test_added_spans_keep_off_base_ones(parts):
    field = small_field()
    text = " ".join(parts)
    base, spans = pii.find(field, text)
    off = [s for s in field.spans(text) if all(b <= s[1] or s[2] <= a for _, a, b in base)]
    if base:
        assert sorted(spans) == sorted(base + off)


def test_edges(spark):
    schema = "doc_id long, text string, spans string, base string"
    mail = "é mail a.b@c.org"
    rows = [(1, None, "x", "y"), (2, "", None, None), (None, mail, None, None), (3, mail, None, None), (3, mail, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = pii.detect(df, pii.fit(df)).collect()
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in out)
    one = [("email", 7, 14 + 2)]
    assert got == [(0, one, one), (1, [], []), (2, [], []), (3, one, one), (3, one, one)]
    empty = spark.createDataFrame([], schema)
    assert pii.detect(empty, pii.fit(empty)).count() == 0
