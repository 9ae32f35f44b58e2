"""The pipeline stage by stage against brute force."""

import re
from collections import Counter

import corpus_pipeline
from runfold.llm import pieces
from runfold.llm.common import settle
from tests.conftest import SF_SMALL
from tests.llm.test_simhash import fingerprint, groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], SF_SMALL), f"test-{name}"))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    for d in seen[1:-1]:
        assert d.schema == docs.schema
    for r in rows[0].values():
        assert (r.doc_id in rows[1]) == bool(re.search(r"[^\W\d_]", r.text or "")) and rows[1].get(r.doc_id, r) == r
    first = {}
    for i in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[1][i].text), i)
    assert set(rows[2]) == set(first.values())
    assert set(rows[3]) == set(groups({i: fingerprint(r.text) for i, r in rows[2].items()}).values())
    copies = Counter(r.doc_id for r in seen[4].collect())
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 2
    total = sum(len(WORD.findall(r.text)) for r in rows[3].values())
    taken = sum(len(WORD.findall(rows[3][i].text)) * n for i, n in copies.items())
    assert 1.3 <= taken / total <= 1.7
    last = seen[5].collect()
    assert Counter(r.doc_id for r in last) == copies and all(r.round_trip for r in last)
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in last)


def test_stages_on_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF_SMALL), "test-empty")
        assert docs.count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "the river", None, "a", 9),
                                  (2, "the river", None, "a", 9), (None, "a hill of words", "en", None, 1)], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF_SMALL), "test-nulls")
    assert {r.doc_id for r in docs.collect()} <= {None, 2}


def test_last_stage_searches_for_a_second_segmentation(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    docs = spark.createDataFrame([(1, "the river of those", "en", "a", 18), (1, "the river of those", "en", "a", 18), (2, "", None, None, 0)], schema)
    got = corpus_pipeline.encode(spark, docs, SF_SMALL).collect()
    want = {(r.doc_id, r.sample): r for r in pieces.encode(docs, k=2).collect()}
    assert sorted(r.doc_id for r in got) == [1, 1, 2]
    for r in got:
        others = [want[r.doc_id, 1]] if r.doc_id == 1 else []
        assert (r.sample, r.ids, r.perturbed) == (0, want[r.doc_id, 0].ids, want[r.doc_id, 0].perturbed)
        assert [(m.sample, m.ids, m.log_prob, m.round_trip) for m in r.more] == [(1, o.ids, o.log_prob, True) for o in others]
        assert all(m.ids != r.ids for m in r.more)
