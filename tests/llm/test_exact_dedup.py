"""Exact dedup and mixing against their SQL and on small cases."""

import pytest

from runfold.llm import exact_dedup, mixing
from tests.conftest import SF_SMALL
from tests.llm.compare import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, run long"


@pytest.mark.parametrize("key", ["op2_exact_dedup", "op4_mix_sources"])
def test_matches_sql(spark, duck_small, key):
    r = compare(spark, duck_small, key, SF_SMALL)
    assert r["ok"], r


def rows(spark, data):
    return spark.createDataFrame([(i, t, None, s, None, "x", 1) for i, t, s in data], SCHEMA)


def test_dedup_nulls_spaces_repeats(spark):
    docs = rows(spark, [(5, "a  b", None), (3, "a\tb", None), (3, "a b", None), (None, "a b", None), (9, None, None),
                        (8, "", None), (None, "z", None), (None, "z", None), (1, " a b", None), (2, "a b", None)])
    out = [tuple(r) for r in exact_dedup.groups(docs, fan_in=2).select(
        "doc_id", "keep_id", "group_size", "kept").collect()]
    key = lambda t: str(t)
    assert sorted(out, key=key) == sorted([
        (5, 3, 4, False), (3, 3, 4, True), (3, 3, 4, False), (None, 3, 4, False), (9, 8, 2, False), (8, 8, 2, True),
        (None, None, 2, True), (None, None, 2, False), (1, 1, 1, True), (2, 2, 1, True)], key=key)
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 8]


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_dedup_many_runs(spark, fan_in):
    docs = rows(spark, [(i, f"t{i % 7}" if i % 3 else "hot", None) for i in range(400)]).repartition(13)
    want = {}
    for i in range(400):
        want.setdefault(f"t{i % 7}" if i % 3 else "hot", []).append(i)
    for r in exact_dedup.groups(docs, fan_in=fan_in).collect():
        ids = want[f"t{r.doc_id % 7}" if r.doc_id % 3 else "hot"]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))


def test_dedup_empty(spark):
    assert exact_dedup.groups(rows(spark, [])).count() == 0
    assert exact_dedup.survivors(rows(spark, [])).count() == 0


def water_fill(sizes, weights, budget, epochs):
    """Rounds of clamping and redistribution, as one would do by hand."""
    total = budget * sum(sizes.values())
    target, free = {}, dict(weights)
    while free:
        level = (total - sum(target.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = epochs * sizes[s]
            free.pop(s)
    return target


def test_mix_targets_and_copies(spark):
    data = [(i, "w " * (1 + i % 17), ["a", "b", "c", None, "e"][min(4, i % 9)]) for i in range(3000)]
    docs = rows(spark, data)
    out = mixing.mix_report(docs).collect()
    size = {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted(x for x in size if x) + [None]
    want = water_fill(size, dict(zip(names, [3, 1, 2, 3, 1])), 1.5, 2.0)
    src = {i: s for i, _, s in data}
    taken = {}
    for r in out:
        assert abs(r.target - want[src[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[src[r.doc_id]] = taken.get(src[r.doc_id], 0) + r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 17
    again = {(r.doc_id, r.taken) for r in mixing.mix_report(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in out)


def test_mix_edge_cases(spark):
    assert mixing.mix_report(rows(spark, [])).count() == 0
    out = mixing.mix_report(rows(spark, [(1, None, "a"), (2, "", None), (None, " ", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3
    out = mixing.mix_report(rows(spark, [(1, "x y", "a"), (1, "x y", "a"), (1, "x y", "a"), (2, "x", "b")])).collect()
    assert len(out) == 4 and len({r.taken for r in out if r.doc_id == 1}) == 1
