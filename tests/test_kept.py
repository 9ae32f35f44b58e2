"""Kept tables: change sets equal the batch result and rewrite touched buckets only."""

import pytest
from pyspark.errors import AnalysisException

from runfold.operators import policy, registry
from runfold.session import staging_path
from runfold.sources.kept import KeptTable

RULES = "category string, target string, operation string, added_at string"


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "category string, target string, operation string")


def made(spark, buckets=16):
    return KeptTable(spark, staging_path(spark, "kept"), RULES, ["category", "target"], buckets)


def content(t, version=None):
    return sorted(tuple(map(str, r)) for r in t.read(version).collect())


def live(t):
    """The folder of files that each bucket is read from."""
    return {r.batch: r.write for r in t.stored._list(t.stored._pointer(t.version())).collect()}


def test_change_sets_equal_the_batch_result(spark):
    t, base = made(spark), [("commands", f"c{i}", "all") for i in range(40)]
    assert t.version() == 0 and t.read().count() == 0
    t.insert_if_absent(rules(spark, *base, *base), "t1")
    new = [("commands", "c1", "all"), ("commands", "c1", "run"), ("paths", "p", "read"), ("paths", "p", "read")]
    t.insert_if_absent(rules(spark, *new), "t2")
    gone = spark.createDataFrame([("commands", "c1"), ("commands", "nothing"), ("paths", "c2")], "category string, target string")
    t.remove_by_target(gone)
    batch = policy.insert_if_absent(spark.createDataFrame([], RULES), rules(spark, *base), "t1")
    batch = policy.remove_by_target(policy.insert_if_absent(batch, rules(spark, *new), "t2"), gone)
    assert content(t) == sorted(tuple(map(str, r)) for r in batch.select(*t.schema.names).collect())
    assert t.version() == 3 and len(content(t, 1)) == 40 and len(content(t, 2)) == 42


def test_untouched_buckets_keep_their_files(spark):
    t = made(spark)
    t.insert_if_absent(rules(spark, *[("commands", f"c{i}", "all") for i in range(200)]), "t1")
    first = live(t)
    assert len(first) == 16 and len(set(first.values())) == 1
    t.remove_by_target(spark.createDataFrame([("commands", "c7")], "category string, target string"))
    second = live(t)
    changed = {b for b in first if first[b] != second.get(b)}
    assert len(changed) == 1 and len(content(t)) == 199
    # nothing to do: no version
    t.remove_by_target(spark.createDataFrame([("commands", "c7")], "category string, target string"))
    t.insert_if_absent(rules(spark, ("commands", "c8", "all")), "t2")
    assert t.version() == 2 and live(t) == second
    before = content(t)
    t.compact()
    assert t.version() == 3 and content(t) == before and len(set(live(t).values())) == 1


def test_upserts_in_any_order(spark):
    regs = [("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z"), (None, 3, "n"), ("a", 4, "late"), ("c", 6, "w"), (None, 7, None)]
    schema = "name string, seq long, brand string"
    t = KeptTable(spark, staging_path(spark, "kept"), schema + ", overwrites long", ["name"], 4)
    for part in (regs[:3], regs[3:6], regs[6:]):
        t.upsert(spark.createDataFrame(part, schema))
    want = registry.upsert_last_wins(spark.createDataFrame(regs, schema))
    assert content(t) == sorted(tuple(map(str, r)) for r in want.collect())


def test_two_writers_and_failures(spark):
    t = made(spark)
    t.insert_if_absent(rules(spark, ("a", "x", "all")), "t1")
    seen, keys = t.version(), t.read()
    t.insert_if_absent(rules(spark, ("a", "y", "all")), "t2")
    with pytest.raises(AnalysisException):
        t.change(keys, lambda old: old, seen)

    def broken(old):
        raise RuntimeError("half way")
    with pytest.raises(RuntimeError):
        t.change(keys, broken)
    assert t.version() == 2 and len(content(t)) == 2


def test_nulls_and_integers_keep_their_bucket(spark):
    t = KeptTable(spark, staging_path(spark, "kept"), "name long, seq long, overwrites long", ["name"], 8)
    t.upsert(spark.createDataFrame([(1, 1), (None, 1)], "name long, seq long"))
    t.upsert(spark.createDataFrame([(1, 2), (None, 2)], "name int, seq long"))
    assert content(t) == [("1", "2", "1"), ("None", "2", "1")]
