"""The conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runfold.llm import trie
from tests.conftest import SF_SMALL
from tests.llm.compare import compare

TURNS = "conv_id long, turn long, role string, text string, node string, depth int, top string"


def turns_of(rows, tie):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, tie(role or "", text or ""), (role or "", text or "")))
    return {c: [x[3] for x in sorted(xs)] for c, xs in convs.items()}


def by_hand(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        listed = ",".join(str(c) for c in sorted(ends.get(node, [])))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved,
                 hashlib.sha256(listed.encode()).hexdigest()))
    return out


def rebuilt_by_hand(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 90), 45):
        for t in range(rng.choice([1, 2, 3, 6, 12])):
            rows.append((c, rng.choice([t, t, t, None]) if rng.random() < 0.2 else t, rng.choice(["user", None]),
                         rng.choice(["a", "é", "", None]) if t else rng.choice(["hi", "hi", "x" * 5000])))
    return rows


def order(xs):
    return sorted(xs, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("shard, held", [(4096, 1 << 17), (2, 1), (3, 4)])
def test_trie_by_hand(spark, monkeypatch, shard, held):
    """Several passes and spilled queues give what one pass does."""
    monkeypatch.setattr(trie.totals, "__defaults__", (held,))
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "RUNS", 2)
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else None, rng.choice(["a", "b"]) if t < 3 else rng.choice(["", "c é", None]))
            for c in range(-20, 60) for t in range(rng.choice([1, 3, 5, 9]))]
    rows += [(None, 0, "user", "lost"), (5_000_000_000, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "n", 1, "t") for r in rows], TURNS).repartition(5)
    members = spark.createDataFrame([(1,), (777,), (None,), (7_000,)], "conv_id long")
    convs = turns_of(rows, lambda *x: x)
    out = trie.prefix_trie(df, members, shard=shard)
    assert order(tuple(r) for r in out.collect()) == order(by_hand(convs | {777: [], 7000: []}))


@pytest.mark.parametrize("seed", [1, 2])
def test_query_on_rows_by_hand(spark, tmp_path, seed):
    """Nulls, ties, absent bases and repeated rows through the query's rebuilding."""
    rows = sample(seed)
    rows += rows[:10]
    df = spark.createDataFrame([(*r, "n", 1, "t") for r in rows], TURNS).repartition(4)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = trie.op13_prefix_trie(spark, str(tmp_path))
    want = by_hand(rebuilt_by_hand(turns_of(rows, lambda *x: x)))
    assert order(tuple(r) for r in out.collect()) == order(want)


def test_query_equals_sql(spark, duck_small):
    assert compare(spark, duck_small, "op13_prefix_trie", SF_SMALL)["ok"]


def test_long_conversation_in_pieces(spark, monkeypatch):
    """A conversation of many turns is numbered and summed in pieces."""
    from runfold.operators import scan
    monkeypatch.setattr(scan.running, "__defaults__", (50, *scan.running.__defaults__[1:]))
    rows = [(1, t // 2, "user", f"t{t}") for t in range(700)] + [(2, t // 2, "user", f"t{t}") for t in range(300)] + [(3, None, "user", "t0")]
    df = spark.createDataFrame([(*r, "n", 1, "t") for r in rows], TURNS)
    out = trie.prefix_trie(df).collect()
    assert sum(r.n_convs for r in out) == len(rows) + 3
    top = next(r for r in out if r.depth == 0)
    assert (top.conv_id, top.n_convs) == (1, 3)
    assert max(r.depth for r in out) == 700


def test_queue_spills_and_merges():
    q = trie.SpillingQueue(held=5)
    rng = random.Random(1)
    entries = [(-rng.randrange(9), str(rng.randrange(30)), i) for i in range(2000)]
    for e in entries:
        q.put(e)
    assert len(q.runs) <= trie.RUNS + 1 and len(q.heap) <= 5
    for key in sorted({e[:2] for e in entries}):
        assert sorted(e[2] for e in q.take(key)) == sorted(e[2] for e in entries if e[:2] == key)
    assert not q.heap and not q.runs


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).count() == 0
    turns, members = trie.regrafted(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], TURNS))
    assert trie.prefix_trie(turns, members).count() == 0
    only = trie.prefix_trie(empty, spark.createDataFrame([(4,)], "conv_id long").withColumn("turn", F.lit(1))).collect()
    assert [tuple(r)[:7] for r in only] == [(4, 0, None, 1, 0, 1, 0)]
