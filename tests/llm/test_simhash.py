"""SimHash groups and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runfold.llm import simhash
from runfold.llm.components import components
from tests.conftest import SF_SMALL


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) * 2 > len(hs))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(fps):
    """fps: {id: fingerprint}; smallest id reachable."""
    ids = sorted(fps)
    return roots([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2], ids)


def test_query_by_hand(spark):
    import __spark_entry__ as e
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fps = {i: fingerprint(t) for i, t in docs.items()}
    want = groups(fps)
    out = e.queries()["op8_simhash"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("list_rows", [64, 2, 1])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_by_hand(spark, list_rows, max_bits):
    rng = random.Random(9)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    links = simhash.fingerprint_links(df, max_bits, list_rows).collect()
    got = roots([(r.a, r.b) for r in links], signed)
    want = roots([(signed[i], signed[j]) for i in range(len(fps)) for j in range(i)
                  if (fps[i] ^ fps[j]).bit_count() <= max_bits], signed)
    assert got == want


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 4000), (3000, 4000), (7, 7)]
    nodes = {x for p in pairs for x in p} | {7}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == roots(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


DOCS = "doc_id long, text string, fp string, id long, node string"


def test_edges(spark):
    rows = [(4, None), (9, ""), (2, " \n"), (None, ""), (7, "One two"), (8, "one  TWO"), (3, "x " * 40000), (3, "x " * 40000)]
    df = spark.createDataFrame([(i, t, "c", 1, None) for i, t in rows], DOCS)
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.fingerprint_groups(df).collect()}
    zero = "0" * 16
    assert {(4, zero, 2), (9, zero, 2), (2, zero, 2), (None, zero, 2)} <= out
    assert (7, f"{fingerprint('one two'):016x}", 7) in out and (8, f"{fingerprint('one two'):016x}", 7) in out
    assert simhash.fingerprint_groups(spark.createDataFrame([], DOCS)).count() == 0
    left = simhash.survivors(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 7]
    assert simhash.survivors(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("words, max_bits", [(3, 2), (2, 0), (5, 1)])
def test_survivors_by_hand(spark, words, max_bits):
    """The smallest identifier of each group of linked fingerprints stays, no other."""
    rng = random.Random(4)
    texts = []
    for b in range(40):
        base = [rng.choice(["a", "b", "C d", "e", "f\n"]) for _ in range(rng.choice([0, 2, 6, 40, 600]))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(3) if w else 0):
                w[rng.randrange(len(w))] = "Z"
            texts.append(" ".join(w[:-1] if w and rng.random() < 0.3 else w))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "c", 1, None) for i, t in enumerate(texts)], DOCS).repartition(6)
    got = {r.doc_id for r in simhash.survivors(docs, words, max_bits).collect()}
    fps = {i: int(simhash.majority(simhash.shingle_hashes(t, words))) for i, t in enumerate(texts)}
    links = [(a, b) for a in fps for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= max_bits]
    assert got == set(roots(links, fps).values())


def test_survivors_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = set(groups({r.doc_id: fingerprint(r.text) for r in docs.collect()}).values())
    assert {r.doc_id for r in simhash.survivors(docs).collect()} == want


def test_schema_of_survivors(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("key", F.lit(1))
    assert simhash.survivors(docs).schema == docs.schema
