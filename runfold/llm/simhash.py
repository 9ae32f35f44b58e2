"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in d bits share at least 8 - d of their 8 positional
bytes. For d <= 2 that is 6, and of the four positional byte pairs two are then equal: the
index lists, for each of the six choices of two byte pairs, the fingerprints that have
these four bytes. In each list the shared
positional bytes of a pair are tallied, pairs below the guaranteed 6 are dropped, the
rest verified bit by bit. Lists of more than ``LIST_ROWS`` fingerprints are not paired up:
two fingerprints differ in at most 2 bits exactly if some value is within 1 bit of both,
so their members are linked over these values, each of which has 65 neighbours at most.

Groups are connected components of the links; equal fingerprints are one node.
``survivors`` keeps the smallest identifier of each.

Defined results: a null or empty text (or one of white space) has fingerprint zero and
links like any other; fewer words than a shingle make one shingle; null identifiers never
name a component unless no other does; repeated rows are members like others, of which
one stays; extra columns pass through ``survivors``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle, table
from runfold.llm.components import components

LIST_ROWS = 64


# --------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every n-word shingle, A-Z in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    digest = xxhash.xxh64_intdigest
    count = len(words) - n + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[n - 1:])), np.uint64, count)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the 64-bit fingerprint ``fp`` of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------------- links
def close_pairs(block: np.ndarray, sig: np.ndarray, min_shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block (rows sorted by block): shared positional bytes are
    tallied, pairs with ``min_shared`` verified to differ in ``max_bits`` at most."""
    left, right = [], []
    i, apart = np.arange(len(block)), 1
    while True:
        i = i[i + apart < len(block)]
        i = i[block[i] == block[i + apart]]
        if not len(i):
            break
        diff = sig[i] ^ sig[i + apart]
        shared = (diff.view(np.uint8).reshape(len(i), -1) == 0).sum(axis=1)
        ok = (shared >= min_shared) & (np.bitwise_count(diff).sum(axis=1) <= max_bits)
        left.append(i[ok])
        right.append(i[ok] + apart)
        apart += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _list_links(min_shared: int, max_bits: int):
    """Links inside lists: one column, a list of fingerprints per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            size = np.diff(lists.offsets.to_numpy())
            fp = lists.flatten().to_numpy().astype(np.int64)
            block = np.repeat(np.arange(len(size)), size)
            a, c = close_pairs(block, fp.view(np.uint64)[:, None], min_shared, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[c])], names=["a", "b"])
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that differ in at most
    ``max_bits`` (0, 1 or 2) bits, or that are joined by a chain of such."""
    pair = [F.shiftrightunsigned("fp", 16 * g).bitwiseAND(F.lit(0xFFFF)) for g in range(4)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(pair[i], 16)).bitwiseOR(pair[j])
            for k, (i, j) in enumerate(combinations(range(4), 2))]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = postings.join(sizes, "key")
    small = lists.filter(F.col("n") <= list_rows).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = small.mapInArrow(_list_links(8 - max_bits, max_bits), "a long, b long")
    # long lists: over the values within max_bits / 2 of a fingerprint
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    ball = F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.col("fp").bitwiseXOR(x)))
    long = lists.filter(F.col("n") > list_rows).select("fp").distinct()
    near = long.select("fp", ball.alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    if max_bits == 2:
        first = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:  # the verification of a pair needs the pair: lists here have 65 rows at most
        first = near.select("fps").mapInArrow(_list_links(8 - max_bits, max_bits), "a long, b long")
    return links.union(first.filter("a <> b"))


def label(rows: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``node`` and the smallest ``id`` of its component, for the distinct nodes of
    ``rows`` (``id``, node)."""
    reps = rows.groupBy(node).agg(F.min("id").alias("rep"))
    rooted = reps.join(components(links).withColumnRenamed("node", node), node, "left") \
        .withColumn("root", F.coalesce("root", node))
    best = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(best, "root").select(node, "component_id")


def fingerprint_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: identifier, ``fingerprint`` in hex, ``component_id``."""
    rows = settle(fingerprints(docs, words, id_col, text_col), "fingerprints")
    links = fingerprint_links(rows.select("fp").distinct(), max_bits)
    return rows.join(label(rows, "fp", links), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, columns unchanged: of each component of linked
    fingerprints the one with the smallest identifier."""
    mark = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    rows = settle(fingerprints(docs.select(mark.alias("__mark"), F.col(text_col).alias("__text")), words, "__mark", "__text"),
                  "fingerprints")
    won = label(rows, "fp", fingerprint_links(rows.select("fp").distinct(), max_bits)).select("component_id").distinct()
    key = lambda m: F.sha2(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), m["id"].cast("string")), F.lit("")),
                                       m["hash"].cast("string")), 256).alias("__key")
    return docs.withColumn("__key", key(mark)).join(won.select(key(F.col("component_id"))), "__key", "left_semi") \
        .dropDuplicates(["__key"]).drop("__key")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components they link to."""
    return fingerprint_groups(table(spark, sf_dir, "documents"))
