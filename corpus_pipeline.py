"""The corpus pipeline: documents to sampled token sequences.

Every stage works on all that its predecessor kept and is written as Parquet and
read again before the next:

1. language ID: documents whose language can't be told (no letter, no text) go;
2. exact dedup: of equal texts the smallest identifier stays;
3. SimHash near-dedup: of documents whose fingerprints (three-word shingles) are linked
   by steps of two differing bits at most, the smallest identifier stays;
4. mixing: sources come to weights 3, 1, 2, repeating, within 150 % of all words and
   twice a source's own; a repeated document is several rows;
5. SentencePiece: for each row two distinct segmentations are drawn by best-first
   search, seeded by its identifier; the first stands in the row, the other in ``more``.

Rows with nulls, ties, repeats and clashing column names are treated as the stages'
operators state. The stages are not SQL (models, sampling, hashing): tests compare
them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runfold.llm import exact_dedup, langid, mixing, pieces, simhash
from runfold.llm.common import settle, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs, words=3, max_bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, k=2, keep=["doc_id", "lang", "source"], one_row=True)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: No SQL: a classifier, hashes and sampling decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
