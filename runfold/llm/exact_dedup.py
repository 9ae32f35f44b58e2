"""Exact dedup: tree merge of sorted digest runs.

Every input partition becomes a run: its texts' digests, sorted, equal ones
collapsed to the smallest identifier and a count. Runs then meet in rounds of
``fan_in``: all runs of one group are dealt out by (group, digest slice), merged
in digest order, and equal digests collapse again, until one run is left. A
digest thus leaves a group at most once per round, so a text that makes up a
third of all rows never puts more than ``fan_in`` rows on any task, and slices
of 16 digest bits spread every round, the last one too, over the cluster.

Digests are verified at every level: rows are one class only where SHA-256, the
length in bytes and an independent 64-bit hash of the normalised text agree.

Defined results: null text counts as empty; a null identifier sorts after all
others (a class of null identifiers keeps one row, ``keep_id`` null); of rows
repeated with the same text and identifier one stays; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import SPACE, settle, table, text_or_empty

KEY = ["digest", "n_bytes", "check"]


def normalised(col: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: identifier, row number, digest key."""
    norm = normalised(text_col)
    return docs.select(F.col(id_col).alias("keep_id"), F.monotonically_increasing_id().alias("keep_row"),
                       F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).cast("long").alias("n_bytes"),
                       F.xxhash64(norm).alias("check"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row per key out: the first (smallest identifier) with
    the sum of the sizes. Holds one batch and one row."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        differs = np.zeros(t.num_rows, dtype=bool)
        differs[0] = True
        for k in ["run", *KEY]:
            c = t.column(k)
            differs[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy()
        first = np.flatnonzero(differs)
        sizes = np.add.reduceat(t.column("size").to_numpy(), first)
        t = t.take(pa.array(first)).set_column(t.schema.get_field_index("size"), t.schema.field("size"),
                                               pa.array(sizes, pa.int64()))
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _sorted_collapsed(runs: DataFrame) -> DataFrame:
    in_order = runs.sortWithinPartitions("run", *KEY, F.col("keep_id").asc_nulls_last(), "keep_row")
    return in_order.mapInArrow(_collapse, runs.schema)


def winners(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per distinct text of ``rows`` (settled ``digests``): key,
    ``keep_id``, ``keep_row``, ``size``."""
    runs = _sorted_collapsed(rows.select(F.shiftright("keep_row", 33).alias("run"), *KEY, "keep_id", "keep_row",
                                         F.lit(1).cast("long").alias("size")))
    left = (rows.agg(F.max(F.shiftright("keep_row", 33))).first()[0] or 0) + 1
    while True:  # at least one round, so that slices of a lone run are spread too
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
        runs = _sorted_collapsed(runs.repartition("run", F.substring("digest", 1, 2)))
        left = -(-left // fan_in)
        if left <= 1:
            return runs.drop("run")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per document: its identifier, ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256``."""
    rows = settle(digests(docs, id_col, text_col), "digests")
    won = winners(rows, fan_in).withColumnRenamed("keep_id", "won_id").withColumnRenamed("keep_row", "won_row")
    return rows.join(won, KEY).select(
        F.col("keep_id").alias(id_col), F.col("won_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("keep_row") == F.col("won_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _key(digest: Column, identifier: Column) -> Column:
    """Digest and identifier as one key without nulls: the join and the dropping
    of repeats below share one exchange, and no key is hot."""
    return F.unhex(F.sha2(F.concat(F.hex(digest), F.coalesce(F.concat(F.lit("="), identifier.cast("string")),
                                                             F.lit(""))), 256))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The documents that stay, with their columns: the winner of each text is
    found by digest and identifier; among rows that repeat both, one stays."""
    won = winners(settle(digests(docs, id_col, text_col), "digests"), fan_in)
    here = docs.withColumn("__key", _key(F.unhex(F.sha2(normalised(text_col), 256)), F.col(id_col)))
    return here.join(won.select(_key(F.col("digest"), F.col("keep_id")).alias("__key")), "__key", "left_semi") \
        .dropDuplicates(["__key"]).drop("__key")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact-duplicate classes of all documents."""
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
