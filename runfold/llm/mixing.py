"""Mixing sources to target weights by capped water-filling.

Each source has a weight; together they share ``budget`` times the words of the
corpus. A source may be repeated ``max_epochs`` times at most: where its share is
above that, it is clamped and the excess goes to the others by weight, until no
share is above its clamp. In closed form: order sources by clamp / weight; with
the first k clamped the water level is (shared words - their clamps) / (weights
of the rest), and the level that all rounds of redistribution end at is the
largest of these.

A source with target t and s words gives floor(t / s) whole repetitions of every
document and one more copy of documents that hold t - floor(t / s) * s words: those
first in the order of a seeded hash of the identifier, up to the document whose
middle passes the mark (whole documents, so a source ends within half a document of
its target). The mark is found from per-source sums over 4096 hash ranges and then
inside the one range that it falls into; no source is ever sorted whole, and a
document is chosen by comparing its hash with its source's mark.

Defined results: null text has size 0; a null source is a source, last in order;
null identifiers hash as empty and, like all rows that repeat an identifier, are
taken or left together; extra columns pass through ``mixed``; an empty table
gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm.common import settle, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
RANGE_BITS = 12


def words_in(col: str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def seeded_hash(id_col: str, seed: int) -> Column:
    """60 bits of MD5 of seed and identifier."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_key(source_col: str) -> Column:
    """A key without nulls, so that joins on it need no null-safe equality."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Per source (``src``): ``source_size``, ``target``, whole repetitions and the
    words that the fractional one takes. ``sizes``: ``src``, ``size``. The windows
    without a key run over one row per source, not over documents."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src") == "", "src")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("clamp") / F.col("w"), F.col("src") == "", "src")
    every = Window.partitionBy()
    clamped = F.coalesce(F.sum("clamp").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    shared = F.sum("source_size").over(every) * F.lit(float(budget))
    per = per.withColumn("level", (shared - clamped) / rest)
    per = per.withColumn("level", F.max("level").over(every))
    per = per.withColumn("target", F.least("clamp", F.col("level") * F.col("w")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", whole.cast("long"))
    return per.select("src", "source_size", "target", "whole",
                      (F.col("target") - F.col("whole") * F.col("source_size")).alias("part"))


def marks(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """``per_source`` with ``mark``: documents whose hash is not above it get the
    extra copy. ``sizes``: ``src``, ``h``, ``size``."""
    shift = HASH_BITS - RANGE_BITS
    in_range = sizes.withColumn("range", F.shiftright("h", shift))
    upto = Window.partitionBy("src").orderBy("range")
    sums = in_range.groupBy("src", "range").agg(F.sum("size").alias("n")) \
        .withColumn("before", F.sum("n").over(upto) - F.col("n"))
    edge = sums.join(per_source.select("src", "part"), "src") \
        .filter((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("n"))) \
        .select("src", "range", "before", "part")
    # the one range per source that the mark falls into; equal hashes stay together
    inside = in_range.join(edge, ["src", "range"]).groupBy("src", "range", "before", "part", "h") \
        .agg(F.sum("size").alias("n"))
    mid = F.col("before") + F.sum("n").over(Window.partitionBy("src").orderBy("h")) - F.col("n") / 2
    inside = inside.withColumn("mid", mid).groupBy("src").agg(
        F.max(F.when(F.col("mid") <= F.col("part"), F.col("h"))).alias("last"), F.min("range").alias("range"))
    mark = inside.select("src", F.coalesce("last", F.shiftleft("range", shift) - 1).alias("mark"))
    return per_source.join(mark, "src", "left").withColumn(
        "mark", F.when(F.col("part") > 0, F.coalesce("mark", F.lit((1 << HASH_BITS) - 1))).otherwise(F.lit(-1)))


def plan(docs: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, seed: int, id_col: str,
         text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Settled sizes, one narrow row per document, and the plan per source."""
    sizes = settle(docs.select(F.col(id_col), source_key(source_col).alias("src"), words_in(text_col).alias("size"),
                               seeded_hash(id_col, seed).alias("h")), "mix_sizes")
    return sizes, settle(marks(sizes, targets(sizes, weights, budget, max_epochs)), "mix_plan")


def copies() -> Column:
    return F.col("whole") + (F.col("h") <= F.col("mark")).cast("long")


def mix_report(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0,
               seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size and how many of its words the mix takes."""
    sizes, per_source = plan(docs, weights, budget, max_epochs, seed, id_col, text_col, source_col)
    return sizes.join(per_source, "src").select(
        id_col, "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0,
          seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    _, per_source = plan(docs, weights, budget, max_epochs, seed, id_col, text_col, source_col)
    names = ("src", "whole", "mark")
    per_source = per_source.select(*[F.col(c).alias(f"__{c}") for c in names])
    n = F.col("__whole") + (seeded_hash(id_col, seed) <= F.col("__mark")).cast("long")
    return docs.withColumn("__src", source_key(source_col)).join(per_source, "__src") \
        .withColumn("__copies", n).filter("__copies > 0") \
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2, repeating, 150 % of all words."""
    return mix_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS w,
             2.0 * source_size AS clamp FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
                 - coalesce(sum(CAST(clamp AS DOUBLE)) OVER (ORDER BY clamp / w, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY clamp / w, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(clamp AS DOUBLE), max(level) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, CAST(sum(n) OVER (PARTITION BY source ORDER BY h) AS DOUBLE) - n / 2.0 AS mid FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * copies AS BIGINT) AS taken, copies
FROM (SELECT d.doc_id, d.size, p.source_size, p.target,
             whole + CASE WHEN target - whole * source_size > 0 AND mid <= target - whole * source_size
                          THEN 1 ELSE 0 END AS copies
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
             JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h)
"""
