"""Skew-safe ordered scans over keyed logs.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of one key to
one task; if one session holds a third of a 100 TB log, that task never ends.
These helpers cut the rows of each key, in order, into *pieces* of about ``width``
rows and stitch the pieces back together:

1. a key with at most ``width`` rows is one piece (and needs no further row); a
   larger one is cut into equal ranges of its own order values, one per ``width``
   rows, and ranges that hold over twice ``width`` rows are cut again the same way
   until none does; rows with one value of the first order column are cut by the next
   ones, so rows at one time stay together only where the whole order is the same;
2. each piece of a key with several is summarised (partial aggregates), and an
   exclusive running fold over a key's summaries gives every piece its *carry-in*:
   at most 2 rows per ``width`` input rows in all, none for other keys;
3. each carry-in is added to its piece as a leading "seed" row, and one window per
   piece folds seed + rows: the full rows are shuffled once, never joined back,
   and NULL keys group as in a plain window.

This is the classic two-level parallel prefix scan, written with built-in
aggregates and windows only. The width is a tuning knob, not a cap: every row is
processed whatever it is. Where no key has several pieces there is nothing to
stitch, and the scan is a plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.operators.common import settled

DEFAULT_WIDTH = 1 << 16
#: Numbers of 7 bytes each by which a text order is cut; texts equal in all are one piece.
TEXT_PIECES = 4
_SEED = "__seed"


@dataclass(frozen=True)
class Run:
    """One running fold: ``kind`` in ``last_nonnull``, ``last_where``,
    ``sum``, ``count``. ``last_where`` keeps the value of the last row whose
    ``flag`` is true, even when that value is NULL."""

    out: str
    kind: str
    col: str | None = None
    flag: str | None = None


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def ordinals(df: DataFrame, col: str) -> tuple[list[Column], bool]:
    """Whole numbers whose lexicographic order is that of ``col`` (null first), small
    enough for differences; False where they do not tell all its values apart."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        piece = lambda i: F.rpad(F.hex(F.substring(raw, 7 * i + 1, 7)), 14, "0")
        parts = [F.when(c.isNotNull(), F.conv(piece(i), 16, 10).cast("bigint")) for i in range(TEXT_PIECES)]
        return [F.coalesce(p, F.lit(-1)) for p in parts], False
    elif isinstance(kind, (T.DecimalType, T.FractionalType)):
        far = F.lit(1 << 60).cast("double")
        return [F.floor(F.greatest(F.least(F.coalesce(c.cast("double"), -far), far), -far)).cast("bigint")], False
    elif not isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [], False
    c = c.cast("bigint")
    return [F.coalesce(F.shiftright(c, 32).cast("bigint"), F.lit(-1 << 32)), F.coalesce(c.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))], True


def order_cuts(df: DataFrame, orders: list[str]) -> list[Column]:
    """``ordinals`` of the order columns, up to the first that they do not tell apart."""
    cuts: list[Column] = []
    for o in orders:
        cols, exact = ordinals(df, o)
        cuts += cols
        if not exact:
            break
    return cuts


def _over_full(d: DataFrame, by: list[str], most: int, width: int, level: int) -> DataFrame:
    """Groups ``by`` with more than ``most`` rows: smallest order value and the length of
    equal ranges of ``width`` rows on average (null where all have one order value)."""
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__cut").alias("lo"), F.max("__cut").alias("hi")).where(F.col("n") > most)
    step = F.when(F.col("hi") > F.col("lo"), F.expr(f"(hi - lo) div ceil(n / {int(width)}) + 1"))
    return settled(n.select(*by, F.col("lo").alias(f"__lo{level}"), step.alias(f"__step{level}")), "scan-ranges")


def cut_keys(df: DataFrame, keys: list[str], cut: Column | list[Column], width: int) -> tuple[DataFrame, list[str]] | None:
    """``df`` with the piece of every row and ``__several`` (its key has more than
    one piece), and the columns that name a piece; None if no key has several.
    ``cut`` is one whole number that does not decrease along the order, or several, of
    which each does not decrease among rows with equal ones before. Every round cuts what
    is still too large; ranges shrink by rows / width each time, and what has one value of
    a number is cut by the next."""
    d, named = df.withColumn("__several", F.lit(False)), []
    for c in cut if isinstance(cut, list) else [cut]:
        d = d.withColumn("__cut", c.cast("bigint"))
        first = True
        while True:
            level = len(named)
            over = _over_full(d if first else d.where("__several"), [*keys, *named], (2 if level else 1) * width, width, level)
            if over.isEmpty():
                return (d.drop("__cut"), named) if named else None
            large = over.where(F.col(f"__step{level}").isNotNull())
            if large.isEmpty():
                break
            first = False
            d = _null_safe(d, large, [*keys, *named], "left").withColumn("__several", F.col("__several") | F.col(f"__lo{level}").isNotNull())
            at = F.coalesce(F.expr(f"(__cut - __lo{level}) div __step{level}"), F.lit(0)).cast("bigint")
            named.append(f"__piece{level}")
            d = d.withColumn(named[-1], at).drop(f"__lo{level}", f"__step{level}")
    return (d.drop("__cut"), named) if named else None


def running(df: DataFrame, keys: list[str], order, runs: list[Run],
            width: int = DEFAULT_WIDTH, bucketed: bool = True, bucket: Column | None = None,
            descending: bool = False, cut: Column | None = None) -> DataFrame:
    """Add one column per ``Run`` holding the fold of all rows of the same
    key up to and including this row.

    ``order`` is a column name or a list of names (lexicographic, unique per
    key). ``cut`` is a whole-number column, non-decreasing along ``order``, by
    which keys are cut first; then, and by default, the order columns themselves cut them
    (``order_cuts``); ``bucket`` gives the pieces outright instead. ``descending=True`` folds from the last row
    backwards (a suffix scan: "the next … at or after this row"). NULL keys form
    one group, as in a plain window.
    """
    orders = [order] if isinstance(order, str) else list(order)
    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in orders]
    d = None
    if bucketed and bucket is not None:
        d, named = df.withColumn("__piece0", bucket).withColumn("__several", F.lit(True)), ["__piece0"]
    elif bucketed:
        if cut is None and len(orders) == 1 and isinstance(df.schema[orders[0]].dataType, T.IntegralType):
            cut = F.col(orders[0])
        d, named = cut_keys(df, keys, [*([] if cut is None else [cut]), *order_cuts(df, orders)], width) or (None, [])
    if d is None:
        w = Window.partitionBy(*keys).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
        out = df
        for r in runs:
            out = out.withColumn(r.out, _plain(r, w))
        return out
    # the per-row input of each fold
    for i, r in enumerate(runs):
        if r.kind == "last_nonnull":
            x = F.col(r.col)
        elif r.kind == "last_where":
            x = F.when(F.col(r.flag), F.struct(F.col(r.col).alias("v")))
        elif r.kind == "sum":
            x = F.col(r.col)
        elif r.kind == "count":
            x = F.lit(1).cast("bigint")
        else:
            raise ValueError(f"unknown run kind {r.kind}")
        d = d.withColumn(f"__rf_x{i}", x)

    # 1. summaries of the pieces: partial aggregates, combined map-side
    o = F.struct(*[F.col(c) for c in orders]) if len(orders) > 1 else F.col(orders[0])
    pick = F.min_by if descending else F.max_by
    aggs = []
    for i, r in enumerate(runs):
        x = F.col(f"__rf_x{i}")
        if r.kind in ("last_nonnull", "last_where"):
            aggs.append(pick(x, F.when(x.isNotNull(), o)).alias(f"__rf_x{i}"))
        else:
            aggs.append(F.sum(x).alias(f"__rf_x{i}"))
    summary = d.where("__several").groupBy(*keys, *named).agg(*aggs)

    # 2. carry-in of each piece: fold of the earlier ones (one row per piece)
    porder = [F.col(p).desc() if descending else F.col(p).asc() for p in named]
    wk = Window.partitionBy(*keys).orderBy(*porder).rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for i, r in enumerate(runs):
        x = F.col(f"__rf_x{i}")
        carry.append((F.last(x, ignorenulls=True) if r.kind in ("last_nonnull", "last_where")
                      else F.sum(x)).over(wk).alias(f"__rf_x{i}"))
    seeds = summary.select(*keys, *named, *carry, F.lit(0).alias(_SEED))

    # 3. each carry-in enters its piece's window partition as a first "seed" row, so
    #    the running fold includes it: no join back, the full rows are shuffled once
    u = d.withColumn(_SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    wb = (Window.partitionBy(*keys, *named).orderBy(F.col(_SEED).asc(), *ocols)
                .rowsBetween(Window.unboundedPreceding, 0))
    for i, r in enumerate(runs):
        x = F.col(f"__rf_x{i}")
        if r.kind == "last_nonnull":
            v = F.last(x, ignorenulls=True).over(wb)
        elif r.kind == "last_where":
            v = F.last(x, ignorenulls=True).over(wb).getField("v")
        else:
            v = F.coalesce(F.sum(x).over(wb), F.lit(0))
        u = u.withColumn(r.out, v)
    return u.where(F.col(_SEED) == 1).drop(*named, "__several", _SEED, *[f"__rf_x{i}" for i in range(len(runs))])


def _plain(r: Run, w) -> Column:
    if r.kind == "last_nonnull":
        return F.last(F.col(r.col), ignorenulls=True).over(w)
    if r.kind == "last_where":
        return F.last(F.when(F.col(r.flag), F.struct(F.col(r.col).alias("v"))), ignorenulls=True).over(w).getField("v")
    if r.kind == "sum":
        return F.coalesce(F.sum(F.col(r.col)).over(w), F.lit(0))
    if r.kind == "count":
        return F.count(F.lit(1)).over(w)
    raise ValueError(f"unknown run kind {r.kind}")


def next_in_group(df: DataFrame, keys: list[str], order: str, cols: list[str],
                  width: int = DEFAULT_WIDTH, bucketed: bool = True,
                  prefix: str = "next_", with_firsts: bool = False):
    """Add ``next_<col>`` (the value on the following row of the same key, or
    NULL on the last row) and ``next_<order>``, without one task per key:
    the first row of the next piece enters each piece's window partition
    as a trailing seed row, so ``lead`` reaches across the cut.

    ``with_firsts=True`` also returns each key's first row (a struct of
    ``cols`` and ``order``), a partial aggregate."""
    names = [*cols, order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in names]), F.col(order)).alias("first"))
    d, named = (cut_keys(df, keys, F.col(order), width) if bucketed else None) or (None, [])
    if d is None:
        w = Window.partitionBy(*keys).orderBy(order)
        out = df
        for c in names:
            out = out.withColumn(prefix + c, F.lead(c).over(w))
        return (out, first) if with_firsts else out
    firsts = d.where("__several").groupBy(*keys, *named).agg(
        F.min_by(F.struct(*[F.col(c) for c in names]), F.col(order)).alias("__f"))
    nxt = firsts.select(*keys, *named, F.lead("__f").over(Window.partitionBy(*keys).orderBy(*named)).alias("__nf"))
    seeds = (nxt.where(F.col("__nf").isNotNull())
                .select(*keys, *named, *[F.col("__nf").getField(c).alias(c) for c in names], F.lit(1).alias(_SEED)))
    u = d.withColumn(_SEED, F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    wb = Window.partitionBy(*keys, *named).orderBy(F.col(_SEED).asc(), F.col(order).asc())
    for c in names:
        u = u.withColumn(prefix + c, F.lead(c).over(wb))
    out = u.where(F.col(_SEED) == 0).drop(*named, "__several", _SEED)
    return (out, first) if with_firsts else out


CONCAT_WIDTH = 1024


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, sep: str,
                   out: str = "text", width: int = CONCAT_WIDTH, whole: bool = False) -> DataFrame:
    """Texts joined by ``sep`` in ``order`` per key (NULL texts skipped).

    Default: the joined text in ordered *parts*, one row per (key, part) with
    ``part = order div width``; joining the parts in part order with ``sep``
    gives the whole text. Each part holds at most ``width`` rows, so no task
    builds one unbounded string for a hot key. ``whole=True`` adds a second
    level that joins the parts into one string per key (bounded keys only)."""
    lvl1 = (df.withColumn("part", F.expr(f"`{order}` div {int(width)}"))
              .where(F.col(text).isNotNull())
              .groupBy(*keys, "part")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                                            lambda x: x.getField("t")), sep).alias(out)))
    if not whole:
        return lvl1
    return (lvl1.groupBy(*keys)
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("part").alias("o"), F.col(out).alias("t")))),
                                              lambda x: x.getField("t")), sep).alias(out)))
