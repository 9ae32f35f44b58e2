"""F1 over a corpus that is searched often: trigram postings.

``write_index`` stores every (trigram, path) of a corpus once, as posting lists: per trigram
and unit of about ``UNIT`` characters the paths that hold it. A trigram of a third of all
texts is many lists, dealt over all files; files are sorted by trigram, so a search reads
the pages of its own trigrams only. ``indexed_grep`` takes the trigrams that every match of
the pattern must hold, keeps the paths that hold them all, and greps their texts: the same
rows as ``regex_grep`` over the whole corpus. A pattern without a required trigram (short,
optional or alternative parts) is searched by scan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.operators.text import regex_grep
from runfold.sources.files import split_lines

#: Paths that a search hands to the scan as a filter; more are met by a join.
LISTED_PATHS = 1000
#: Characters whose trigrams are inverted at once.
UNIT = 1 << 20

_TOKEN = re.compile(r"(?P<set>\[\^?\]?(?:[^\[\]\\]|\\.)*\])|\\(?P<escaped>.)|(?P<open>\()|(?P<close>\))"
                    r"|(?P<repeat>[*+?]|\{[0-9]+(?:,[0-9]*)?\})|(?P<any>[.^$])|(?P<char>[^\\\[\]{}()*+?.^$|])", re.DOTALL)


def trigrams(content: Column) -> Column:
    """The distinct runs of three characters, in one pass over the text."""
    chars = F.split(content, "")
    joined = lambda a, b: F.concat(a, b)  # noqa: E731  (NULL where one side is shorter)
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), joined)
    return F.array_distinct(F.array_compact(F.zip_with(pairs, F.slice(chars, 3, F.size(chars)), joined)))


def required_runs(pattern: str) -> list[str]:
    """Runs of characters that stand in every match. Empty where there are none or the
    pattern has parts we don't follow (alternatives, flags, nested sets, codes)."""
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        t = _TOKEN.match(pattern, at)
        if t is None or pattern.startswith("(?", at) or (t["escaped"] or "") in [*"QExuNpPkc0123456789"]:
            return []
        at = t.end()
        char = t["char"] or (t["escaped"] if t["escaped"] and not t["escaped"].isalnum() else None)
        if char and not depth:
            run += char
            continue
        if t["repeat"] and t["repeat"] != "+":
            run = run[:-1]  # the character before may be missing
        runs.append(run)
        run = ""
        depth += bool(t["open"]) - bool(t["close"])
    return [r for r in [*runs, run] if r]


def required_trigrams(pattern: str) -> list[str]:
    return sorted({r[i:i + 3] for r in required_runs(pattern) for i in range(len(r) - 2)})


def postings(paths: pa.Array, texts: list[str]) -> list[pa.RecordBatch]:
    """Per distinct trigram of ``texts`` the list of the paths whose texts hold it."""
    n = len(texts)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    if not len(code):
        return []
    used = np.flatnonzero(np.bincount(code))  # characters are numbered, so that three and a text are one number
    if n > 1 and len(used) ** 3 * n >= 1 << 63:
        return postings(paths[:n // 2], texts[:n // 2]) + postings(paths[n // 2:], texts[n // 2:])
    number = np.zeros(int(used[-1]) + 1, dtype=np.int64)
    number[used] = np.arange(len(used))
    c, size = number[code], np.fromiter(map(len, texts), dtype=np.int64, count=n)
    text = np.repeat(np.arange(n), size)
    whole = text[2:] == text[:-2]
    three = (c[:-2] * len(used) + c[1:-1]) * len(used) + c[2:]
    each = np.sort((three * n + text[:-2])[whole])
    each = each[np.diff(each, prepend=-1) > 0]
    if not len(each):
        return []
    three, text = np.divmod(each, n)
    start = np.flatnonzero(np.diff(three, prepend=-1))
    head = three[start]
    chars = used[np.stack([head // len(used) ** 2, head // len(used) % len(used), head % len(used)], axis=1)]
    joined = chars.astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(each)), pa.int32()), paths.take(pa.array(text)))
    return [pa.RecordBatch.from_arrays([pa.array([joined[i:i + 3] for i in range(0, len(joined), 3)], pa.string()), lists],
                                       names=["trigram", "paths"])]


def write_index(corpus: DataFrame, dest: str, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, trigram)`` of ``corpus`` written to ``dest`` and read back. Texts that are
    NULL or shorter than three characters have no row."""
    texts = corpus.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    kind = T.StructType([T.StructField("trigram", T.StringType()), T.StructField("paths", T.ArrayType(texts.schema["path"].dataType))])

    def run(batches):
        for b in batches:
            size = pc.utf8_length(b.column(1)).to_numpy()
            unit = (np.cumsum(size) - 1) // UNIT
            bound = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(size)]
            for lo, hi in zip(bound[:-1], bound[1:]):
                yield from postings(b.column(0)[lo:hi], b.column(1)[lo:hi].to_pylist())

    lists = texts.mapInArrow(run, kind)
    lists.repartition("trigram", F.col("paths")[0]).sortWithinPartitions("trigram").write.parquet(dest)
    return corpus.sparkSession.read.schema(kind).parquet(dest).select(F.explode("paths").alias("path"), "trigram")


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """The paths whose texts hold every required trigram; None if there is none."""
    need = required_trigrams(pattern)
    if not need:
        return None
    return (index.where(F.col("trigram").isin(need)).groupBy("path").agg(F.count_distinct("trigram").alias("n"))
                 .where(F.col("n") == len(need)).select("path"))


def indexed_grep(corpus: DataFrame, index: DataFrame, pattern: str, path: str = "path", content: str = "content",
                 listed: int = LISTED_PATHS) -> DataFrame:
    """F1 through the index: ``(path, line_no, line, match)``. Up to ``listed`` candidate
    paths go into the corpus scan as a pushed filter, more are met by a join."""
    texts = corpus.select(F.col(path).alias("path"), F.col(content).alias("content"))
    found = candidates(index, pattern)
    if found is not None:
        few = [r.path for r in found.take(listed + 1)]
        if len(few) <= listed and None not in few:
            texts = texts.where(F.col("path").isin(few))
        else:
            found = found.withColumnRenamed("path", "__path")
            texts = texts.join(found, F.col("path").eqNullSafe(F.col("__path")), "left_semi")
    return regex_grep(split_lines(texts), pattern)
