"""Conversation prefix trie by time-forward processing.

A node is a distinct sequence of first turns; its key is made of sums, one per 32 bits of
two hashes of (position, role, text) of each turn, so keys of all prefixes are running sums
and a parent's key is the node's less its last turn. Nodes, their members, ends and parents
are partial aggregates and joins.

Subtree totals go to parents by time-forward processing: nodes are sorted by reverse level
order (Spark's external sort), and each node takes its children's totals from a priority
queue, whose entries are addressed by place in that order, and puts its own total there
for its parent. The queue spills sorted runs. A shard is closed under subtrees: nodes with
at most ``shard`` members whose parents have more are shard roots, with all that lies below
them in one shard, and shards are dealt out by root. Totals of shard roots are summed per
parent (partial aggregates) and enter the next pass, over nodes with at most ``shard ** 2``
members, as what is known of its leaves; passes go on until the root of all is done. A node
that starts a third of all conversations is thus one row of a late, small pass.

A conversation of very many turns is numbered and summed in pieces (``scan.running``); its
own path has no branches and is read, sorted, by one task, of which the queue holds one
entry.

Defined results: rows are ordered by turn, null first, ties by a hash of role and text; a
null role or text is empty; rows without a conversation belong to none and are left out;
repeated rows are turns like others; texts are hashed whole; a conversation without turns
(``members``) ends at the root; an empty table has no root, so no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle, table, text_or_empty
from runfold.operators.scan import Run, running

#: Members of the largest node of a first shard.
SHARD = 4096
#: Entries of a priority queue in memory, and of a block of a spilled run.
HELD = 1 << 17
BLOCK = 1 << 12
#: Spilled runs that are open at once.
RUNS = 32
ROOT = "0" * 32


# ---------------------------------------------------------------- priority queue
class SpillingQueue:
    """Least entries first; at most ``held`` are in memory. The others are sorted runs in
    files without a name in the folder where Spark's own tasks spill; they are gone when
    the task ends, however it ends."""

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (least entry, number, the rest of the run)
        self.made = 0

    def put(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            entries, self.heap = self.heap, []
            entries.sort()
            self._spill(iter(entries))
            if len(self.runs) > RUNS:
                runs = [self._whole(first, rest) for first, _, rest in self.runs]
                self.runs = []
                self._spill(heapq.merge(*runs))

    @staticmethod
    def _whole(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
        yield first
        yield from rest

    def _spill(self, entries: Iterator[tuple]) -> None:
        f = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        block: list[tuple] = []
        for e in entries:
            block.append(e)
            if len(block) == BLOCK:
                pickle.dump(block, f)
                block = []
        if block:
            pickle.dump(block, f)
        f.seek(0)
        self._read(self._blocks(f))

    @staticmethod
    def _blocks(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def _read(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, run))

    def take(self, address: tuple) -> Iterator[tuple]:
        """All entries that begin with ``address``, which is the least of all."""
        n = len(address)
        while self.heap and self.heap[0][:n] == address:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:n] == address:
            entry, _, rest = heapq.heappop(self.runs)
            yield entry
            self._read(rest)


def _time_forward(held: int):
    """Nodes in reverse level order (deepest first) in; out come the nodes with
    ``n_children``, ``n_leaves`` and ``saved`` of their subtrees. What is known of children
    in earlier passes comes in these columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(held)
        for b in batches:
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            n_children, n_leaves, saved = cols["n_children"], cols["n_leaves"], cols["saved"]
            for i, (depth, node, parent, top) in enumerate(zip(cols["depth"], cols["node"], cols["parent"], cols["top"])):
                for _, _, leaves, tokens in queue.take((-depth, node)):
                    n_children[i] += 1
                    n_leaves[i] += leaves
                    saved[i] += tokens
                if not n_children[i]:
                    n_leaves[i] = 1
                if not top:
                    queue.put((1 - depth, parent, n_leaves[i], saved[i]))
            done = {"n_children": n_children, "n_leaves": n_leaves, "saved": saved}
            yield pa.RecordBatch.from_arrays([pa.array(done[c], pa.int64()) if c in done else b.column(i)
                                              for i, c in enumerate(b.schema.names)], schema=b.schema)
    return run


# ---------------------------------------------------------------------- prefixes
def _halves(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def _place(turn: Column) -> Column:
    """A whole number that does not decrease along ``turn`` (null first), not too far from
    zero for differences."""
    far = F.lit(1 << 60)
    return F.greatest(F.least(F.coalesce(turn.cast("long"), -far), far), -far)


def numbered(turns: DataFrame, keys: list[str], out: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``out``: the place of each row of a conversation, from 0; ties of ``turn`` by ``keys``."""
    ranked = running(turns, [conv], [turn, *keys], [Run(out, "count")], cut=_place(F.col(turn)))
    return ranked.withColumn(out, F.col(out) - 1)


def steps(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Per turn of a conversation: ``conv``, ``depth`` (from 1), the ``node`` it leads to,
    the ``parent`` it comes from and the ``size`` of its text in bytes."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit("two"), role, text).alias("two"), F.octet_length(text).cast("long").alias("size"))
    rows = numbered(rows, ["one", "two"], "at")
    parts = [*_halves(F.xxhash64("at", "one", "two")), *_halves(F.xxhash64("two", "at", "one"))]
    rows = rows.select("conv_id", "at", "size", *[p.alias(f"h{i}") for i, p in enumerate(parts)])
    rows = running(rows, ["conv_id"], "at", [Run(f"s{i}", "sum", f"h{i}") for i in range(4)])
    key = lambda cols: F.concat(*[F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for c in cols])
    return rows.select(F.col("conv_id").alias("conv"), (F.col("at") + 1).alias("depth"), "size",
                       key([F.col(f"s{i}") for i in range(4)]).alias("node"),
                       key([F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)]).alias("parent"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``node`` and the SHA-256 of its ``conv``s in order, comma-joined. Ranges of 4,096
    identifiers are joined apart; the digest then reads a node's ranges in order."""
    parts = ends.groupBy("node", F.expr("conv div 4096").alias("part")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
    in_order = parts.repartition("node").sortWithinPartitions("node", "part").select("node", "text")
    return in_order.mapInArrow(run, "node string, ends_sha256 string")


def totals(nodes: DataFrame, path: DataFrame, n_members: int, shard: int, held: int = HELD) -> DataFrame:
    """``nodes`` with ``n_children``, ``n_leaves`` and ``saved`` summed over subtrees, by
    passes over shards. ``path``: ``conv``, ``depth``, ``node``, ``n_convs`` of all turns."""
    bounds = [shard]
    while bounds[-1] < n_members:
        bounds.append(bounds[-1] * shard)
    level = F.lit(len(bounds))
    for i in reversed(range(len(bounds) - 1)):
        level = F.when(F.col("n_convs") <= bounds[i], i + 1).otherwise(level)
    rows = nodes.withColumn("level", level)
    if len(bounds) > 1:  # the shard root of a node lies on the path of its smallest member
        roots = path.groupBy("conv").agg(*[F.min_by("node", F.when(F.col("n_convs") <= b, F.col("depth"))).alias(f"root{i + 1}")
                                           for i, b in enumerate(bounds[:-1])])
        own = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(f"root{i + 1}")) for i in range(len(bounds) - 1)], F.lit(ROOT))
        rows = rows.join(roots.withColumnRenamed("conv", "conv_id"), "conv_id", "left").withColumn("root", own)
        rows = settle(rows.select(*nodes.columns, "level", "root"), "trie-levels")
    else:
        rows = rows.withColumn("root", F.lit(ROOT))
    zero = F.lit(0).cast("long")
    done: DataFrame | None = None
    for i in range(len(bounds)):
        now = rows.filter(F.col("level") == i + 1)
        if done is None:
            now = now.withColumns({"n_children": zero, "n_leaves": zero, "saved": F.col("own")})
        else:
            sent = done.filter("top").groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
            now = now.join(sent, "node", "left").withColumns({
                "n_children": F.coalesce("c", zero), "n_leaves": F.coalesce("l", zero), "saved": F.col("own") + F.coalesce("s", zero)})
        now = now.withColumn("top", F.col("node") == F.col("root"))
        now = now.select(*nodes.columns, "root", "top", "n_children", "n_leaves", "saved")
        swept = now.repartition("root").sortWithinPartitions(F.col("depth").desc(), "node").mapInArrow(_time_forward(held), now.schema)
        swept = settle(swept, "trie-pass")
        done = swept if done is None else done.union(swept)
    return done


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that the subtree
    says once instead of once per member) and ``ends_sha256`` (of the members that end
    there). ``members`` (``conv_id``) adds conversations that may have no turns."""
    path = settle(steps(turns, conv_col, turn_col, role_col, text_col), "trie-steps")
    convs = path.filter("depth = 1").select("conv")
    last = path.groupBy("conv").agg(F.max("depth").alias("last"))
    if members is not None:
        convs = members.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("conv")).union(convs).distinct()
    kind = path.schema["conv"].dataType
    nodes = path.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("size").alias("size"),
                                     F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0") \
        .select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
                F.lit(0).cast("long").alias("size"), F.col("conv_id").cast(kind), "n_convs")
    nodes = settle(nodes.union(top).withColumn("own", (F.col("n_convs") - 1) * F.col("size")).drop("size"), "trie-nodes")
    n_members = nodes.agg(F.max("n_convs")).first()[0] or 0
    weighed = path.join(nodes.select("node", "n_convs"), "node").select("conv", "depth", "node", "n_convs")
    swept = totals(nodes, weighed, n_members, shard)
    ends = convs.join(last, "conv", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    ends = ends.filter("last = 0").select(F.lit(ROOT).alias("node"), "conv").union(
        path.join(last, "conv").filter("depth = last").select("node", "conv"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return swept.join(above, "parent", "left").join(end_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


# ------------------------------------------------------------------------- query
def regrafted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 5, then its
    own after its first h (h: crc32 of c in decimal, modulo 9). Turns, and all ``conv_id``."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    turns = settle(numbered(turns, ["role", "text"], "at"), "trie-turns")
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    plan = n.withColumn("base", base).join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("has")), "base", "left") \
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9) \
        .select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("head"))
    # a base gives its first 8 turns at most to the conversations next to it
    near = F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda o: F.try_add(F.col("conv_id"), o.cast("long"))))
    given = turns.filter("conv_id % 5 = 0 and at < 8").select(F.col("conv_id").alias("from"), near.alias("conv_id"), "at", "role", "text") \
        .filter("conv_id - conv_id % 5 = `from`").join(plan, "conv_id").filter("at < h")
    own = turns.join(plan, "conv_id").filter("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("head"))
    cols = ["conv_id", F.col("at").alias("turn"), "role", "text"]
    return given.select(*cols).union(own.select(*cols)), plan.select("conv_id")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    turns, members = regrafted(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, members)


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, n, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                 lambda p, q: list_reduce(list_concat([xor(p, q)], list_transform(range(8), lambda i: 0::UBIGINT)),
                              lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 9 AS h
        FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
plan AS (SELECT a.c, a.c - a.c % 5 AS base, a.h::BIGINT AS h, least(a.h::BIGINT, coalesce(b.n, 0)) AS head
         FROM crc a LEFT JOIN crc b ON b.c = a.c - a.c % 5),
rebuilt AS (SELECT p.c, t.k, t.role, t.text FROM plan p JOIN t ON t.c = p.base WHERE t.k < p.h
            UNION ALL SELECT p.c, t.k - p.h + p.head, t.role, t.text FROM plan p JOIN t ON t.c = p.c WHERE t.k >= p.h),
paths AS (SELECT c, k + 1 AS depth, octet_length(encode(text)) AS size,
                 md5(string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY k)) AS node FROM rebuilt
          UNION ALL SELECT c, 0, 0, '' FROM plan),
nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own FROM paths GROUP BY node, depth),
tree AS (SELECT n.*, p.node AS parent, u.conv_id AS parent_conv_id FROM nodes n
         LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM tree WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.node, sum(t.own) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves
         FROM tree t LEFT JOIN kids k ON k.node = t.node JOIN paths p ON p.c = t.conv_id AND p.depth <= t.depth GROUP BY p.node),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
         FROM (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS last FROM paths) WHERE last GROUP BY node)
SELECT t.conv_id, t.depth::BIGINT AS depth, t.parent_conv_id, t.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t JOIN sums s ON s.node = t.node LEFT JOIN kids k ON k.node = t.node LEFT JOIN ends e ON e.node = t.node
"""
