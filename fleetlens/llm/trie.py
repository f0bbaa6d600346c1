"""Prefix trie of conversations, folded by time-forward processing.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128-bit
hashes of (place, turn), so keys of all prefixes are running sums. The smallest member of a node
owns it; what a conversation owns is one unbroken piece of its path, so every node is
owned once. A shard takes the paths of some owners, with the ancestors they do not own as empty
nodes, and visits nodes by reverse level order: totals of a subtree travel as messages to the
parent through a priority queue in the same order, which writes sorted runs to a spill file when it
grows. Nodes that stand in several shards, the roots of their pieces, are then added across shards.

Hot groups: a popular turn or copied conversation is one node with partial counts, its children
belong to the shards of their owners; conversations longer than ``BLOCK`` turns are cut into blocks,
and totals of lower blocks are added at the end of the block above. Members that end at
a node are hashed in sorted chunks, one after the other.

Turns are ordered by (turn, role, text), nulls of turn first. Defined cases: null role or text is
empty; rows without conv_id take no part; repeated rows are turns of their own; an empty table gives no
node. Spill files belong to a task, are nameless and end with it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, in_batches, landed, shuffle_width, text_or_empty

BLOCK = 65_536  # turns of one conversation that stay together
MEMORY = 200_000  # messages of a queue held in memory
CHUNK = 4_000  # member ids hashed at once
NODE = ["depth", "k1", "k2"]


def placed(turns: DataFrame) -> DataFrame:
    """part, conv_id, place (from 1 in the part), f1, f2 (hashes of the turn), words: rows in order of turn."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    slim = ordered.select(
        "conv_id", F.xxhash64("role", "text").alias("f1"), F.xxhash64("text", F.lit(1), "role").alias("f2"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            run = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]).astype(np.int64))))
            place = np.arange(len(ids)) - starts[run] + 1
            if last == ids[0]:
                place[run == 0] += done
            last, done = ids[-1], place[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), batch.column(0), pa.array(place), *batch.columns[1:]], ["part", "conv_id", "place", "f1", "f2", "words"])

    return slim.mapInArrow(number, "part long, conv_id long, place long, f1 long, f2 long, words long")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, total, f1, f2, words) and conversations (conv_id, total) after sharing first turns.

    A conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``group`` and its own after its first h.
    """
    rows = landed(placed(turns), "turns")
    own, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    spans = landed(spans.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(own).alias("length")), "spans")
    lengths = spans.where("offset = 0").select("conv_id", "length")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    named = lengths.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), shared.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    lent = F.least("h", F.coalesce("base_length", F.lit(0)))
    convs = named.join(bases, "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.lit(0), F.col("length") - F.col("h"))).alias("total"))
    convs = landed(convs, "conversations")

    known = spans.join(convs, "conv_id").select("conv_id", "part", "offset", "h", "lent", "total")
    rank = F.col("place") + F.col("offset")
    kept = rows.join(known, ["conv_id", "part"]).where(rank > F.col("h")).select("conv_id", (rank - F.col("h") + F.col("lent")).alias("depth"), "total", "f1", "f2", "words")
    first = rows.where(F.col("place") < most).join(spans, ["conv_id", "part"]).where(rank < most)
    first = first.select(F.col("conv_id").alias("base"), rank.alias("depth"), "f1", "f2", "words")
    given = convs.where("lent > 0").select("conv_id", "base", "lent", "total").join(first, "base").where("depth <= lent")
    return kept.unionByName(given.select("conv_id", "depth", "total", "f1", "f2", "words")), convs.select("conv_id", "total")


def paths(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, total, k1, k2 (key of the prefix), p1, p2 (of the parent), words; the root at depth 0."""
    cut = F.floor(F.col("depth") / block).cast("bigint")
    salted = turns.select("conv_id", "depth", "total", cut.alias("block"), F.xxhash64("depth", "f1", "f2").alias("a"), F.xxhash64("f2", "depth", "f1").alias("b"), "words")
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = landed(salted.select("*", F.bit_xor("a").over(running).alias("x"), F.bit_xor("b").over(running).alias("y")), "prefixes")
    # Only conversations with several blocks carry anything over.
    above = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.where(F.col("total") >= block).groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = sums.select("conv_id", "block", F.coalesce(F.bit_xor("a").over(above), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("b").over(above), F.lit(0)).alias("cb"))
    lower = local.where("block > 0").join(carried, ["conv_id", "block"])
    every = local.where("block = 0").select("*", F.lit(0).cast("bigint").alias("ca"), F.lit(0).cast("bigint").alias("cb")).unionByName(lower)
    k1, k2 = F.col("x").bitwiseXOR(F.col("ca")), F.col("y").bitwiseXOR(F.col("cb"))
    found = every.select("conv_id", "depth", "total", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("a")).alias("p1"), k2.bitwiseXOR(F.col("b")).alias("p2"), "words")
    zero = F.lit(0).cast("bigint")
    return found.unionByName(convs.select("conv_id", zero.alias("depth"), "total", *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words")]))


class SpillingQueue:
    """Smallest message first; beyond ``memory`` messages the heap becomes a sorted run in a nameless file."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.heap, self.runs, self.written = memory, [], [], 0

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.memory:
            file = tempfile.TemporaryFile()
            np.array(sorted(self.heap), np.int64).tofile(file)
            file.seek(0)
            self.heap, self.written = [], self.written + 1
            self._refill(file, self.written, len(message))

    def _refill(self, file, number: int, width: int) -> None:
        read = np.fromfile(file, np.int64, 4096 * width).reshape(-1, width).tolist()[::-1]
        if read:
            heapq.heappush(self.runs, (read.pop(), number, read, file))
        else:
            file.close()

    def peek(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or tuple(self.runs[0][0]) < self.heap[0]):
            return tuple(self.runs[0][0])
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or tuple(self.runs[0][0]) < self.heap[0]):
            head, number, rest, file = heapq.heappop(self.runs)
            if rest:
                heapq.heappush(self.runs, (rest.pop(), number, rest, file))
            else:
                self._refill(file, number, len(head))
            return tuple(head)
        return heapq.heappop(self.heap)


def time_forward(rows: Iterator[tuple[int, ...]], block: int = BLOCK, memory: int = MEMORY) -> Iterator[tuple[int, ...]]:
    """(depth, k1, k2, children, leaves, saved) of a shard's nodes.

    ``rows`` are (depth, k1, k2, p1, p2, owned, leaves, saved) by falling depth, then key; equal nodes are added. A block's
    first nodes pass no totals on, since these already stand at the end of the block above.
    """
    queue = SpillingQueue(memory)

    def earlier(than: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
        """Messages to nodes of other shards."""
        while (m := queue.peek()) is not None and (than is None or m[:3] < than):
            queue.pop()
            yield -m[0], m[1], m[2], m[3], m[4], m[5]

    node, held = None, None

    def closed() -> Iterator[tuple[int, ...]]:
        yield from earlier(node)
        children, leaves, saved = 0, held[3], held[4]
        while (m := queue.peek()) is not None and m[:3] == node:
            queue.pop()
            children, leaves, saved = children + m[3], leaves + m[4], saved + m[5]
        depth = -node[0]
        yield depth, node[1], node[2], children, leaves, saved
        if depth:
            passed = depth % block > 0
            queue.push((1 - depth, held[0], held[1], held[2], leaves if passed else 0, saved if passed else 0))

    for depth, k1, k2, p1, p2, owned, leaves, saved in rows:
        if node != (-depth, k1, k2):
            if node:
                yield from closed()
            node, held = (-depth, k1, k2), [p1, p2, 0, 0, 0]
        held[2], held[3], held[4] = held[2] + owned, held[3] + leaves, held[4] + saved
    if node:
        yield from closed()
    yield from earlier(None)


def subtree_totals(nodes: DataFrame, path: DataFrame, block: int = BLOCK, memory: int = MEMORY) -> DataFrame:
    """depth, k1, k2, n_children, n_leaves, saved_tokens of every node."""
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    zero = F.lit(0).cast("bigint")
    mine = nodes.select(
        "conv_id", *NODE, "p1", "p2", F.lit(1).cast("bigint").alias("owned"), F.col("childless").cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    empty = path.join(owners, "conv_id").where("depth < top").select("conv_id", *NODE, "p1", "p2", *[zero.alias(c) for c in ("owned", "leaves", "saved")])
    cut = F.floor(F.col("depth") / block).cast("bigint")
    rows = mine.unionByName(empty).withColumn("block", cut)
    # The last node of a block takes the totals of the blocks below: few rows, and none for conversations of one block.
    below = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, 0)
    lower = rows.where(F.col("depth") >= block).groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    lower = lower.select("conv_id", (F.col("block") - 1).alias("block"), F.sum("l").over(below).alias("l"), F.sum("s").over(below).alias("s"))
    ends = F.col("depth") % block == block - 1
    carried = rows.where(ends).join(lower, ["conv_id", "block"], "left").withColumns(
        {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
    )
    rows = rows.where(~ends).unionByName(carried.drop("l", "s"))
    out = pa.schema([(c, pa.int64()) for c in (*NODE, "n_children", "n_leaves", "saved_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from in_batches(time_forward(given, block, memory), out, 20_000)

    shards = rows.repartition(shuffle_width(nodes.sparkSession), "conv_id", "block").select(*NODE, "p1", "p2", "owned", "leaves", "saved")
    parts = shards.sortWithinPartitions(F.col("depth").desc(), "k1", "k2").mapInArrow(run, ", ".join(f"{f.name} long" for f in out))
    return parts.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in out.names[3:]])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the ascending conv_ids in ``ends`` (depth, k1, k2, conv_id)."""
    pieces = pa.schema([*[(c, pa.int64()) for c in NODE], ("first", pa.int64()), ("ids", pa.binary())])
    digest = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, held = None, []
            for batch in batches:
                for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (key != node or len(held) >= CHUNK):
                        yield *node, held[0], ",".join(map(str, held)).encode()
                        held = []
                    node = key
                    held.append(conv)
            if held:
                yield *node, held[0], ",".join(map(str, held)).encode()

        yield from in_batches(rows(), pieces, 5000, lambda r: len(r[4]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, state = None, None
            for batch in batches:
                for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key == node:
                        state.update(b"," + ids)
                        continue
                    if node:
                        yield *node, state.hexdigest()
                    node, state = key, hashlib.sha256(ids)
            if node:
                yield *node, state.hexdigest()

        yield from in_batches(rows(), digest, 5000)

    width = shuffle_width(ends.sparkSession)
    key = ", ".join(f"{c} long" for c in NODE)
    cut = ends.select(*NODE, "conv_id").repartitionByRange(width, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, f"{key}, first long, ids binary")
    return cut.repartition(width, *NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(hashed, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, memory: int = MEMORY) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    shared, convs = rebuilt(turns)
    path = landed(paths(shared, convs, block), "paths")
    found = path.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"),
        (F.max("total") == F.col("depth")).alias("childless"),
    )
    nodes = landed(found, "nodes")
    totals = subtree_totals(nodes, path, block, memory)
    digests = end_digests(path.where("depth = total"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    full = nodes.join(totals, NODE).join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


# The CRC-32 polynomial, bits reversed, is a fixed value.
ORACLE = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), hashed AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)::UBIGINT[]),
      lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)), 4294967295::UBIGINT)::BIGINT % 4 AS h FROM ids
), turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), together AS (
  SELECT h.c, 0 AS own, t.r, t.role, t.text FROM hashed h JOIN turns t ON t.c = h.base AND t.r <= h.h
  UNION ALL SELECT h.c, 1, t.r, t.role, t.text FROM hashed h JOIN turns t ON t.c = h.c AND t.r > h.h
), numbered AS (
  SELECT c, row_number() OVER w AS d, md5(concat(length(role), ':', role, text)) AS f, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM together WINDOW w AS (PARTITION BY c ORDER BY own, r)
), path AS (
  SELECT c, d, md5(string_agg(f, ',') OVER (PARTITION BY c ORDER BY d)) AS k, words FROM numbered UNION ALL SELECT c, 0, '', 0 FROM ids
), linked AS (
  SELECT c, d, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS parent, words, d = max(d) OVER (PARTITION BY c) AS ends FROM path
), nodes AS (
  SELECT d, k, min(parent) AS parent, min(c) AS c, count(*) AS n, min(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends) AS members FROM linked GROUP BY d, k
), children AS (
  SELECT d - 1 AS d, parent AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS (
  SELECT n.*, coalesce(x.n, 0) AS n_children, (x.n IS NULL)::INTEGER AS leaf, (n.n - 1) * n.words AS saved FROM nodes n LEFT JOIN children x USING (d, k)
), totals AS (
  SELECT a.d, a.k, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved FROM valued v JOIN linked a ON a.c = v.c AND a.d <= v.d GROUP BY a.d, a.k
)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, p.c AS parent_conv_id, v.n::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved::BIGINT AS saved_tokens, sha256(coalesce(v.members, '')) AS ends_sha256
FROM valued v JOIN totals t USING (d, k) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.parent AND v.d > 0
"""
