"""Token ids stored as one wavelet matrix per shard file.

A shard is a run of whole documents in ascending doc_id order. Its ids are held
as bit-planes, the highest bit first; after each plane the ids are split stably
into those with a 0 and those with a 1. With a table of ones before every block
of each plane, access, counting and the place of an occurrence need one rank or
select per plane and no decoding. Each shard is one row of one Parquet table,
written by Spark's own committer, so a retried task never leaves half a file.

Defined cases: a null or empty text is the end id alone; rows without doc_id
come first; repeated rows are stored as often as they occur, ordered by text; an
empty table gives an empty folder of shards. A document is never cut between shards;
a shard closes once it holds ``shard_tokens`` ids. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, landed, shuffle_width, text_rows
from fleetlens.llm.encoding import encoder

SHARD_TOKENS = 1 << 18
BLOCK_BITS = 512  # a multiple of 8; one count of ones is kept per block and plane
SHARD_SCHEMA = "part int, before long, n_tokens long, n_bits int, doc_ids array<long>, lengths array<int>, planes binary, ranks binary, zeros array<long>"
_SHARD = pa.schema([
    ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("n_bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("planes", pa.binary()), ("ranks", pa.binary()), ("zeros", pa.list_(pa.int64())),
])


class WaveletMatrix:
    """Rank, select and access over the bit-planes of one shard."""

    def __init__(self, n: int, n_bits: int, planes: bytes, ranks: bytes, zeros: list[int]):
        self.n, self.n_bits, self.zeros = n, n_bits, zeros
        self.planes = np.frombuffer(planes, np.uint8).reshape(n_bits, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(n_bits, -1)

    @classmethod
    def build(cls, ids: np.ndarray, n_bits: int) -> WaveletMatrix:
        rows, counts, zeros, now = [], [], [], ids
        for shift in range(n_bits - 1, -1, -1):
            bits = (now >> shift) & 1
            ones = bits.astype(bool)
            packed = np.packbits(ones)
            rows.append(np.pad(packed, (0, -len(packed) % (BLOCK_BITS // 8))))
            blocks = np.bitwise_count(rows[-1]).reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.uint32)
            counts.append(np.concatenate(([0], np.cumsum(blocks))).astype("<u4"))
            now = np.concatenate((now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))))
            zeros.append(int(len(ids) - counts[-1][-1]))
        return cls(len(ids), n_bits, np.concatenate(rows).tobytes(), np.concatenate(counts).tobytes(), zeros)

    def ones(self, level: int, end: int) -> int:
        """How many of the first ``end`` bits of a plane are 1."""
        block = end // BLOCK_BITS
        from_byte, to_byte = block * (BLOCK_BITS // 8), end // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][from_byte:to_byte]).sum())
        return count + (int(self.planes[level][to_byte]) >> (8 - end % 8)).bit_count() if end % 8 else count

    def bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.n_bits):
            bit, ones = self.bit(level, at), self.ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _span(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` among the first ``end`` ids stand below the last plane."""
        start = 0
        for level in range(self.n_bits):
            first, last = self.ones(level, start), self.ones(level, end)
            if symbol >> (self.n_bits - 1 - level) & 1:
                start, end = self.zeros[level] + first, self.zeros[level] + last
            else:
                start, end = start - first, end - last
        return start, end

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of ``symbol`` among the first ``end`` ids."""
        if symbol >> self.n_bits:
            return 0
        start, stop = self._span(symbol, min(max(end, 0), self.n))
        return stop - start

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence of ``symbol``, k from 0; -1 if there are fewer."""
        if symbol >> self.n_bits:
            return -1
        start, stop = self._span(symbol, self.n)
        if not 0 <= k < stop - start:
            return -1
        at = start + k
        for level in range(self.n_bits - 1, -1, -1):
            bit = symbol >> (self.n_bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - (self.zeros[level] if bit else 0))
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th 1 (or 0) of a plane: the block by bisection, then the bit in it."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK_BITS // 8) : (block + 1) * (BLOCK_BITS // 8)])
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids: from the last plane upwards, undo each stable split."""
        kind = np.uint16 if self.n_bits <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for level in range(self.n_bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = below[: self.zeros[level]]
            above[np.flatnonzero(ones)] = below[self.zeros[level] :] | kind(1 << (self.n_bits - 1 - level))
            below = above
        return below


def write_shards(
    docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_bits: int = 16, leading: bool = False
) -> DataFrame:
    """The shard table of ``docs`` (doc_id, text): encoded, range-partitioned by doc_id, one row per shard.

    ``part`` and ``before`` (ids of earlier shards of the part) give the ascending order. The texts are shuffled once; ids are made after it.
    """
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), encoder(vocabulary, leading)

        def shards() -> Iterator[tuple]:
            ids, doc_ids, load, before = [], [], 0, 0
            for rows in _groups(text_rows(batches, "doc_id", "text"), 512):
                for (doc_id, _), own in zip(rows, tokens.encode([t for _, t in rows]), strict=True):
                    ids.append(np.append(own, np.asarray([end_id], own.dtype)))
                    doc_ids.append(doc_id)
                    load += len(ids[-1])
                    if load >= shard_tokens:
                        yield pack(before, ids, doc_ids, load)
                        ids, doc_ids, load, before = [], [], 0, before + load
            if doc_ids:
                yield pack(before, ids, doc_ids, load)

        def pack(before: int, ids: list[np.ndarray], doc_ids: list[int], load: int) -> tuple:
            m = WaveletMatrix.build(np.concatenate(ids), id_bits)
            return part, before, load, id_bits, doc_ids, [len(x) for x in ids], m.planes.tobytes(), m.ranks.tobytes(), m.zeros

        yield from in_batches(shards(), _SHARD, 1)

    placed = docs.select("doc_id", "text").repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return landed(placed.mapInArrow(build, SHARD_SCHEMA), "wavelet")


def _groups(rows: Iterator[tuple], size: int, chars: int = 4_000_000) -> Iterator[list[tuple]]:
    kept, load = [], 0
    for row in rows:
        kept.append(row)
        load += len(row[-1] or "")
        if len(kept) >= size or load >= chars:
            yield kept
            kept, load = [], 0
    if kept:
        yield kept


def shard_of(row) -> WaveletMatrix:
    """The wavelet matrix of one row of a shard table."""
    return WaveletMatrix(row["n_tokens"], row["n_bits"], row["planes"], row["ranks"], row["zeros"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of a shard table, in order: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits).

    Offsets come from the shards' counts alone: one sum per range partition, of which there are as many as
    shuffle partitions, so they are broadcast; the planes are not shuffled.
    """
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = shards.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("_before"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    ids = shard_of(row).decode().astype("<u4")
                    at = 0
                    for doc_id, n in zip(row["doc_ids"], row["lengths"], strict=True):
                        yield doc_id, row["start"] + at, n, ids[at : at + n].tobytes()
                        at += n

        yield from in_batches(rows(), out, 2000, lambda r: len(r[3]))

    columns = ["start", "n_tokens", "n_bits", "doc_ids", "lengths", "planes", "ranks", "zeros"]
    return placed.select(*columns).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def tokens_per_document(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """The digest of the round trip: write the shards, read them back."""
    return read_shards(write_shards(docs, vocabulary, end_id)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
