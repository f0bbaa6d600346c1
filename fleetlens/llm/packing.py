"""Packing by lexical retrieval.

Documents become ids and are cut into windows. Whole windows are sequences as
they stand. The rest pieces are dealt by range of a minimum hash over their id
pairs, so that copies and near copies meet, and packed in shards of at most
``SHARD`` pieces: a BM25 inverted index over the shard returns, for each seed, the
unused pieces most like it; those that fit fill its window greedily, and the best
one that does not fit is cut to close it. Its remainder stays in the index under the same terms.
What a shard cannot fill goes to the next one, and what a partition cannot fill
leaves as sequences whose lengths are powers of two, so nothing is padded.

Defined cases: null and empty texts are the end id alone; rows without doc_id
are packed too; repeated rows are packed each, in an arbitrary but fixed order;
pieces without common terms follow in the order of the shard; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, landed, shuffle_width, text_rows
from fleetlens.llm.encoding import encoder
from fleetlens.llm.wavelet import _groups

WINDOW, SHARD = 2048, 1024
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, doc_tokens long, ids binary, key long, sequence_id long, whole boolean"
_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("key", pa.int64()), ("sequence_id", pa.int64()), ("whole", pa.bool_()),
])
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def pair_hash(ids: np.ndarray) -> int:
    """Minimum hash over pairs of neighbouring ids (the id itself if it is alone)."""
    a = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (a[:-1] << np.uint64(20) ^ a[1:] if len(a) > 1 else a) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        return int((h * np.uint64(0x94D049BB133111EB)).min() >> np.uint64(1))


class Shard:
    """BM25 inverted index over the pieces of a shard: postings of a term stand together."""

    def __init__(self, pieces: list[np.ndarray]):
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        owner = np.repeat(np.arange(n), lengths)
        terms, counts = np.unique(np.concatenate(pieces).astype(np.int64) * n + owner, return_counts=True)
        self.n, self.docs, term = n, terms % n, terms // n
        kinds, first, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))  # terms in most pieces tell nothing
        dampened = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[self.docs] / lengths.mean()))
        self.weights = np.repeat(idf, df) * dampened
        useful = np.repeat(idf > 0, df)
        # Terms by piece, for queries: where the postings of each useful term begin and end.
        slot = np.repeat(np.arange(len(kinds)), df)[useful]
        order = np.argsort(self.docs[useful], kind="stable")
        self.slots, self.first, self.last = slot[order], first, first + df
        self.bounds = np.searchsorted(self.docs[useful][order], np.arange(n + 1))

    def scores(self, piece: int) -> np.ndarray:
        slots = self.slots[self.bounds[piece] : self.bounds[piece + 1]]
        starts, ends = self.first[slots], self.last[slots]
        sizes = ends - starts
        total = int(sizes.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return np.bincount(self.docs[at], self.weights[at], self.n)


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc_id", "start", "doc_tokens", "ids")

    def __init__(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]), Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:])


def pack_shard(pieces: list[Piece], window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces left over (fewer ids than a window)."""
    index, pieces, full = Shard([p.ids for p in pieces]), list(pieces), []
    sizes = np.array([len(p.ids) for p in pieces])
    unused = np.ones(len(pieces), bool)
    for seed in range(len(pieces)):
        while unused[seed]:  # again if the seed's own remainder is left
            unused[seed] = False
            sequence, space = [pieces[seed]], window - int(sizes[seed])
            ranks = index.scores(seed) if space and unused.any() else None
            while space and unused.any():
                fits = unused & (sizes <= space)
                pool = fits if fits.any() else unused
                best = int(np.where(pool, ranks, -1.0).argmax())
                if sizes[best] <= space:
                    sequence.append(pieces[best])
                    space -= int(sizes[best])
                    unused[best] = False
                else:
                    head, pieces[best] = pieces[best].cut(space)
                    sizes[best] -= space
                    sequence.append(head)
                    space = 0
            if space:
                return full, sequence
            full.append(sequence)
    return full, []


def binary_tail(pieces: list[Piece]) -> list[list[Piece]]:
    """Fewer ids than a window as sequences whose lengths are powers of two, the longest first."""
    left, out = list(pieces), []
    total = sum(len(p.ids) for p in left)
    for bit in range(total.bit_length() - 1, -1, -1):
        space, sequence = (1 << bit) & total, []
        while space:
            p = left.pop(0)
            if len(p.ids) > space:
                p, rest = p.cut(space)
                left.insert(0, rest)
            sequence.append(p)
            space -= len(p.ids)
        if sequence:
            out.append(sequence)
    return out


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, leading: bool = True) -> DataFrame:
    """Every document as whole windows (with a sequence of their own) and one rest piece, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, base = encoder(vocabulary, leading), TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            number = 0
            for group in _groups(text_rows(batches, "doc_id", "text"), 512):
                for (doc_id, _), own in zip(group, tokens.encode([t for _, t in group]), strict=True):
                    ids = np.append(own, own.dtype.type(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        whole = len(part) == window
                        number += whole
                        yield doc_id, at, len(ids), part.tobytes(), 0 if whole else pair_hash(part), (base | number) << 1 | 1 if whole else None, whole

        yield from in_batches(rows(), _PIECE, 4000, lambda r: len(r[3]))

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return landed(docs.mapInArrow(run, PIECE), "pieces", ["whole"])


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, leading: bool = True) -> DataFrame:
    """Pieces of all sequences: doc_id, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id, offset."""
    pieces = cut_documents(docs, vocabulary, end_id, window, leading)
    rest = pieces.where(~F.col("whole")).select("doc_id", "start", "doc_tokens", "ids", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32

        def sequences() -> Iterator[list[Piece]]:
            waiting: list[Piece] = []
            for doc_id, start, doc_tokens, ids in text_rows(batches, "doc_id", "start", "doc_tokens", "ids"):
                waiting.append(Piece(doc_id, start, doc_tokens, np.frombuffer(ids, "<u4")))
                if len(waiting) >= SHARD:
                    full, waiting = pack_shard(waiting, window)
                    yield from full
            if waiting:
                full, waiting = pack_shard(waiting, window)
                yield from full
            yield from binary_tail(waiting)

        def rows() -> Iterator[tuple]:
            for number, sequence in enumerate(sequences()):
                offset = 0
                for p in sequence:
                    yield p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, (base | number) << 1, offset
                    offset += len(p.ids)

        yield from in_batches(rows(), _PACKED, 4000, lambda r: len(r[3]))

    placed = rest.repartitionByRange(shuffle_width(docs.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", "start", "ids")
    packed = placed.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, PACKED)
    whole = pieces.where("whole").select(
        "doc_id", "start", F.lit(window).cast("bigint").alias("length"), "ids", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset")
    )
    return whole.unionByName(packed)
