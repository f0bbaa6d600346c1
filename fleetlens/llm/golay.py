"""SimHash near-dedup with Golay-code fuzzy hashing.

Each fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The
binary Golay code [23, 12, 7] is perfect: every 23-bit word lies within distance
3 of exactly one codeword. A word gets that codeword as a key and, if it is at
distance 3, also the five codewords at distance 4; two words that differ in at most two bits
then share a key. Four differing bits fall on three segments such that, for the
two least hit segments, either one is untouched and the other has at most two
errors, or both have one and the third at most two. So a pair shares

- an exact segment and a Golay key of another one, or
- Golay keys of all three segments.

Equal fingerprints are one node. Nodes that share a key are compared exactly,
and only a spanning forest of the true links of each key leaves the task, never
its pairs. Components come from alternating star contraction.

Defined cases: null texts are empty; texts without a word have fingerprint zero
and link like any other; rows without doc_id take part, and a group's id is its smallest doc_id that is not
null; repeated rows fall together; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import landed, shuffle_width, text_or_empty, text_rows, words_of

SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
DISTANCE = 4
VOTES = 32_768  # hashes whose bits are counted at once


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if it is 1 in over half of the shingles' XXH64 (seed 42), repeats included."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, VOTES):
        hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : at + VOTES], last[at : at + VOTES])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@lru_cache(1)
def codewords() -> np.ndarray:
    """The 4096 codewords: messages times the generator polynomial."""
    message = np.arange(4096, dtype=np.uint32)
    out = np.zeros(4096, np.uint32)
    for bit in range(12):
        out ^= np.where(message >> bit & 1, np.uint32(GENERATOR << bit), 0).astype(np.uint32)
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; by syndrome, how many codewords are near and their offsets from the word."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([syndrome(1 << b) for b in range(23)], np.uint32)
    leaders: dict[int, list[int]] = {}
    four: dict[int, list[int]] = {}
    bits = range(23)
    patterns = [0, *[1 << a for a in bits], *[1 << a | 1 << b for a in bits for b in range(a)]]
    patterns += [1 << a | 1 << b | 1 << c for a in bits for b in range(a) for c in range(b)]
    for p in patterns:
        leaders.setdefault(syndrome(p), []).append(p)
    for p in (1 << a | 1 << b | 1 << c | 1 << d for a in bits for b in range(a) for c in range(b) for d in range(c)):
        four.setdefault(syndrome(p), []).append(p)
    offsets, counts = np.zeros((2048, 6), np.uint32), np.ones(2048, np.int64)
    for s, (leader,) in leaders.items():
        near = [leader] + (four[s] if leader.bit_count() == 3 else [])
        offsets[s, : len(near)], counts[s] = near, len(near)
    return single, counts, offsets


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per 23-bit word up to 6 codewords near it, and how many."""
    single, counts, offsets = _tables()
    s = np.zeros(len(words), np.uint32)
    for bit in range(23):
        s ^= np.where(words >> np.uint32(bit) & np.uint32(1), single[bit], np.uint32(0)).astype(np.uint32)
    return words[:, None] ^ offsets[s], counts[s]


def _message(codeword: np.ndarray) -> np.ndarray:
    """12 bits that identify a codeword: its upper ones."""
    return (codeword >> np.uint32(11)).astype(np.uint64)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of the fingerprints; a key's top bits name its kind."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    near = [golay_keys(p) for p in parts]
    rows, keys = [], []
    slot = np.arange(6)
    for i in range(3):
        for j in range(3):
            if i != j:
                words, count = near[j]
                r, c = np.nonzero(slot[None, :] < count[:, None])
                rows.append(r)
                keys.append(np.uint64(i * 3 + j) << np.uint64(40) | parts[i][r].astype(np.uint64) << np.uint64(12) | _message(words[r, c]))
    a, b, c = (slot[None, :] < n[:, None] for _, n in near)
    r, x, y, z = np.nonzero(a[:, :, None, None] & b[:, None, :, None] & c[:, None, None, :])
    m = [_message(w) for w, _ in near]
    rows.append(r)
    keys.append(np.uint64(15) << np.uint64(40) | m[0][r, x] << np.uint64(24) | m[1][r, y] << np.uint64(12) | m[2][r, z])
    return np.concatenate(rows), np.concatenate(keys)


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among one key's fingerprints: breadth first, one row of comparisons per node."""
    edges, left = [], np.arange(len(prints))
    while len(left):
        reach, left = [left[0]], left[1:]
        while reach and len(left):
            node = reach.pop()
            linked = np.bitwise_count(prints[left] ^ prints[node]) <= distance
            if linked.any():
                hit = left[linked]
                edges += [(int(prints[node]), int(prints[x])) for x in hit]
                reach += hit.tolist()
                left = left[~linked]
    return edges


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash, print of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width) for (t,) in text_rows(iter([batch]), "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], schema=out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, print long")


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) over distinct ``print`` values that connect all that are linked."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                prints = batch.column(0).slice(at, 1000).to_numpy().view(np.uint64)
                rows, keys = keys_of(prints)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[rows].view(np.int64))], ["key", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key that runs over the end of a batch is kept for the next."""
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges_of(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
            ends = np.append(starts[1:], len(keys))
            found = [e for a, b in zip(starts, ends) if b - a > 1 for e in forest(prints[a:b].view(np.uint64), distance)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_keys, batch.column(0).to_numpy()))
            prints = np.concatenate((held, batch.column(1).to_numpy()))
            cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            yield edges_of(keys[:cut], prints[:cut])
            held_keys, held = keys[cut:], prints[cut:]
        yield edges_of(held_keys, held)

    # The aggregate before may have left few partitions; a row makes about 170 keys.
    keyed = nodes.select("print").repartition(shuffle_width(nodes.sparkSession), "print").mapInArrow(emit, "key long, print long")
    placed = keyed.repartition(shuffle_width(nodes.sparkSession), "key").sortWithinPartitions("key", "print")
    return placed.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it reaches.

    Large-star and small-star steps alternate until an iteration changes nothing; each
    uses a minimum per node, which aggregates before the shuffle, and a join.
    """
    pairs = landed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = landed(small.where("u <> v").distinct(), "stars")
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        state = seen
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, print (long), root (a fingerprint its group shares), component_id."""
    if distance > DISTANCE:
        raise ValueError("the keys cover at most four differing bits")
    prints = landed(fingerprints(docs, width), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes, distance))
    labelled = landed(nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root")), "labels")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "root").select("print", "root", "component_id")
    return prints.join(named, "print").select("doc_id", "text_hash", "print", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, print (long), component_id."""
    return grouped(docs, width, distance).select("doc_id", "print", "component_id")


def survivors(docs: DataFrame, width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """One row of every group of ``docs``, as it is: the first by doc_id (none last), then text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    first = grouped(docs, width, distance).groupBy("root").agg(F.min(order).alias("row")).select("row.*")
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_hash": F.xxhash64(text_or_empty())}
    left = docs.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in key.items()])
    return left.join(first, [*key], "left_semi").dropDuplicates([*key]).select("_row.*")
