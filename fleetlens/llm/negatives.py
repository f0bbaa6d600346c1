"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are ordered by label and, within a label, along a Hilbert curve through the
``AXES`` dimensions of the largest variance, then packed into blocks of ``ROWS`` vectors. A block is one Parquet
row: its vectors, and beside them a zone map (smallest and largest value of every dimension, smallest and
largest label). Interval arithmetic over the zone map bounds the inner products of an
anchor with all rows of a block, and only blocks whose bounds meet a score window of the anchor are read.

A search runs twice over the zone maps: first the most promising block of each chunk of blocks is read,
then all others that may still hold a row among the best k of a window. Positives are one search
with an open window among rows of the anchor's label; negatives one search with a window per positive among the rest.
Where vectors are spread evenly the bounds exclude little and every block is compared in
tiles; the result is exact either way.

Defined cases: rows with a null vec_id, null label, null vector or null or non-finite components take no part; shorter vectors
count as padded with zeros; rows equal in vec_id, label and vector count once; a row with the anchor's
vec_id is never its positive or negative; windows of negative positive scores are empty; ties go to the smaller
vec_id; an empty table gives an empty result. Extra columns are ignored. Products are exact while
they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import landed, shuffle_width
from fleetlens.llm.voronoi import _usable

ROWS, TILE, CHUNK = 1024, 2048, 256  # rows of a block, anchors of a tile, zone maps of a chunk
AXES, BITS = 8, 7
LOWEST, HIGHEST = -(2**63), 2**63 - 1
BLOCK_SCHEMA = "block long, n long, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, size int, q binary"


def scaled(vectors: DataFrame, scale: int, shift_step: int, classes: int) -> DataFrame:
    """vec_id, label, q: whole numbers; rows whose vec_id is divisible by ``shift_step`` get the next label."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    label = F.when(F.col("vec_id") % shift_step == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("x")))
    return known.select("vec_id", label.alias("label"), F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")).alias("q"))


def matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T, in floating point where it holds every sum exactly."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of ``q`` with any vector between ``lo`` and ``hi``."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of whole-number coordinates below 2^bits (rows are points)."""
    x = cells.T.astype(np.int64).copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in x:
            high = axis & bit != 0
            swap = np.where(high, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(high, below, 0)
            x[0] ^= swap
            axis ^= swap
    for before, axis in zip(x, x[1:]):
        axis ^= before
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> level & 1
    return place


def _spread(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of dimensions, their means and deviations: one row of sums per task, one vector back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(0), np.zeros(0)
        for batch in batches:
            lists = batch.column(0).to_pylist()
            x = matrix(lists, max(map(len, lists), default=0)).astype(np.float64)
            short = max(len(total), x.shape[1])
            total, squares = (np.pad(v, (0, short - len(v))) for v in (total, squares))
            total[: x.shape[1]] += x.sum(0)
            squares[: x.shape[1]] += (x**2).sum(0)
            n += len(lists)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([squares.tolist()])], ["n", "total", "squares"])

    parts = rows.select("q").mapInArrow(run, "n long, total array<double>, squares array<double>")
    at = parts.select("n", F.posexplode(F.arrays_zip("total", "squares")).alias("i", "v"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = sorted(at.groupBy("i").agg(F.sum("v.total").alias("t"), F.sum("v.squares").alias("s")).collect())  # one row per dimension
    mean = np.array([r.t / n for r in sums])
    return len(sums), mean, np.sqrt(np.maximum(np.array([r.s / n for r in sums]) - mean**2, 0))


def write_blocks(rows: DataFrame, width: int, mean: np.ndarray, deviation: np.ndarray, size: int = ROWS) -> DataFrame:
    """The candidate blocks, one per row, ordered by label and Hilbert place."""
    axes = np.argsort(-deviation, kind="stable")[:AXES]
    middle, step = mean[axes], np.maximum(deviation[axes], 1e-9) / (1 << BITS - 2)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), width)[:, axes]
            cells = np.clip(np.floor((x - middle) / step) + (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)  # two deviations to either side
            place = hilbert(cells) if len(axes) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["vec_id", "label", "q", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = TaskContext.get().partitionId() << 32, [], None

        def packed(held: list[tuple]) -> pa.RecordBatch:
            ids, labels = (np.array([r[i] for r in held], np.int64) for i in (0, 1))
            q = matrix([r[2] for r in held], width)
            lo, hi = q.min(0), q.max(0)
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= lo.min(initial=0) and hi.max(initial=0) <= np.iinfo(k).max)
            values = [block, len(held), int(labels.min()), int(labels.max()), lo.tobytes(), hi.tobytes(), ids.tobytes(), labels.tobytes(), np.dtype(kind).itemsize, q.astype(kind).tobytes()]
            names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if n == "size" else None) for n, v in zip(names, values, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row == last:  # repeated rows stand side by side
                    continue
                last = row
                held.append(row)
                if len(held) == size:
                    yield packed(held)
                    block, held = block + 1, []
        if held:
            yield packed(held)

    placed = rows.select("vec_id", "label", "q").mapInArrow(along, "vec_id long, label long, q array<long>, place long")
    order = ["label", "place", "vec_id", "q"]
    ordered = placed.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return landed(ordered.mapInArrow(pack, BLOCK_SCHEMA), "blocks")


def _longs(values: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.int64) for v in values])


def choose(anchors: DataFrame, blocks: DataFrame, same: bool, first: bool) -> DataFrame:
    """block, ids, labels, q, his, los: the blocks to read, each with the anchors that read it.

    ``anchors`` are (aid, vec_id, label, q, his, los, kth): score windows, narrowed by the k-th best score known. The
    first round takes the best block of a chunk, the second all others whose bounds meet a window.
    """
    counts = [max(1, -(-anchors.count() // TILE)), max(1, -(-blocks.count() // CHUNK))]
    tile, chunk = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in zip(("aid", "block"), counts, strict=True))
    asked = anchors.select("*", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("chunk"))
    zones = blocks.select("block", "label_lo", "label_hi", "lo", "hi", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))).alias("tile"))

    def pick(asked: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(zones):
            zones = zones.sort_values("block")
            q, his, los, kth, labels = _longs(asked["q"]), _longs(asked["his"]), _longs(asked["los"]), _longs(asked["kth"]), asked["label"].to_numpy()
            low, high = bounds(q, _longs(zones["lo"]), _longs(zones["hi"]))
            a, b = zones["label_lo"].to_numpy()[None, :], zones["label_hi"].to_numpy()[None, :]
            own = labels[:, None]
            fit = (a <= own) & (own <= b) if same else (a != own) | (b != own)

            def meets(floor: np.ndarray) -> np.ndarray:
                found = np.zeros_like(fit)
                for w in range(his.shape[1]):
                    found |= fit & (high >= floor[:, w, None]) & (low <= his[:, w, None]) & (floor <= his)[:, w, None]
                return found

            able = meets(los)
            best = np.where(able, high, LOWEST).argmax(1)
            seed = able & (np.arange(len(zones))[None, :] == best[:, None])
            read = seed if first else meets(np.maximum(los, kth)) & ~seed
            ids, floor = asked["vec_id"].to_numpy(), los if first else np.maximum(los, kth)
            aids = asked["aid"].to_numpy()
            for j, block in enumerate(zones["block"]):
                w = np.flatnonzero(read[:, j])
                if len(w):
                    out.append((block, *(x[w].tobytes() for x in (aids, ids, labels, q, his, floor))))
        return pd.DataFrame(out, columns=["block", "aids", "anchor_ids", "anchor_labels", "anchor_q", "his", "los"])

    return asked.groupBy("tile", "chunk").cogroup(zones.groupBy("tile", "chunk")).applyInPandas(
        pick, "block long, aids binary, anchor_ids binary, anchor_labels binary, anchor_q binary, his binary, los binary"
    )


def read(wanted: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """aid, w (window), vec_id, score: of each block read, the first k rows per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                aids, anchor_ids, anchor_labels, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("aids", "anchor_ids", "anchor_labels", "ids", "labels"))
                q, his, los = (np.frombuffer(r[c], np.int64).reshape(len(aids), -1) for c in ("anchor_q", "his", "los"))
                scores = products(q, np.frombuffer(r["q"], f"<i{r['size']}").reshape(len(ids), -1))
                fit = ((labels[None, :] == anchor_labels[:, None]) == same) & (ids[None, :] != anchor_ids[:, None])
                for w in range(his.shape[1]):
                    row, col = np.nonzero(fit & (scores >= los[:, w, None]) & (scores <= his[:, w, None]))
                    score = scores[row, col]
                    order = np.lexsort((ids[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    take = place < k
                    if take.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(aids[row[take]]), pa.array(np.full(take.sum(), w, np.int32)), pa.array(ids[col[take]]), pa.array(score[take])], ["aid", "w", "vec_id", "score"]
                        )

    both = wanted.join(blocks.select("block", "ids", "labels", "size", "q"), "block")
    return both.mapInArrow(run, "aid long, w int, vec_id long, score long")


def search(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """aid, w, rank, vec_id, score: per window of an anchor (his, los) the first k rows of its own label, or of others."""
    best = Window.partitionBy("aid", "w").orderBy(F.col("score").desc(), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    none = F.col("los")  # no k-th score is known yet
    seeds = landed(top(read(choose(anchors.withColumn("kth", none), blocks, same, True), blocks, same, k)), "seeds")
    known = seeds.where(F.col("rank") == k).groupBy("aid").agg(F.collect_list(F.struct("w", "score")).alias("known"))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = []
            for los, known in zip(batch.column("los").to_pylist(), batch.column("known").to_pylist(), strict=True):
                floor = np.frombuffer(los, np.int64).copy()
                for x in known or ():
                    floor[x["w"]] = max(floor[x["w"]], x["score"])
                kth.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kth, pa.binary())], [*batch.schema.names[:-1], "kth"])

    columns = "aid long, vec_id long, label long, q binary, his binary, los binary"
    again = landed(anchors.join(known, "aid", "left").mapInArrow(narrowed, f"{columns}, kth binary"), "narrowed")
    rest = read(choose(again, blocks, same, False), blocks, same, k)
    return landed(top(seeds.drop("rank").unionByName(rest)), "found")


def mine(
    vectors: DataFrame, k: int = 5, scale: int = 256, anchor_step: int = 100, shift_step: int = 7, classes: int = 10, least: tuple[int, int] = (4, 5), rows_per_block: int = ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``k`` rows of the same label; a positive's negatives the first ``k`` rows of other labels
    that score at most as high and at least ``least`` (a fraction) of it.
    """
    rows = landed(scaled(vectors, scale, shift_step, classes), "vectors")
    width, mean, deviation = _spread(rows)
    width = max(1, width)
    blocks = write_blocks(rows, width, mean, deviation, rows_per_block)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (np.array([v], np.int64).tobytes() for v in (LOWEST, HIGHEST))
        for batch in batches:
            q = [row.tobytes() for row in matrix(batch.column(3).to_pylist(), width)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(q, pa.binary()), pa.array([high] * n, pa.binary()), pa.array([low] * n, pa.binary())], ["aid", "vec_id", "label", "q", "his", "los"])

    columns = "aid long, vec_id long, label long, q binary, his binary, los binary"
    single = landed(rows.where(F.col("vec_id") % anchor_step == 0).distinct(), "anchors").select(F.monotonically_increasing_id().alias("aid"), "vec_id", "label", "q")
    anchors = landed(single.mapInArrow(opened, columns), "opened")
    positives = search(anchors, blocks, k, True).select("aid", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los = [], []
            for known in batch.column("known").to_pylist():
                high = np.full(k, LOWEST, np.int64)  # a window that nothing fits
                low = np.full(k, HIGHEST, np.int64)
                for x in known:
                    high[x["rank"] - 1], low[x["rank"] - 1] = x["positive_score"], -(-x["positive_score"] * least[0] // least[1])
                his.append(high.tobytes())
                los.append(low.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(his, pa.binary()), pa.array(los, pa.binary())], ["aid", "vec_id", "label", "q", "his", "los"])

    ranked = positives.groupBy("aid").agg(F.collect_list(F.struct("rank", "positive_score")).alias("known"))
    windows = landed(anchors.select("aid", "vec_id", "label", "q").join(ranked, "aid").mapInArrow(windowed, columns), "windows")
    negatives = search(windows, blocks, k, False).select(
        "aid", (F.col("w") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = positives.withColumnRenamed("rank", "place").join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return named.join(negatives, ["aid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
