"""Exact top-k by inner product as a Voronoi join.

Pivots divide queries and candidates into cells. The queries of a cell lie in a
ball around its pivot p of radius U, so a candidate c scores between p.c - U|c|
and p.c + U|c| for each of them. The k-th largest lower bound over all
candidates is a threshold for the whole cell, and only candidates whose upper
bound reaches it are replicated to the cell. A cell is solved in tiles of
(chunk of queries, block of candidates) of bounded size; the best k of each tile
are merged by a ranking window. Hot cells therefore become more tiles, not
longer tasks. With vectors spread evenly the bounds exclude little and the join
becomes a blocked comparison of the queries with all rows; the result is exact
either way.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without vec_id; shorter vectors count as padded with
zeros; a query leaves out one row equal to itself in id and vector, so repeated
rows are candidates, and queries equal in id and vector are answered once; ties
go to the smaller vec_id; an empty table gives an empty result. Extra columns are
ignored. Products are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import landed

CHUNK, BLOCK, SLICE = 2000, 20_000, 256


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, q: every component x as floor(scale * x); unusable rows left out."""
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return doubles.where(F.col("vec_id").isNotNull() & _usable(F.col("x"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")).alias("q")
    )


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where they hold every sum exactly."""
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if size < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, query_step: int = 20, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``query_step``."""
    rows = landed(scaled(vectors, scale), "vectors")
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("q"))).first()
    width = max(1, width or 0)
    m = cells or max(1, min(256, n_queries // 500))
    blocks = max(1, -(-n // BLOCK))

    # Pivots: m rows in hash order, a bounded sample that reruns repeat.
    chosen = [r.q for r in rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(m).collect()]
    pivots = _matrix(chosen or [[0]], width).astype(np.float64)
    m = len(pivots)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = x @ pivots.T
        square = (x**2).sum(1)[:, None] - 2 * dots + (pivots**2).sum(1)[None, :]
        cell = square.argmin(1)
        return cell, np.sqrt(np.maximum(square[np.arange(len(x)), cell], 0))

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
        lists = batch.column(1).to_pylist()
        return batch.column(0).to_numpy(), _matrix(lists, width), lists

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, lists = of(batch)
            cell, far = nearest(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists, pa.list_(pa.int64())), pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "q", "cell", "far"])

    queries = landed(rows.where(is_query).distinct().mapInArrow(cell_of, "vec_id long, q array<long>, cell int, far double"), "queries")
    summary = {r.cell: r for r in queries.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # one row per pivot
    radius = np.array([summary[i].far if i in summary else -1.0 for i in range(m)])
    chunks = np.array([-(-summary[i].n // CHUNK) if i in summary else 0 for i in range(m)])
    live = np.flatnonzero(radius >= 0)

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each row's score per live cell, widened by rounding."""
        middle, slack = x @ pivots[live].T, np.sqrt((x**2).sum(1))[:, None] * radius[live][None, :]
        slack = slack + 1e-9 * (np.abs(middle) + slack + 1)
        return middle - slack, middle + slack

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0)] * len(live)
        for batch in batches:
            low = bounds(of(batch)[1].astype(np.float64))[0]
            kept = [np.sort(np.concatenate((a, low[:, j])))[-(k + 1) :] for j, a in enumerate(kept)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(live, [len(a) for a in kept]).astype(np.int32)), pa.array(np.concatenate(kept) if len(live) else np.empty(0))], ["cell", "low"]
        )

    # One of the k + 1 largest bounds may be the query's own row.
    by_low = Window.partitionBy("cell").orderBy(F.col("low").desc())
    lows = rows.mapInArrow(lowest, "cell int, low double").withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k + 1)
    reached = {r.cell: r.t for r in lows.groupBy("cell").agg(F.min("low").alias("t"), F.count("*").alias("n")).where(F.col("n") > k).collect()}
    threshold = np.array([reached.get(int(i), -np.inf) for i in live])

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                needed = bounds(of(part)[1].astype(np.float64))[1] >= threshold[None, :]
                for j, cell in enumerate(live):
                    take = np.flatnonzero(needed[:, j])
                    for chunk in range(chunks[cell]):
                        if len(take):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(take), cell, np.int32)), pa.array(np.full(len(take), chunk, np.int32)), part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)),
                            ], ["cell", "chunk", "vec_id", "q"])

    tile = ["cell", "chunk", "block"]
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    right = rows.mapInArrow(replicated, "cell int, chunk int, vec_id long, q array<long>").select("*", block)
    n_chunks = F.get(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell"))
    left = queries.select(
        "cell", F.pmod(F.xxhash64("vec_id", "q"), n_chunks).cast("int").alias("chunk"), "vec_id", "q",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def solve(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("vec_id", kind="stable")
        ids, c = given["vec_id"].to_numpy(), _matrix(list(given["q"]), width)
        own, q = asked["vec_id"].to_numpy(), _matrix(list(asked["q"]), width)
        out = []
        for at in range(0, len(own) if len(ids) else 0, SLICE):
            scores = _products(q[at : at + SLICE], c)
            for i, row in enumerate(scores):
                same = _equal(ids, c, own[at + i], q[at + i])
                usable = np.delete(np.arange(len(ids)), same)
                mine = row[usable]
                if len(mine) > k:
                    edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                    above, tied = np.flatnonzero(mine > edge), np.flatnonzero(mine == edge)
                    best = np.concatenate((above, tied[: k - len(above)]))  # ids ascend, so ties keep the smaller
                else:
                    best = np.arange(len(mine))
                out.append(pd.DataFrame({"query_id": own[at + i], "query_hash": asked["h"].to_numpy()[at + i], "vec_id": ids[usable[best]], "score": mine[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_hash": [], "vec_id": [], "score": []}).astype("int64")

    solved = (
        left.withColumn("h", F.xxhash64("q")).groupBy(*tile).cogroup(right.groupBy(*tile))
        .applyInPandas(solve, "query_id long, query_hash long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _equal(ids: np.ndarray, c: np.ndarray, own: int, q: np.ndarray) -> list[int]:
    """The place of one row equal to the query in id and vector."""
    for j in range(int(np.searchsorted(ids, own, "left")), int(np.searchsorted(ids, own, "right"))):
        if (c[j] == q).all():
            return [j]
    return []


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
) WHERE rank <= 20
"""
