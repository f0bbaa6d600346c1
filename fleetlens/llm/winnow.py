"""Document fingerprints by winnowing.

Hashes of all k-grams of code points; of each window of w consecutive hashes the
smallest is taken, the rightmost where several are equal; hash and place are
kept. Any passage of at least w + k - 1 code points that two texts share gives
them a common hash, whose places tell where it stands.

Defined cases: null texts are empty and have no hashes; a text of fewer than k
code points has the one hash of the whole; fewer grams than a window give one
minimum; two fingerprints without hashes are alike (1). Rows are ordered by
doc_id (none first), then text; each of several equal rows is followed by the
next of them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, shuffle_width, text_rows

GRAM, WINDOW = 11, 40  # a common passage of 50 code points is always seen
BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 20  # windows worked on at once, which bounds memory for long texts


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hash of every k-gram: polynomials of doubled length are joined, then mixed."""
    done, factor, length = None, 1, 0  # hashes of `length` codes so far, and BASE ** length
    step, power, width = codes.astype(np.uint64), np.uint64(BASE), 1
    left = k
    while left:
        if left & 1:
            if done is None:
                done, length = step, width
            else:
                n = len(codes) - length - width + 1
                done, length = done[:n] * power + step[length : length + n], length + width
        left >>= 1
        if left:
            n = len(codes) - 2 * width + 1
            step, power, width = step[:n] * power + step[width : width + n], power * power, 2 * width
    mixed = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(32)


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling; two spans that overlap cover any width."""
    span = 1
    while span * 2 <= w:
        keys, span = np.minimum(keys[:-span], keys[span:]), span * 2
    return np.minimum(keys[: len(keys) - (w - span)], keys[w - span :]) if w > span else keys


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) in ascending order of place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    w = min(w, grams)
    found = []
    with np.errstate(over="ignore"):
        for at in range(0, grams - w + 1, STRETCH):
            part = codes[at : at + STRETCH + w + k - 2]
            hashes = _gram_hashes(part, k)
            # The place counts down in the low bits: of equal hashes the rightmost is the smallest key.
            keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(at, at + len(hashes), dtype=np.uint64))
            minima = _window_minima(keys, w)
            found.append(minima[np.concatenate(([True], minima[1:] != minima[:-1]))])
    keys = np.concatenate(found) if len(found) > 1 else found[0]
    if len(found) > 1:
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: set[int], b: set[int]) -> float:
    """Share of common hashes among all."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes, places for every row."""
    out = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, *(x.astype(np.int64) for x in winnow(t or "", k, w))) for d, t in text_rows(batches, "doc_id", "text"))
        yield from in_batches(rows, out, 2000, lambda r: 16 * len(r[1]))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, places array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, extra) dealt so that each partition is a run of the global order.

    The last row of a run needs the first of the next run, so the first row of each run goes
    to the run before as well, marked ``extra``; behind the last run stands the first.
    """
    spark = docs.sparkSession
    n = shuffle_width(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("b")).first().b if n > 1 else None
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        places = np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy(), side="left")
        return pd.Series(places.astype(np.int32))

    def run_column() -> Column:
        return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(run_of("doc_id")).cast("int")

    # One smallest id per run: as many rows as partitions.
    ids = docs.select("doc_id")
    firsts = {r.run: r.first for r in ids.select("doc_id", run_column().alias("run")).groupBy("run").agg(F.min("doc_id").alias("first")).collect()}
    if ids.where(F.col("doc_id").isNull()).limit(1).count():
        firsts[0] = None
    runs = sorted(firsts)
    before = {run: runs[i - 1] for i, run in enumerate(runs)}
    given = [i for i in firsts.values() if i is not None]
    heads = docs.where(F.col("doc_id").isin(given) | (F.col("doc_id").isNull() if None in firsts.values() else F.lit(False)))
    heads = heads.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("t"))
    targets = spark.createDataFrame([(firsts[r], before[r]) for r in runs] or [], "id bigint, run int")
    extra = heads.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", F.col("t.text").alias("text"), "run", F.lit(1).alias("extra"))
    placed = docs.select("doc_id", "text", run_column().alias("run"), F.lit(0).alias("extra")).unionByName(extra)
    return placed.repartitionById(n, F.col("run")).sortWithinPartitions("extra", "doc_id", "text").select("doc_id", "text", "extra")


def compare_edited(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each text against itself with its last quarter overwritten by the next document's start, and against the next document."""
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_hashes", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = None
            for doc_id, text, extra in text_rows(batches, "doc_id", "text", "extra"):
                text = text or ""
                hashes = winnow(text, k, w)[0]
                now = (doc_id, text, hashes, set(hashes.tolist()))
                if held:
                    yield compared(held, now)
                held = now

        def compared(own: tuple, follower: tuple) -> tuple:
            doc_id, text, hashes, known = own
            n = len(text)
            edited = text[: n - n // 4] + follower[1][: n // 4]
            new = winnow(edited, k, w)[0]
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, n, sha, written(hashes), written(new), likeness(known, set(new.tolist())), likeness(known, follower[3]), len(hashes)

        yield from in_batches(rows(), out, 2000, lambda r: len(r[3]) + len(r[4]))

    return with_next(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long"
    )
