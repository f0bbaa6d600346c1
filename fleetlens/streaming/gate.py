"""Streaming: evidence of arriving files, and changes of a repository's fingerprint."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.operators.extract import EXTRACTORS, signal_items
from fleetlens.operators.pii import pii_scan
from fleetlens.sources.corpus import analysis_scope, scan_corpus

CORPUS_SCHEMA = "repo string, path string, size bigint, content string"


def changes(arrivals: DataFrame, previous: DataFrame | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Rows (repo, sha, seq) whose sha differs from the one seen just before.

    ``seq`` is a struct (ts, tie) that totally orders the arrivals of one
    repository; ``previous`` (repo, sha) is the last value of earlier batches. A
    hot repository is cut into time buckets: each bucket compares inside itself,
    and only its first row looks at the last value of the bucket before.
    """
    bucket = F.floor(F.unix_micros("seq.ts") / F.lit(bucket_seconds * 1_000_000))
    placed = arrivals.select("repo", "sha", "seq", bucket.alias("bucket"))
    inside = Window.partitionBy("repo", "bucket").orderBy("seq")
    local = placed.withColumn("before", F.lag("sha").over(inside)).withColumn("k", F.row_number().over(inside))
    lasts = placed.groupBy("repo", "bucket").agg(F.max_by("sha", "seq").alias("last"))
    if previous is not None:
        earliest = F.lit(-(2**62)).cast("bigint")
        lasts = lasts.unionByName(previous.select("repo", earliest.alias("bucket"), F.col("sha").alias("last")))
    upto = Window.partitionBy("repo").orderBy("bucket")
    carried = lasts.withColumn("carried", F.lag("last").over(upto)).select("repo", "bucket", "carried")
    joined = local.join(carried, ["repo", "bucket"])
    seen = F.when(F.col("k") == 1, F.col("carried")).otherwise(F.col("before"))
    return joined.where(seen.isNull() | (seen != F.col("sha"))).select("repo", "sha", "seq")


CHANGES = "repo string, sha string, ts timestamp, tie bigint"
PLACED = "repo string, sha string, micros bigint, tie bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_PLACE = -(2**63)  # a missing time or tie comes first
FAN_IN = 64
MERGE_ROWS = 5_000


def _spilled(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted run written to a nameless file, which ends with the task; its frames on demand."""
    file, writer = tempfile.TemporaryFile(), None
    for frame in frames:
        table = pa.Table.from_pandas(frame, preserve_index=False)
        writer = writer or pa.ipc.new_stream(file, table.schema)
        writer.write_table(table, max_chunksize=MERGE_ROWS)
    writer.close()
    file.seek(0)
    with file:
        yield from (batch.to_pandas() for batch in pa.ipc.open_stream(file))


def _written(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The run of ``frames``, written now and read later."""
    run = _spilled(frames)
    return itertools.chain([next(run)], run)


def _sorted(frames: list[pd.DataFrame]) -> pd.DataFrame:
    frame = frames[0] if len(frames) == 1 else pd.concat(frames)
    return frame if len(frame) == 1 else frame.take(np.lexsort((frame["tie"].to_numpy(), frame["micros"].to_numpy())))


def _places(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["micros"].to_numpy(), frame["tie"].to_numpy()


def _upto(places: tuple[np.ndarray, np.ndarray], bound: tuple[int, int]) -> int:
    """How many leading rows of a sorted frame stand at ``bound`` or before."""
    micros, tie = places
    low, high = np.searchsorted(micros, bound[0], "left"), np.searchsorted(micros, bound[0], "right")
    return int(low + np.searchsorted(tie[low:high], bound[1], "right"))


def _merged(runs: list[Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """Sorted runs as one; a step passes on all rows up to the smallest last place of the frames at hand."""
    heads = [[next(run), 0, run] for run in runs]  # frame, rows passed on, the rest of the run
    places = [_places(head[0]) for head in heads]
    while heads:
        bound = min((micros[-1], tie[-1]) for micros, tie in places)
        ready = []
        for n, (frame, passed, run) in enumerate(heads):
            upto = _upto(places[n], bound)
            if upto > passed:
                ready.append(frame.iloc[passed:upto])
            heads[n][1] = upto
            if upto == len(frame):
                heads[n][:2] = next(run, None), 0
                places[n] = None if heads[n][0] is None else _places(heads[n][0])
        heads = [head for head in heads if head[0] is not None]
        places = [place for place in places if place is not None]
        yield _sorted(ready)


def in_order(frames: Iterable[pd.DataFrame], held_rows: int) -> Iterator[pd.DataFrame]:
    """``frames`` sorted by (micros, tie) with about ``held_rows`` rows in memory: an external merge sort by levels."""
    levels: list[list[Iterator[pd.DataFrame]]] = [[]]
    held: list[pd.DataFrame] = []

    def spill() -> None:
        levels[0].append(_written([_sorted(held)]))
        held.clear()
        for depth, level in enumerate(levels):
            if len(level) == FAN_IN:
                if depth + 1 == len(levels):
                    levels.append([])
                levels[depth + 1].append(_written(_merged(level)))
                level.clear()

    count = 0
    for frame in frames:
        held.append(frame)
        count += len(frame)
        if count >= held_rows:
            spill()
            count = 0
    runs = [run for level in reversed(levels) for run in level]
    if held and not runs:
        yield _sorted(held)
    else:
        yield from _merged(runs + ([iter([_sorted(held)])] if held else []))


def _changed(held_rows: int):
    def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The arrivals of one repository whose sha differs from the one before; the state is the last sha."""
        last = state.get[0] if state.exists else None
        for frame in in_order(frames, held_rows):
            shas = frame["sha"].to_numpy()
            differs = np.append(last is None or shas[0] != last, shas[1:] != shas[:-1])
            last = shas[-1]
            yield frame[differs]
        state.update((last,))

    return changed


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; others keep the session's provider."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_change_gate(
    arrivals: DataFrame, output: str, checkpoint: str, held_rows: int = 200_000, **trigger
) -> StreamingQuery:
    """Emit a repository only when its fingerprint differs from the last one seen.

    ``arrivals`` streams (repo, sha, seq); arrivals without a sha say nothing, a missing part of seq comes first.
    The state store (RocksDB, off the heap) holds one value per repository, so a batch costs what it brings and the
    state grows with the repositories only. A task takes arrivals one Arrow batch at a time and holds ``held_rows``
    of them; more go to sorted runs on its disk, so a hot repository never stands in one frame. ``output`` must be
    in shared storage.
    """
    spark = arrivals.sparkSession
    missing = F.lit(NO_PLACE).cast("bigint")
    placed = arrivals.where("sha is not null").select(
        "repo", "sha", F.coalesce(F.unix_micros("seq.ts"), missing).alias("micros"),
        F.coalesce(F.col("seq.tie").cast("bigint"), missing).alias("tie"))
    gated = placed.groupBy("repo").applyInPandasWithState(
        _changed(held_rows), PLACED, "sha string", "append", GroupStateTimeout.NoTimeout)
    found = gated.select(
        "repo", "sha", F.timestamp_micros(F.nullif("micros", missing)).alias("ts"), F.nullif("tie", missing).alias("tie"))
    with _rocksdb(spark):
        return (
            found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        )


def read_changes(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(output)


def stream_corpus(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Corpus files as they arrive, with a fixed schema."""
    return spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def _once(rows: DataFrame, keys: list[str], remember: str) -> DataFrame:
    """Rows whose keys were not seen in the time ``remember`` before; the time is that of arrival."""
    timed = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def stream_evidence(
    corpus: DataFrame, output: str, checkpoint: str, kind: str = "signals", remember: str = "7 days", **trigger
) -> StreamingQuery:
    """Arriving files through the extractors (``signals``) or the PII scan (``pii``).

    A file that arrives again with a content it had within the time ``remember`` is reported once, a changed one
    again. The state holds repository, path and sha256 of files that had something to report, and the watermark
    drops them after that time. A file's evidence is one nested row until then, so its contents are not shuffled.
    """
    files = scan_corpus(corpus)
    if kind == "signals":
        wanted, label, items = signal_items(tuple(EXTRACTORS))
        rows = analysis_scope(files).where(wanted).select(
            "repo", F.col("path").alias("file"), label.alias("lang"), "third_party", items.alias("items"),
            F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
        fresh = _once(rows.where(F.size("items") > 0), ["repo", "file", "sha256"], remember)
        found = fresh.select("repo", "file", "lang", "third_party", F.explode("items").alias("s")).select(
            "repo", "file", "lang", "s.kind", "s.value", "s.method", "s.line", "third_party")
    else:
        found = _once(pii_scan(files), ["repo", "path", "sha256"], remember)
    return (
        found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def sequence(ts: Column, tie: Column) -> Column:
    return F.struct(ts.alias("ts"), tie.alias("tie"))
