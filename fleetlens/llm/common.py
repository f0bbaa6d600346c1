"""Helpers shared by the operators of this package.

Intermediate tables are written once to the shared folder that the session
names and read again, so a lost executor costs a retried task and never a wrong
result. A fixed code point rule defines a word everywhere: ``WORD``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_dir

BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def landed(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to a new shared folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case and words as UTF-8: ``bytes`` methods know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def text_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of small slices, so that long texts never stand beside many others as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*columns_of(batch.slice(at, 512), *names), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, weight: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows or, with ``weight``, about 16 MB."""
    kept: list[tuple] = []
    load = 0
    for row in rows:
        kept.append(row)
        load += weight(row) if weight else 0
        if len(kept) >= size or load >= 16_000_000:
            yield _batch(kept, schema)
            kept, load = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def summed_vectors(parts: DataFrame, fan: int = 256) -> DataFrame:
    """key, vector: sums of ``parts`` (key, part, vector as int64 bytes) in two levels, ``fan`` tasks' vectors at a time."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in rows["vector"])
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "part": [int(rows["part"].iloc[0]) // fan], "vector": [total.tobytes()]})

    schema = "key string, part long, vector binary"
    once = parts.groupBy("key", F.expr(f"part div {fan}").alias("_level")).applyInPandas(add, schema)
    return once.groupBy("key").applyInPandas(add, schema).select("key", "vector")
