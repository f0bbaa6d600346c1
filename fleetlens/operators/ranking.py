"""Ranking that survives a hot group.

``top_n`` relies on Spark's window group limit: each map task keeps only its
first n rows per group before the shuffle, so a group with a third of all rows
ships n rows per task. ``ranked`` numbers whole groups without ever holding one
group in one task: rows are range-partitioned by (group, order), numbered inside each
partition, and the counts of earlier partitions are added. The placement is
checkpointed first, so both readers and every retry see the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage


def _order(columns: list[Column | str]) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in columns]


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_n_distinct(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "rank") -> DataFrame:
    """First n distinct rows by ``order`` (which must identify a row) per group."""
    window = Window.partitionBy(*keys).orderBy(*_order(order))
    limited = df.withColumn(rank, F.dense_rank().over(window)).where(F.col(rank) <= n)
    return limited.dropDuplicates([*keys, rank])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in a total order, as a partial aggregate (no window)."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    fields = lead + [c for c in rest if c not in lead]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], rank: str) -> DataFrame:
    """Exact 1-based rank of every row inside its group, skew-safe.

    The order must be total for the numbering to be repeatable. Only one row
    per (partition, group) goes through the small offsets aggregate.
    """
    ordering = [F.col(k).asc() for k in keys] + _order(order)
    placed = cut_lineage(
        df.repartitionByRange(*ordering).withColumn("_part", F.spark_partition_id())
    )
    local = Window.partitionBy("_part", *keys).orderBy(*_order(order))
    numbered = placed.withColumn("_local", F.row_number().over(local))
    counts = numbered.groupBy("_part", *keys).agg(F.max("_local").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = numbered.join(offsets, ["_part", *keys])
    return joined.withColumn(rank, (F.col("_local") + F.col("_offset")).cast("bigint")).drop(
        "_part", "_local", "_offset", "_n"
    )
