"""Tables replaced by bucket of repositories: a run rewrites only what its input changed.

A repository belongs to a fixed bucket of its name, the partition of the table. Beside the rows stands a
manifest with one line per bucket: the digest of the files that the rows were made from. A run compares
digests, builds the rows of the differing buckets from their files alone and overwrites those partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
DIGEST = ("files", "lane0", "lane1")
MANIFEST = "files bigint, lane0 decimal(38,0), lane1 decimal(38,0), bucket int"


def bucket_of(repo: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(buckets)).cast("int")


def input_digests(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, files, lane0, lane1) of (repo, path, sha256 or content): sums of hashes, whatever the order.

    One partial aggregate; with a stored ``sha256`` the contents are not read. A null content differs from an empty one.
    """
    text = F.col("sha256" if "sha256" in files.columns else "content")
    held = [F.col("repo"), F.col("path"), text.isNull(), text]
    lanes = [F.sum(F.xxhash64(F.lit(k), *held).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane{k}") for k in (0, 1)]
    return files.groupBy(bucket_of(F.col("repo"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("files"), *lanes)


@dataclass(frozen=True)
class BucketTable:
    """Rows under ``folder/rows`` and their manifest under ``folder/manifest``, both by bucket, in shared storage.

    The number of buckets belongs to the table and must not change over its life.
    """

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def manifest(self) -> DataFrame:
        """The digests the rows were made from; a bucket whose writing was broken off has null ones."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)  # no run has been here yet

    def pending(self, digests: DataFrame) -> DataFrame:
        """Manifest lines of the buckets that are new, changed, gone or were left half-written."""
        now = digests.select("bucket", F.struct(*DIGEST).alias("now"))
        then = self.manifest().select("bucket", F.struct(*DIGEST).alias("then"))
        none = F.struct(F.lit(0).cast("bigint").alias("files"), *[F.lit(0).cast("decimal(38,0)").alias(c) for c in DIGEST[1:]])
        both = now.join(then, "bucket", "full").withColumn("now", F.coalesce("now", none))
        return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("now.*", "bucket")

    def _overwrite(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def replace(self, files: DataFrame, build: Callable[[DataFrame], DataFrame], order: tuple[str, ...] = ()) -> list[int]:
        """Bring the table up to ``files``; returns the buckets that were rewritten.

        ``build`` makes rows (with ``repo``) from the files of the chosen buckets. It must treat each repository
        by itself. Each rewritten bucket also gets a row without a repository, so that one that has no rows any more
        is overwritten like the rest. Buckets are marked open before their rows are touched: a run that breaks off is made
        good by the next, whatever its input. ``order`` sorts the rows of a file, so that readers skip row groups.
        """
        lines = self.pending(input_digests(files, self.buckets)).collect()  # at most one per bucket
        todo = sorted(line["bucket"] for line in lines)
        if not todo:
            return todo
        chosen = bucket_of(F.col("repo"), self.buckets)
        rows = build(files.where(chosen.isin(todo)))
        ends = self.spark.createDataFrame([(n,) for n in todo], "bucket int")
        ends = ends.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields], "bucket")
        laid = rows.withColumn("bucket", chosen).unionByName(ends).hint("rebalance", F.col("bucket"))
        self._overwrite(self.spark.createDataFrame([(None, None, None, n) for n in todo], MANIFEST), "manifest")
        self._overwrite(laid.sortWithinPartitions("bucket", *order), "rows")
        self._overwrite(self.spark.createDataFrame(lines, MANIFEST), "manifest")
        return todo

    def read(self, schema) -> DataFrame:
        """The rows of all repositories, without the bucket."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/rows").where("repo is not null").drop("bucket")
