"""Trees of files in shared storage: listed by tasks, read in partitions of equal bytes.

``root`` is an absolute path or an address that Arrow's file systems know (``file:``, ``hdfs:``, ``s3:``,
``gs:``); nothing is opened through a mount. Names that start with ``.`` or ``_`` are listed like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.ranking import ranked
from fleetlens.session import cut_lineage

LISTED = "repo string, path string, size bigint"
TRACKED = "repo string, path string, size bigint, bytes binary"
SKIPPED_FOLDERS = (".git",)
PART_BYTES = 128 * 1024 * 1024
READ_CHUNK = 64 * 1024 * 1024
LIST_CHUNK = 10_000
MOST_BYTES = 1024 * 1024 * 1024


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(root)
    return files, base.rstrip("/")


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded length and bytes; the fourth column, if any, holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or b"") if len(row) > 3 else 0
        if len(held) >= LIST_CHUNK or size >= READ_CHUNK:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def repositories(spark: SparkSession, root: str, repo_depth: int = 1, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(repo) of the folders ``repo_depth`` below the root; each level is listed by tasks."""
    found = spark.createDataFrame([("", "", None)], LISTED)
    for _ in range(repo_depth):
        found = _children(found, root, skipped, deep=False).where("size is null").select(
            F.ltrim(F.concat_ws("/", "repo", "path"), F.lit("/")).alias("repo"), F.lit("").alias("path"), "size")
    return found.select("repo")


def _children(folders: DataFrame, root: str, skipped: tuple[str, ...], deep: bool) -> DataFrame:
    """Files below ``folders`` (repo, path): one level with its folders (size null), or all levels without them."""

    def walk(files: fs.FileSystem, base: str, repo: str, path: str) -> Iterator[tuple]:
        above = f"{base}/{repo}".rstrip("/") + "/"
        left = [path]
        while left:
            for info in files.get_file_info(fs.FileSelector((above + left.pop()).rstrip("/"), allow_not_found=True)):
                inner = info.path[len(above):]
                if info.type == fs.FileType.File:
                    yield repo, inner, info.size
                elif info.type == fs.FileType.Directory and info.base_name not in skipped:
                    if deep:
                        left.append(inner)
                    else:
                        yield repo, inner, None

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(root)
        for batch in batches:
            rows = (row for repo, path in zip(batch["repo"], batch["path"]) for row in walk(files, base, repo, path))
            for frame in _framed(rows, ["repo", "path", "size"]):
                yield frame.astype({"size": "Int64"})

    return folders.select("repo", "path").mapInPandas(listed, LISTED)


def list_tree(repos: DataFrame, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS, spread: int = 2) -> DataFrame:
    """(repo, path, size) of all files below the folders ``repo``; a folder that is not there has none.

    The first ``spread`` levels below a repository are listed one by one and their folders dealt to all tasks, so
    a hot repository is listed by many; what lies deeper in a folder is walked by its task. Links are followed as
    the file system follows them.
    """
    tasks = max(1, repos.sparkSession.sparkContext.defaultParallelism)
    folders, found = repos.select("repo", F.lit("").alias("path")), []
    for _ in range(spread):
        level = cut_lineage(_children(folders, root, skipped, deep=False))
        found.append(level.where("size is not null"))
        folders = level.where("size is null").repartition(tasks, "repo", "path")
    return reduce(DataFrame.unionByName, found, _children(folders, root, skipped, deep=True))


def by_bytes(listed: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``listed`` (repo, path, size) in partitions of about ``part_bytes`` of listed files.

    A file of more than ``part_bytes`` has a partition of its own. The number of partitions follows the bytes
    alone; a missing or negative size counts as nothing.
    """
    sized = listed.withColumn("_bytes", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))
    large = F.col("_bytes") > part_bytes
    counts = sized.agg(F.sum(F.when(~large, F.col("_bytes"))).alias("small"), F.count_if(large).alias("large")).first()
    parts = max(1, -(-(counts["small"] or 0) // part_bytes))
    placed = sized.where(~large).withColumn("_id", F.pmod(F.xxhash64("repo", "path"), F.lit(parts)))
    if counts["large"]:
        own = ranked(sized.where(large), [], ["repo", "path"], "_id")
        placed = placed.unionByName(own.withColumn("_id", F.col("_id") + F.lit(parts - 1)))
    return placed.repartitionById(parts + counts["large"], F.col("_id").cast("int")).drop("_bytes", "_id")


def read_listed(listed: DataFrame, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(repo, path, size, bytes) of listed files (repo, path), read where their rows stand.

    A task hands files on in chunks of bounded size. A file that cannot be opened, or of more than ``most_bytes``
    (no row can hold it), keeps its row with null bytes and the size that was found, 0 if none.
    """

    def contents(files: fs.FileSystem, base: str, batch: pd.DataFrame) -> Iterator[tuple]:
        for repo, path in zip(batch["repo"], batch["path"]):
            try:
                with files.open_input_file(f"{base}/{repo}/{path}") as handle:
                    size = handle.size()
                    yield repo, path, size, handle.read() if size <= most_bytes else None
            except OSError:
                yield repo, path, 0, None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(root)
        for batch in batches:
            yield from _framed(contents(files, base, batch), ["repo", "path", "size", "bytes"])

    return listed.select("repo", "path").mapInPandas(read, TRACKED)


def read_files(
    spark: SparkSession, root: str, repo_depth: int = 1, part_bytes: int = PART_BYTES, skipped: tuple[str, ...] = SKIPPED_FOLDERS
) -> DataFrame:
    """Tracked files below ``root``, hidden names included: listed, laid out by their bytes, then read."""
    listed = cut_lineage(list_tree(repositories(spark, root, repo_depth, skipped), root, skipped))
    return read_listed(by_bytes(listed, part_bytes), root)
