"""Corpus sources: one row per file, any number of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.sources import tree

INVENTORY = ("path", "name", "ext", "language", "size", "text", "important", "third_party")


def decode_text(raw: Column) -> Column:
    """UTF-8 text: invalid bytes dropped, CRLF and lone CR become LF.

    Invalid sequences become U+FFFD first and are then removed, so a genuine
    U+FFFD in the source is lost too.
    """
    valid = F.make_valid_utf8(raw.cast("string"))
    return F.regexp_replace(F.replace(valid, F.lit("�"), F.lit("")), r"\r\n?", "\n")


def read_tree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Tracked files below ``root``: (repo, path, size, bytes).

    The first ``repo_depth`` folders below the root name the repository. Meant
    for landing a tree once; write the result as a corpus table for queries.
    Spark's file listing leaves out names that start with ``.`` or ``_``: where
    those matter (``.gitignore``, ``__init__.py``), use :func:`read_paths` or
    :func:`fleetlens.sources.tree.read_files`.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.col("path")
    relative = F.substr(full, F.position(F.lit(base), full) + len(base))
    parts = F.split(relative, "/")
    return raw.select(
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.size(parts)), "/").alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("bytes"),
    )


def read_paths(tracked_paths: DataFrame, root: str) -> DataFrame:
    """(repo, path, size, bytes) of listed files (repo, path[, size]) in shared storage.

    For the list a version control index gives, hidden names included. With a ``size``
    column the files are laid out by their bytes first; a file that cannot be opened
    keeps its row with null bytes (see :mod:`fleetlens.sources.tree`).
    """
    return tree.read_listed(tree.by_bytes(tracked_paths) if "size" in tracked_paths.columns else tracked_paths, root)


def read_content(tracked: DataFrame) -> DataFrame:
    """Replace the ``bytes`` column by decoded ``content`` and the ``sha256`` of the raw bytes."""
    kept = [c for c in tracked.columns if c not in ("bytes", "sha256")]
    return tracked.select(*kept, decode_text(F.col("bytes")).alias("content"), F.sha2("bytes", 256).alias("sha256"))


def file_sha256(files: DataFrame, column: str = "bytes") -> DataFrame:
    return files.select("repo", "path", F.sha2(F.col(column).cast("binary"), 256).alias("sha256"))


def scan_corpus(
    tracked: DataFrame,
    ignore_paths: Column | None = None,
    ignored_files: tuple[str, ...] = dims.IGNORED_FILES,
) -> DataFrame:
    """Inventory of a corpus table (repo, path, size[, content]).

    Only projections and filters on ``path``: the scan of a columnar corpus
    never touches ``content`` unless the caller selects it. A corpus landed with
    ``name``, ``ext`` and ``language`` (a partition column, see :func:`land_corpus`)
    keeps them, so a filter on the language skips whole folders. A fleet that keeps
    its own settings file in the repositories adds its name to ``ignored_files``.
    """
    path = F.col("path")
    stored = {"name": paths.name_of(path), "ext": F.lower(paths.suffix_of(path))}
    stored = {c: F.col(c) if c in tracked.columns else v for c, v in stored.items()}
    name, ext = stored["name"], stored["ext"]
    language = F.col("language") if "language" in tracked.columns else paths.language_of(ext)
    rest = [c for c in tracked.columns if c not in ("repo", "path", "size", "name", "ext", "language")]
    kept = tracked.where(
        ~paths.in_ignored_folder(path)
        & ~name.isin(*ignored_files)
        & ~paths.path_excluded(path, ignore_paths)
    )
    return kept.select(
        "repo",
        "path",
        name.alias("name"),
        ext.alias("ext"),
        language.alias("language"),
        "size",
        paths.is_text_file(ext, name).alias("text"),
        name.isin(*dims.IMPORTANT_FILES).alias("important"),
        paths.path_third_party(path).alias("third_party"),
        *rest,
    )


FILE_RECORDS = 16_384  # of a stored file


def land_corpus(tracked: DataFrame, folder: str, records_per_file: int = FILE_RECORDS) -> None:
    """Write a corpus table (repo, path, size, content) with ``name`` and ``ext``, partitioned by language.

    The layout follows the bytes: a rebalance by language joins small partitions and splits large ones at
    the session's advisory size, so a language with most of the bytes gets as many tasks and files as it fills,
    and a rare one a single file. ``records_per_file`` bounds files further: repetitive texts shrink to little on disk, and
    a reader's task takes so many files as their stored bytes and opening costs allow, whatever the texts come to.
    """
    path = F.col("path")
    ext = F.lower(paths.suffix_of(path))
    named = tracked.select("repo", "path", "size", "content", paths.name_of(path).alias("name"), ext.alias("ext"), paths.language_of(ext).alias("language"))
    named.hint("rebalance", F.col("language")).write.partitionBy("language").option("maxRecordsPerFile", records_per_file).parquet(folder)


SPREAD_CHARS = 8 << 20  # of a task that extracts evidence
ROW_CHARS = 256  # what a file costs besides its text


def _weight() -> Column:
    return F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)) + ROW_CHARS


def task_count(files: DataFrame, chars: int = SPREAD_CHARS) -> int:
    """The tasks that hold about ``chars`` characters of text each; one small aggregate reads no text."""
    return (files.agg(F.sum(_weight())).first()[0] or 0) // chars + 1


def spread(files: DataFrame, chars: int = SPREAD_CHARS) -> DataFrame:
    """The files dealt to tasks of about ``chars`` characters of text each, a language in as few tasks as that takes.

    Repetitive texts shrink to little on disk, so splits by stored bytes would leave a large corpus to a handful of
    tasks. The languages stand one after the other on a line as long as all ``size``; a file's place in its language is a hash of its
    path, and a task is a stretch of that line. One small aggregate reads no text.
    """
    sums = files.groupBy("language").agg(F.sum(_weight()).alias("weight")).collect()  # one row per language
    at, stretch = 0, F.lit(0.0)
    place = F.pmod(F.xxhash64("repo", "path"), F.lit(1 << 30)) / (1 << 30)
    for row in sorted(sums, key=lambda r: r["language"] or ""):
        stretch = F.when(F.col("language").eqNullSafe(row["language"]), F.lit(float(at)) + place * row["weight"]).otherwise(stretch)
        at += row["weight"]
    return files.repartitionById(at // chars + 1, F.floor(stretch / chars).cast("int"))


def analysis_scope(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text files; with ``max_bytes`` only those small enough for a caller's detector."""
    text = files.where("text")
    return text if max_bytes is None else text.where(F.col("size") <= max_bytes)


def active_repo(repos: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    alive = ~F.col("archived") & ~F.col("disabled") & ~F.col("fork")
    return repos.where(alive & ~F.col("name").isin(*excluded) if excluded else alive)


def size_gate(repos: DataFrame, max_kb: int = dims.MAX_CENSUS_KB) -> DataFrame:
    """Adds ``omitted_reason``: null for the census, a reason otherwise; no row is lost."""
    megabytes = F.bround(F.col("size") / 1024).cast("bigint").cast("string")
    reason = F.concat(
        F.lit("over_limit:"), megabytes,
        F.lit(f" of {max_kb / 1024:.0f} MB"),
    )
    return repos.withColumn("omitted_reason", F.when(F.col("size") > max_kb, reason))


def collect_incremental(repos: DataFrame, evidence: DataFrame) -> DataFrame:
    """Repositories without stored evidence."""
    return repos.join(evidence.select(F.col("repo").alias("name")), "name", "left_anti")
