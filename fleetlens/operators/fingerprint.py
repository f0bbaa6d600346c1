"""Fingerprint of what describes the software; dates, lines and mentions stay out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.operators.evidence import api_inventory, env_inventory, important_files, table_inventory
from fleetlens.operators.manifests import declared_dependencies, npm_scripts
from fleetlens.operators.provenance import RANK, conclusive_only


def fingerprint_parts(
    files: DataFrame, signals: DataFrame, manifests: DataFrame, technologies: DataFrame
) -> DataFrame:
    """(repo, part, entry, n): the multiset behind each fingerprint, one row per distinct entry.

    Every repository has at least one row, with a null part when nothing was found.
    """
    def part(df: DataFrame, name: str, entry: Column) -> DataFrame:
        return df.select("repo", F.lit(name).alias("part"), entry.alias("entry"))

    version = F.coalesce(F.col("version"), F.lit(""))
    parts = [
        part(api_inventory(signals), "api", F.concat_ws(" ", "method", "path")),
        part(declared_dependencies(manifests), "dependencies",
             F.concat(F.col("file"), F.lit("::"), F.col("name"), F.lit("@"), version)),
        part(env_inventory(signals), "env", F.col("value")),
        part(important_files(files), "important_files", F.col("path")),
        part(npm_scripts(manifests), "scripts", F.concat(F.col("name"), F.lit("="), F.col("command"))),
        part(table_inventory(signals), "tables", F.col("value")),
        part(conclusive_only(technologies), "technologies", F.concat_ws(":", "tech", "provenance")),
    ]
    entries = reduce(lambda a, b: a.unionByName(b), parts)
    counted = entries.groupBy("repo", "part", "entry").agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("string")
    every = files.select("repo").distinct().select("repo", null.alias("part"), null.alias("entry"), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(every)


def fingerprint(parts: DataFrame) -> DataFrame:
    """(repo, sha, buckets): one rule for every size.

    An entry is a line ``part:entry*n``. Lines fall into 65,536 buckets by the first four hex
    digits of their md5; each bucket that is not empty has the sha256 of its ordered lines, and the
    fingerprint is the sha256 of the ordered bucket digests. At most that many digests meet per repository.
    """
    line = F.concat(F.col("part"), F.lit(":"), F.col("entry"), F.lit("*"), F.col("n").cast("string"))
    placed = parts.select("repo", line.alias("line")).withColumn("bucket", F.substring(F.md5("line"), 1, 4))
    ordered = F.array_join(F.array_sort(F.collect_list("line")), "\n")  # null lines, of repositories without entries, are skipped
    digests = placed.groupBy("repo", "bucket").agg(F.sha2(ordered, 256).alias("sha"))
    pair = F.when(F.col("bucket").isNotNull(), F.concat(F.col("bucket"), F.col("sha")))
    joined = F.array_join(F.array_sort(F.collect_list(pair)), "")
    return digests.groupBy("repo").agg(F.sha2(joined, 256).alias("sha"), F.count("bucket").alias("buckets"))


# --- prints that add up -------------------------------------------------------

LANES = ("lane0", "lane1", "lane2", "lane3")
LANE_DIGITS = 15  # hex digits of a sha256 per lane: a whole number of 60 bits


def file_parts(files: DataFrame, signals: DataFrame, manifests: DataFrame, items: DataFrame) -> DataFrame:
    """(repo, path, part, entry): what each file by itself adds to the print of its repository.

    The parts are those of :func:`fingerprint_parts`. Where these look over the files of a repository, here each file
    speaks for itself: a variable counts once per file, a technology (``items``: technology evidence)
    once per file and conclusive provenance. Every file has a row with a null part.
    """
    def part(df: DataFrame, name: str, entry: Column, path: str = "file") -> DataFrame:
        return df.select("repo", F.col(path).alias("path"), F.lit(name).alias("part"), entry.alias("entry"))

    null = F.lit(None).cast("string")
    conclusive = {RANK[p]: p for p in dims.CONCLUSIVE_PROVENANCE}
    provenance = reduce(lambda c, r: c.when(F.col("rank") == r, conclusive[r]), conclusive, F)
    parts = [
        part(api_inventory(signals), "api", F.concat_ws(" ", "method", "path")),
        part(declared_dependencies(manifests), "dependencies", F.concat(F.col("file"), F.lit("::"), F.col("name"), F.lit("@"), F.coalesce("version", F.lit("")))),
        part(signals.where(F.col("kind") == "env_var").select("repo", "file", "value").distinct(), "env", F.col("value")),
        part(important_files(files), "important_files", F.col("path"), "path"),
        part(npm_scripts(manifests), "scripts", F.concat(F.col("name"), F.lit("="), F.col("command"))),
        part(table_inventory(signals), "tables", F.col("value")),
        part(items.where(F.col("rank").isin(*conclusive)).select("repo", "file", "tech", "rank").distinct(), "technologies", F.concat_ws(":", F.col("tech"), provenance)),
        files.select("repo", "path", null.alias("part"), null.alias("entry")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def file_prints(parts: DataFrame) -> DataFrame:
    """(repo, path, entries, lane0..lane3): the multiset of a file's lines ``part:entry`` as sums of hashes.

    Four lanes of 60 bits, whole numbers without a modulus: prints add and subtract exactly, in any order. Repeated
    lines count as often as they occur; rows with a null part or entry add nothing but keep their file.
    """
    digest = F.sha2(F.concat(F.col("part"), F.lit(":"), F.col("entry")), 256)
    lanes = [F.conv(F.substring("digest", n * LANE_DIGITS + 1, LANE_DIGITS), 16, 10).cast("decimal(20,0)") for n in range(len(LANES))]
    hashed = parts.select("repo", "path", digest.alias("digest"))
    return _added(hashed.select("repo", "path", F.col("digest").isNotNull().cast("bigint").alias("entries"), *[v.alias(n) for v, n in zip(lanes, LANES)]), "repo", "path")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.coalesce(F.sum(F.col(n).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(n) for n in LANES]
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("entries"), F.lit(0)).cast("bigint").alias("entries"), *sums)


def repo_prints(prints: DataFrame) -> DataFrame:
    """(repo, files, entries, lane0..lane3): the prints of a repository's files, added up in partial aggregates."""
    return _counted(prints.withColumn("files", F.lit(1).cast("bigint")))


def _counted(rows: DataFrame) -> DataFrame:
    whole = ["files", "entries"]
    return rows.groupBy("repo").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in whole], *[F.sum(n).cast("decimal(38,0)").alias(n) for n in LANES])


def updated_prints(held: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``held`` repository prints brought up to date from the changed files alone.

    ``before`` and ``after`` are prints of the changed files as they were and as they are: a new file stands in
    ``after`` only, a removed one in ``before`` only. Repositories without files left go.
    """
    gone = before.select("repo", F.lit(-1).cast("bigint").alias("files"), *[(-F.col(c)).alias(c) for c in ("entries", *LANES)])
    come = after.withColumn("files", F.lit(1).cast("bigint")).drop("path")
    return _counted(held.unionByName(gone).unionByName(come)).where("files <> 0")


def print_sha(prints: DataFrame) -> DataFrame:
    """(repo, files, entries, sha): the lanes sealed as one sha256, fit for :func:`contract.change_gate`."""
    sealed = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("entries", *LANES)]), 256)
    return prints.select("repo", "files", "entries", sealed.alias("sha"))
