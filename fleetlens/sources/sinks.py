"""Sinks: evidence documents, cards and the public catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.evidence import (
    api_inventory, env_inventory, important_files, language_counts, structure_counts, summary_lines, table_inventory,
)
from fleetlens.operators.manifests import declared_dependencies, npm_scripts
from fleetlens.operators.fleet import leak_check, private_rollup, public_view
from fleetlens.sources.buckets import BUCKETS, BucketTable


def evidence_records(
    files: DataFrame, signals: DataFrame, manifests: DataFrame, technologies: DataFrame, capability_rows: DataFrame, readmes: DataFrame
) -> DataFrame:
    """(repo, section, name, detail, file, line): the evidence of each repository, one record per item.

    One shape whatever the size of a repository; a document is the records of its repository.
    """
    def section(name: str, df: DataFrame, item: Column, detail: Column, file: Column | None = None, line: Column | None = None) -> DataFrame:
        return df.select(
            "repo", F.lit(name).alias("section"), item.cast("string").alias("name"), detail.cast("string").alias("detail"),
            (F.lit(None) if file is None else file).cast("string").alias("file"), (F.lit(None) if line is None else line).cast("bigint").alias("line"))

    def bar(*columns: Column | str) -> Column:
        named = [F.col(c) if isinstance(c, str) else c for c in columns]
        return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in named])

    file, line, none = F.col("file"), F.col("line"), F.lit(None)
    path = F.col("path")
    parts = [
        section("files", files, F.col("language"), bar("size", "third_party"), path),
        section("structure", structure_counts(files), F.col("root"), F.col("n")),
        section("languages", language_counts(files), F.col("language"), F.col("n")),
        section("important_files", important_files(files), none, F.col("score"), path),
        section("technologies", technologies, F.col("tech"), bar("provenance", "confidence", "n_evidence"), file, line),
        section("dependencies", declared_dependencies(manifests), F.col("name"), bar("kind", "section", "version"), file, line),
        section("scripts", npm_scripts(manifests), F.col("name"), F.col("command"), file, line),
        section("manifests", manifests, F.col("kind"), bar("project_name", F.size("dependencies"), F.size("scripts"), "third_party"), path),
        section("env", env_inventory(signals), F.col("value"), F.col("lang"), file, line),
        section("api", api_inventory(signals), F.concat_ws(" ", "method", "path"), F.col("type"), file, line),
        section("tables", table_inventory(signals), F.col("value"), none, file, line),
        section("capabilities", capability_rows, F.col("category"), bar("confidence", "own_files", "corroborated_by", "keyword"), file, line),
        section("signals", signals, F.col("value"), bar("lang", "kind", "method"), file, line),
        section("readme", summary_lines(readmes), none, F.col("value"), None, F.col("rank")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def evidence_sink(records: DataFrame, path: str) -> None:
    """The records under ``path``, partitioned by section; a rerun replaces what stood there."""
    records.write.mode("overwrite").partitionBy("section").parquet(path)


def evidence_replace(files: DataFrame, records: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS) -> list[int]:
    """The records under ``path`` brought up to ``files``; returns the buckets of repositories that were rewritten.

    ``records`` makes the evidence records of the files it is given: those of changed buckets only.
    """
    return BucketTable(files.sparkSession, path, buckets).replace(files, records, ("section",))


def card_json(cards: DataFrame) -> DataFrame:
    """(repo, private, text): each card as one JSON text."""
    return cards.select("repo", "private", F.to_json(F.struct(*[F.col(c) for c in cards.columns])).alias("text"))


def card_sink(cards: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Cards and their items, then the public catalogue, which is written only when nothing leaks.

    Returns the problems; where there are any, nothing public was written.
    """
    cards.write.mode("overwrite").json(f"{path}/cards")
    items.write.mode("overwrite").partitionBy("field").parquet(f"{path}/items")
    stored = cards.sparkSession.read.schema(cards.schema).json(f"{path}/cards")
    public = public_view(stored)
    problems = leak_check(card_json(public), stored)
    if problems.isEmpty():
        public.write.mode("overwrite").json(f"{path}/public/cards")
        private_rollup(stored).write.mode("overwrite").json(f"{path}/public/private_totals")
    return problems
