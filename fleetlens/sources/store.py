"""Evidence store: file contents are read once, everything later reads small tables.

At scale the corpus is by far the largest table and its extraction the costly
step. The store keeps the extracted rows as Parquet in shared storage, so
fingerprints, cards, claims and digests neither rescan contents nor depend on
executors that may be lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import paths
from fleetlens.functions.text import fold
from fleetlens.operators.extract import EXTRACTORS, LANGUAGES_OF, signal_items
from fleetlens.operators.manifests import is_manifest, manifest_item
from fleetlens.operators.provenance import capability_items, capability_scope, technology_items
from fleetlens.sources.buckets import BUCKETS, BucketTable
from fleetlens.sources.corpus import spread, task_count

KIND_OF = {
    "py_imports": "import", "py_functions": "function", "py_classes": "class", "py_routes": "route",
    "py_env_vars": "env_var", "js_imports": "import", "js_exports": "export", "js_components": "component",
    "js_api_calls": "api_call", "js_routes": "js_route", "js_env_vars": "env_var", "sql_tables": "table",
}


@dataclass(frozen=True)
class EvidenceStore:
    """One row per file with its evidence in nested columns, partitioned by language; readers prune both."""

    spark: SparkSession
    folder: str
    schema: object

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).where("repo is not null")

    def signals(self, *names: str) -> DataFrame:
        """Stored signals of the chosen extractors; only the folders of their languages are read."""
        rows = self.rows.where("signals is not null")
        if names:
            langs = {EXTRACTORS[n].lang for n in names}
            rows = rows.where(F.col("language").isin(sorted({x for lang in langs for x in LANGUAGES_OF[lang]})))
        found = rows.select("repo", F.col("path").alias("file"), "lang", "third_party", F.explode("signals").alias("s")).select(
            "repo", "file", "lang", "s.kind", "s.value", "s.method", "s.line", "third_party")
        return found.where(F.col("kind").isin(sorted({KIND_OF[n] for n in names}))) if names else found

    def scan(self) -> DataFrame:
        """The scanned files as they were landed, with the ``entry`` flag in place of their contents."""
        return self.rows.select("repo", "path", "name", "ext", "language", "size", "text", "important", "third_party", "entry")

    def manifests(self) -> DataFrame:
        m = F.col("manifest")
        return self.rows.where(m.isNotNull()).select(
            "repo", "path", m["kind"].alias("kind"), "third_party", "depth", m["project_name"].alias("project_name"),
            m["dependencies"].alias("dependencies"), m["scripts"].alias("scripts"))

    def technology_evidence(self) -> DataFrame:
        found = self.rows.select("repo", F.col("path").alias("file"), "depth", "third_party", F.explode("technologies").alias("i"))
        return found.select("repo", "i.tech", "i.rank", "file", "depth", "i.line", "i.detail", "third_party")

    def capability_hits(self) -> DataFrame:
        return self.rows.where("hits is not null").select("repo", F.col("path").alias("file"), "third_party", F.inline("hits"))


PARTS = ("signals", "manifest", "technologies", "hits", "entry")
IMPORTS = ("py_imports", "js_imports")


def serves(held: tuple[str, ...], parts: tuple[str, ...]) -> bool:
    """Whether a store of the parts ``held`` has all that one of ``parts`` has; the signals hold the imports."""
    return set(parts) <= {*held, *(["imports"] if "signals" in held else [])}


def evidence_rows(files: DataFrame, parts: tuple[str, ...] = PARTS, held: str | None = None) -> DataFrame:
    """One row per file with every kind of evidence in nested columns, or the chosen ``parts``: a projection of one scan.

    The part ``imports`` is the column ``signals`` with imports alone, for queries that read no other signal. ``held`` names a column
    with the parts as extracted before, null for a file that is to be read.
    """
    def kept(part: str, made: Column) -> Column:
        return F.when(F.col(held).isNotNull(), F.col(held)[part]).otherwise(made) if held else made

    label = signal_items(tuple(EXTRACTORS))[1]
    path = F.col("path")
    # Signals and manifests are read once; where both are held, the technologies of imports and dependencies follow from them.
    read = files
    if "signals" in parts or "imports" in parts:
        wanted, _, items = signal_items(tuple(EXTRACTORS) if "signals" in parts else IMPORTS)
        parts = ("signals", *parts)
        read = read.withColumn("signals", kept("signals", F.when(wanted & F.col("text"), items)))
    if "manifest" in parts:
        read = read.withColumn("manifest", kept("manifest", F.when(is_manifest(F.col("name"), path), manifest_item())))
    technologies = technology_items(
        dependencies="manifest.dependencies" if "manifest" in parts else None, signals="signals" if "signals" in parts else None)
    made = {
        "signals": F.col("signals"), "manifest": F.col("manifest"), "technologies": kept("technologies", technologies),
        "hits": kept("hits", F.when(capability_scope(), capability_items())),
    }
    entry = kept("entry", F.when(F.col("text"), paths.entry_point(F.col("content")))).alias("entry")
    folded = fold(F.col("content"))
    return read.withColumn("_folded", F.when(F.col(held).isNull(), folded) if held else folded).select(
        "repo", "path", "third_party", paths.depth_of(path).alias("depth"), label.alias("lang"), *[c.alias(p) for p, c in made.items() if p in parts],
        "name", "ext", "size", "text", "important", *([entry] if "entry" in parts else []), *[k for k in KEYS if k in files.columns], "language",
    )


def land(files: DataFrame, folder: str, parts: tuple[str, ...] = PARTS) -> EvidenceStore:
    """Extract every kind of evidence of a corpus, or the chosen ``parts``, into ``folder``: one scan of the contents, one write, by tasks of like work."""
    rows = evidence_rows(spread(files), parts)
    rows.write.mode("overwrite").partitionBy("language").parquet(folder)
    return EvidenceStore(files.sparkSession, folder, rows.schema)


KEYS = ("key0", "key1")


def keyed(files: DataFrame) -> DataFrame:
    """The files with two 64-bit hashes of all their columns, the text included: equal for files that give equal evidence."""
    columns = [F.col(c) for c in sorted(files.columns)]
    return files.withColumns({k: F.xxhash64(F.lit(n), *[c.isNull() for c in columns], *columns) for n, k in enumerate(KEYS)})


def land_again(files: DataFrame, folder: str, earlier: EvidenceStore | None = None) -> EvidenceStore:
    """A whole store of ``files`` with their keys: rows of the ``earlier`` one serve the files it holds unchanged, all others are extracted.

    Files meet their earlier rows by key in one shuffle of each, in as many tasks as their characters take. Equal files have equal rows,
    so of those that come twice in the earlier store one serves. ``earlier`` must be a store that this function landed.
    """
    if earlier is None:
        return land(keyed(files), folder)
    tasks = task_count(files)
    then = earlier.rows.select(*KEYS, F.struct(*PARTS).alias("_held")).repartition(tasks, *KEYS).dropDuplicates([*KEYS])
    rows = evidence_rows(keyed(files).repartition(tasks, *KEYS).join(then, [*KEYS], "left"), held="_held")
    rows.write.mode("overwrite").parquet(folder)
    return EvidenceStore(files.sparkSession, folder, rows.schema)


def land_changed(files: DataFrame, folder: str, buckets: int = BUCKETS) -> tuple[EvidenceStore, list[int]]:
    """The store brought up to ``files``: only buckets of repositories with changed files are extracted and rewritten.

    Returns the store and the rewritten buckets. The partition is the bucket; rows are sorted by language within it,
    so readers skip the row groups of other languages.
    """
    table = BucketTable(files.sparkSession, folder, buckets)
    done = table.replace(files, lambda chosen: evidence_rows(spread(chosen)), ("language",))
    return EvidenceStore(files.sparkSession, f"{folder}/rows", evidence_rows(files).schema), done
