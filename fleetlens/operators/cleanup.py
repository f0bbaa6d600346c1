"""Deletion candidates: deterministic proposals with evidence; nothing is decided here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.functions.text import rx
from fleetlens.operators.ranking import ranked
from fleetlens.session import cut_lineage
from fleetlens.sources.mentions import UNITS, MentionIndex, unit_of

STEM_WITH_SUFFIX = rx(rf"\A(.+?){dims.VARIANT_SUFFIX}\z")


def is_artefact(path: Column) -> Column:
    return path.rlike(rx(dims.GENERATOR_ARTEFACT, "i"))


def is_build_residue(path: Column) -> Column:
    return path.rlike(rx(dims.BUILD_RESIDUE, "i"))


def variant_of(files: DataFrame) -> DataFrame:
    """(repo, path, size, base): stems with a copy suffix whose base file exists.

    Equi self join on (repo, base path); only suffixed rows travel on the left
    and only paths on the right.
    """
    path = F.col("path")
    stem = paths.stem_of(path)
    base = F.concat(paths.folder_of(path), F.regexp_extract(stem, STEM_WITH_SUFFIX, 1), paths.suffix_of(path))
    suffixed = files.where(stem.rlike(STEM_WITH_SUFFIX)).select(
        "repo", "path", "size", base.alias("base"))
    existing = files.select("repo", F.col("path").alias("base"))
    return suffixed.join(existing, ["repo", "base"], "left_semi").select("repo", "path", "size", "base")


def imported_modules(signals: DataFrame) -> DataFrame:
    """Distinct (repo, stem): last path segment of every import, up to its first dot."""
    stem = F.substring_index(F.substring_index(F.col("value"), "/", -1), ".", 1)
    imports = signals.where(F.col("kind") == "import")
    return imports.select("repo", stem.alias("stem")).distinct()


def orphan_by_import(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Files whose stem is no imported module's last segment."""
    with_stem = files.withColumn("stem", paths.stem_of(F.col("path")))
    return with_stem.join(imported_modules(signals), ["repo", "stem"], "left_anti")


def mention_vocabulary(files: DataFrame, units: list[str]) -> DataFrame:
    """Distinct text units per repository with the range of stems that contain them.

    (repo, unit, value, low_stem, high_stem). Searching the distinct units is
    searching the files; ``low`` and ``high`` tell whether a file with another
    stem holds the unit. Equal units fold map-side.
    """
    def cut(unit: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(UNITS[unit]), F.lit(0)))
        if unit != "word":
            found = F.filter(found, lambda v: v.rlike(r"\W"))
        return F.transform(found, lambda v: F.struct(F.lit(unit).alias("unit"), v.alias("value")))

    arrays = [cut(unit) for unit in units]
    readable = files.where("text")
    exploded = readable.select(
        "repo", paths.stem_of(F.col("path")).alias("stem"),
        F.inline(F.concat(*arrays) if len(arrays) > 1 else arrays[0]),
    )
    return exploded.groupBy("repo", "unit", "value").agg(
        F.min("stem").alias("low_stem"), F.max("stem").alias("high_stem")
    )


SLICE, SALTS = 256, 16


def orphan_by_mention(suspects: DataFrame, files: DataFrame) -> DataFrame:
    """Suspects (repo, stem, ...) whose stem occurs in no file with another stem.

    Substring semantics without a nested loop: windows of the lengths that suspects have are cut from
    the distinct units, and the test is an equi join on (repo, window). A unit is first cut into slices that
    overlap by a window, so no row holds more than ``SLICE`` windows however long a unit is; windows
    that are no suspect's stem go in a semi join before anything is aggregated. The lengths of a
    repository are repeated under ``SALTS`` salts, so a hot one spreads. Suspects are checkpointed: they are read three times.
    """
    suspects = cut_lineage(suspects)
    tagged = suspects.select("repo", unit_of(F.col("stem")).alias("unit"), F.length("stem").alias("n"))
    # At most one row per kind of unit reaches the driver.
    present = {row["unit"] for row in tagged.select("unit").distinct().collect()}
    if not present:
        return suspects
    lengths = tagged.where("n > 0").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    value, n = F.col("value"), F.col("n")
    slices = (
        mention_vocabulary(files, [u for u in UNITS if u in present])
        .withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
        .join(lengths, ["repo", "unit", "salt"]).where(F.length(value) >= n)
        .select("repo", "low_stem", "high_stem", "n", value, F.explode(F.sequence(F.lit(1), F.length(value) - n + 1, F.lit(SLICE))).alias("at"))
        .select("repo", "low_stem", "high_stem", "n", F.substr(value, F.col("at"), n + (SLICE - 1)).alias("piece"))
    )
    places = F.sequence(F.lit(1), F.length("piece") - n + 1)
    windows = slices.select("repo", "low_stem", "high_stem", F.explode(F.array_distinct(
        F.transform(places, lambda i: F.substr(F.col("piece"), i, n)))).alias("stem"))
    mentioned = (
        windows.join(suspects.select("repo", "stem").distinct(), ["repo", "stem"], "left_semi")
        .groupBy("repo", "stem")
        .agg(F.min("low_stem").alias("low_stem"), F.max("high_stem").alias("high_stem"))
        .where((F.col("low_stem") != F.col("stem")) | (F.col("high_stem") != F.col("stem")))
    )
    return suspects.join(mentioned, ["repo", "stem"], "left_anti")


def orphan_suspects(files: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo, path, size, stem): own code nobody imports that is neither protected, an entry point nor a variant.

    Files with a stored column ``entry`` (see ``sources.store``) need no ``content``.
    """
    path = F.col("path")
    entry = F.col("entry") if "entry" in files.columns else paths.entry_point(F.col("content"))
    kept = ~paths.protected_path(path) & ~is_artefact(path) & ~is_build_residue(path)
    # The cheap tests first: patterns over paths only see what is left of them.
    code = files.where(
        ~F.col("third_party") & F.col("text")
        & ~F.col("ext").isin(*dims.NON_CODE_EXTENSIONS)
        & ~F.coalesce(entry, F.lit(False)) & kept
    ).select("repo", "path", "size")
    unimported = orphan_by_import(code, signals).where(~F.col("stem").isin(*dims.CONVENTIONAL_STEMS))
    return unimported.join(variant_of(files).select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", "size", "stem")


def _candidate(df: DataFrame, category: Column, confidence: str) -> DataFrame:
    return df.select("repo", "path", "size", category.alias("category"), F.lit(confidence).alias("confidence"))


def deletion_candidates(tracked: DataFrame, files: DataFrame, signals: DataFrame, mentions: MentionIndex | None = None) -> DataFrame:
    """(repo, path, size, category, confidence): first category wins.

    ``tracked`` is everything under version control (artefacts and build
    residue are exactly what the scan skips); ``files`` is the scan. With a stored index of mentions
    no text is read.
    """
    path = F.col("path")
    artefact, residue = is_artefact(path), is_build_residue(path)
    protected = paths.protected_path(path)
    category = F.when(artefact, dims.CATEGORY_ARTEFACT).otherwise(dims.CATEGORY_BUILD)
    by_path = _candidate(
        tracked.where(artefact | (residue & ~protected)).select("repo", "path", "size"), category, "alta"
    )

    # The base may be any scanned file, protected ones included.
    all_variants = variant_of(files)
    variants = _candidate(
        all_variants.where(~protected & ~artefact & ~residue), F.lit(dims.CATEGORY_VARIANT), "media"
    )

    suspects = orphan_suspects(files, signals)
    lonely = mentions.unmentioned(suspects) if mentions else orphan_by_mention(suspects, files)
    orphans = _candidate(lonely, F.lit(dims.CATEGORY_ORPHAN), "media")
    return by_path.unionByName(variants).unionByName(orphans)


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Rank per repository by confidence (alta, media, baja), then size descending, then path."""
    level = F.when(F.col("confidence") == "alta", 0).when(F.col("confidence") == "media", 1).otherwise(2)
    return ranked(candidates, ["repo"], [level, F.col("size").desc(), F.col("path")], "rank")


def cleanup_summary(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, category, n_files, bytes, pct_files): rollup, category null for the total."""
    totals = files.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    rolled = candidates.rollup("repo", "category").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes")
    ).where(F.col("repo").isNotNull())
    share = F.when(
        F.coalesce(F.col("total"), F.lit(0)) > 0, F.bround(100.0 * F.col("n_files") / F.col("total"), 1)
    ).otherwise(F.lit(0.0))
    return rolled.join(totals, "repo", "left").select(
        "repo", "category", "n_files", "bytes", F.when(F.col("category").isNull(), share).alias("pct_files")
    )


def verdict_join(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every candidate with its verdict; verdicts on other paths vanish, silence means review."""
    delete = F.max(F.when(F.col("verdict") == "borrar", 1).otherwise(0)).alias("delete")
    judged = verdicts.groupBy("repo", "path").agg(delete, F.max("reason").alias("reason"))
    joined = candidates.join(judged, ["repo", "path"], "left")
    silent = F.concat(F.lit("no_verdict:"), F.col("category"))
    return joined.select(
        "repo", "path", "size", "category", "confidence",
        F.when(F.col("delete") == 1, "borrar").otherwise("revisar").alias("verdict"),
        F.when(F.col("delete").isNull(), silent).otherwise(F.col("reason")).alias("reason"),
    )
