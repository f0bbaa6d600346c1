"""Stored index of what the texts of a repository mention.

Written when evidence lands, so that a later search for names reads no text. The table ``kinds`` (repo, unit, longest) tells what
names a repository has, the table ``units`` (repo, unit, value, low0, high0,
low1, high1) holds the distinct words, chunks and lines that a name of the repository can stand in, with the range of two hashes of
the stems of the files that hold them: where either range is a point, all those files share one stem.

A name of n characters is looked up by its head, the first 2^k <= n characters. Units are cut into the windows of the few
head lengths in use, the windows that begin with a head of a name are cut to the lengths of the names with that head, and these are
compared whole. A place in a unit so costs at most the lengths of one head, however many names or units share a
gram: the work grows with the texts and names, not with their product. Values are cut into pieces that overlap by the longest
name, so no row grows with a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import paths
from fleetlens.functions.text import rx
from fleetlens.session import cut_lineage
from fleetlens.sources.corpus import spread

PIECE = 256  # characters of a piece, besides the overlap
# A name of word characters only occurs inside one maximal word run, one without white space inside one chunk, any other inside one line.
LANES = (42, 43)  # seeds of the hashes of a stem
UNITS = {"word": rx(r"\w+"), "chunk": r"\S+", "line": r"[^\n]+"}
RANGES = [f"{edge}{lane}" for lane in range(len(LANES)) for edge in ("low", "high")]
TABLES = {
    "units": "repo string, unit string, value string, " + ", ".join(f"{c} long" for c in RANGES),
    "kinds": "repo string, unit string, longest int",
}


def unit_of(stem: Column) -> Column:
    return F.when(stem.rlike(rx(r"\A\w+\z")), "word").when(stem.rlike(r"\A\S+\z"), "chunk").otherwise("line")


def _lanes(stem: Column) -> list[Column]:
    """Two 64-bit hashes of a stem; the second is seeded by a prefix, so stems that share one differ in the other."""
    return [F.xxhash64(F.lit(seed), stem) for seed in LANES]


@dataclass(frozen=True)
class MentionIndex:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def candidates(self, names: DataFrame) -> DataFrame:
        """(repo, stem, ranges): the windows of units that begin like a name and are as long as one that begins so."""
        wanted = names.where(F.length("stem") > 0).select("repo", unit_of(F.col("stem")).alias("unit"), "stem", F.length("stem").alias("n"))
        wanted = wanted.withColumn("size", F.expr("shiftleft(1, length(bin(n)) - 1)"))
        # A head has fewer lengths than it has characters, a kind of unit one size per power of two.
        heads = wanted.groupBy("repo", "unit", "size", F.substr("stem", F.lit(1), F.col("size")).alias("head")).agg(F.collect_set("n").alias("lengths"))
        sizes = wanted.groupBy("repo", "unit").agg(F.collect_set("size").alias("sizes"))
        units = self.table("units").join(sizes, ["repo", "unit"]).withColumn("size", F.explode("sizes")).where(F.length("value") >= F.col("size"))
        # Places behind the first PIECE stand in the next piece too; no name with this head has twice its length.
        places = f"sequence(1, least({PIECE}, length(value) - size + 1))"
        windows = units.select("repo", "unit", "size", *RANGES, F.explode(F.expr(f"array_distinct(transform({places}, i -> substr(value, i, 2 * size - 1)))")).alias("tail"))
        begun = windows.withColumn("head", F.substr("tail", F.lit(1), F.col("size"))).join(heads, ["repo", "unit", "size", "head"])
        cut = begun.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("tail"))
        return cut.select("repo", F.substr("tail", F.lit(1), F.col("n")).alias("stem"), *RANGES)

    def unmentioned(self, names: DataFrame) -> DataFrame:
        """The rows of ``names`` (repo, stem, ...) whose stem occurs in no file with another stem."""
        names = cut_lineage(names)  # read three times
        other = F.lit(False)
        for lane, own in enumerate(_lanes(F.col("stem"))):
            other = other | (F.col(f"low{lane}") != own) | (F.col(f"high{lane}") != own)
        return names.join(self.candidates(names).where(other).select("repo", "stem").distinct(), ["repo", "stem"], "left_anti")


def land_mentions(files: DataFrame, folder: str) -> MentionIndex:
    """Write the index of a scanned corpus; units are kept of the kinds that names of the repository need."""
    index = MentionIndex(files.sparkSession, folder)
    stems = files.select("repo", paths.stem_of(F.col("path")).alias("stem")).where(F.length("stem") > 0)
    kinds = stems.groupBy("repo", unit_of(F.col("stem")).alias("unit")).agg(F.max(F.length("stem")).alias("longest"))
    # Three rows a repository at most, read twice below: worked out once, and joined by the size they have.
    kinds.write.mode("overwrite").parquet(f"{folder}/kinds")
    kinds = index.table("kinds")

    def cut(unit: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(UNITS[unit]), F.lit(0)))
        return F.transform(found if unit == "word" else F.filter(found, lambda v: v.rlike(rx(r"\W"))), lambda v: F.struct(F.lit(unit).alias("unit"), v.alias("value")))

    needed = kinds.groupBy("repo").agg(F.collect_set("unit").alias("_kinds"))  # three at most
    readable = spread(files.where("text").select("repo", "path", "language", "size", "content")).join(needed, "repo")
    none = F.array().cast("array<struct<unit:string,value:string>>")
    kept = F.concat(*[F.when(F.array_contains("_kinds", u), cut(u)).otherwise(none) for u in UNITS])
    lanes = _lanes(paths.stem_of(F.col("path")))
    exploded = readable.select("repo", *[lane.alias(f"lane{k}") for k, lane in enumerate(lanes)], F.inline(kept))
    edges = [edge(f"lane{k}").alias(f"{name}{k}") for k in range(len(lanes)) for name, edge in (("low", F.min), ("high", F.max))]
    whole = exploded.groupBy("repo", "unit", "value").agg(*edges)
    pieces = whole.join(kinds, ["repo", "unit"]).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("value"), F.lit(PIECE))))
    units = pieces.select("repo", "unit", F.substr("value", F.col("at"), F.col("longest") + (PIECE - 1)).alias("value"), *RANGES)
    units.write.mode("overwrite").parquet(f"{folder}/units")
    return index
