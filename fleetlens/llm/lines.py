"""Line dedup over levelled, sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. A batch reduces its lines to
(hash, smallest doc_id), drops by a merge anti join what earlier runs hold, and
lands the rest as a new sorted run. When a level holds ``fanout`` runs they are
merged into one run of the next level, so the number of runs stays logarithmic.
At the end a line goes if the run entry of its key names another document.

Only DataFrame functions are used. The texts are read twice and shuffled once;
runs and line tables hold hashes and numbers, never lines.

Defined cases: null and empty texts are one empty line; documents without doc_id
keep all lines and hold no key; rows that repeat a doc_id count as one document,
and each such row keeps or loses its own lines; an empty table gives an empty
result. Other columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, UPPER, landed, text_or_empty

MIN_KEY = 10
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII blanks, with A-Z in lower case."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class Runs:
    """Sorted runs of (hash, holder) by level; ``add`` compacts a full level into the next."""

    def __init__(self, fanout: int):
        self.fanout, self.levels = fanout, []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, run: DataFrame, more: bool) -> None:
        self._put(0, _sorted_run(run), more)

    def _put(self, level: int, run: DataFrame, more: bool) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if more and len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._put(level + 1, _sorted_run(merged), more)


def _sorted_run(run: DataFrame) -> DataFrame:
    return landed(run.repartition("hash").sortWithinPartitions("hash"), "run")


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper doc_ids of all batches but the last: equal shares of the rows."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 10_000).alias("b")).first() if shares else None
    return sorted(set(found.b)) if found and found.b else []


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with ``text`` replaced by the kept lines, and n_lines (before), n_dropped."""
    bounds = _bounds(docs, batches)
    batch = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), batch.alias("batch"), F.posexplode(F.split(text_or_empty(), "\n", -1)))
        .withColumn("key", line_key(F.col("col")))
        .where(F.length("key") >= min_key)
        .select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("hash"), "batch")
    )
    lines = landed(lines, "lines", ["batch"])

    runs = Runs(fanout)
    for b in range(len(bounds) + 1):
        firsts = lines.where(F.col("batch") == b).groupBy("hash").agg(F.min("doc_id").alias("holder"))
        for run in runs.all():
            firsts = firsts.join(run, "hash", "left_anti")
        runs.add(firsts, more=b < len(bounds))

    holders = reduce(DataFrame.unionByName, runs.all())
    drops = (
        lines.join(holders, "hash").where(F.col("doc_id") != F.col("holder"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_drop"))
    )
    same = (docs["doc_id"] == F.col("_id")) & (F.xxhash64(text_or_empty()) == F.col("_hash"))
    # One struct per row binds the array of lines, so that it is not split anew for each line.
    parts = F.transform(
        F.array(F.struct(F.split(text_or_empty(), "\n", -1).alias("lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("drop"))),
        lambda s: F.struct(
            F.size(s["lines"]).cast("bigint").alias("n_lines"),
            F.size(s["drop"]).cast("bigint").alias("n_dropped"),
            F.when(F.size(s["drop"]) == 0, F.array_join(s["lines"], "\n")).otherwise(
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drop"]), lambda i: F.get(s["lines"], i)), "\n")
            ).alias("text"),
        ),
    )[0]
    joined = docs.join(drops, same, "left").withColumn("_kept", parts)
    replaced = {"text": F.col("_kept.text"), "n_lines": F.col("_kept.n_lines"), "n_dropped": F.col("_kept.n_dropped")}
    return joined.select(*[replaced.pop(c).alias(c) if c in replaced else docs[c] for c in docs.columns], *[v.alias(k) for k, v in replaced.items()])


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), holders AS (
  SELECT key, min(doc_id) AS holder FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, h.holder IS NOT NULL AND h.holder <> l.doc_id AS gone
  FROM lines l LEFT JOIN holders h ON l.key = h.key AND length(l.key) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
