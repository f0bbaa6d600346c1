"""Mixing sources to target weights by entropy balancing.

Targets share the size of all documents among sources by weight, none above
``limit`` times its own size. Document rates r stay as near to 1 as possible in
relative entropy while the words of each source meet its target and no rate
exceeds ``limit``: r = min(limit, exp(lambda * size)), an exponential tilt with one
dual variable per source. All duals are solved together by Newton iterations
with a bracket; an iteration is one distributed aggregate over counts per
(source, size). Rates become whole copies by systematic rounding along
(source, size, hash): cumulative rates are whole numbers of 2**-20, taken over range
partitions, so a source with a third of all rows is spread like any other.
Two correcting steps then add or remove one copy per source where that comes nearer to the target.

All sums are of whole numbers, so reruns agree.

Defined cases: null texts have size 0 and are taken once or as their rate says,
which adds no words; the null source is a source and comes last; sources without
words have target 0; repeated rows are rounded each; rows without doc_id take part;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, landed, shuffle_width, text_or_empty
from fleetlens.operators.ranking import ranked

LIMIT = 3
UNIT = 20  # rates are whole numbers of 2 ** -20
FINE = 1 << 10  # and sums of words whole numbers of 2 ** -10
STEPS = 60
FEW_SOURCES = 100_000  # up to so many rows of a few numbers, tables of one row per source are broadcast; beyond, joined by shuffle


def sizes_of(docs: DataFrame) -> DataFrame:
    return landed(docs.select(
        "doc_id", "source", F.xxhash64(text_or_empty()).alias("text_hash"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size")
    ), "sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """Per source: place (from 1, by code point, null last), source_size, weight, target.

    The excess over the limit is shared again by weight; that raises one common level until no source is newly above it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.count_if(F.col("size") > 0).alias("n"))
    placed = landed(ranked(sources, [], [F.col("source").asc_nulls_last()], "place").withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    ), "sources")
    full = limit * F.col("source_size")
    level = 0.0
    while True:
        above = F.lit(level) * F.col("weight") > full
        total, fixed, open_weight = placed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        now = (total - fixed) / open_weight if open_weight else level
        if now <= level:
            break
        level = now
    return placed.withColumn("target", F.least(F.lit(level) * F.col("weight"), full.cast("double")))


def _few(per_source: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(per_source) if n_sources <= FEW_SOURCES else per_source


def duals(counts: DataFrame, sources: DataFrame, n_sources: int, limit: int = LIMIT) -> DataFrame:
    """place, dual for every source, from counts (place, size, k) of documents."""
    scale = F.col("source_size") / F.greatest(F.col("n"), F.lit(1))
    least = F.col("least") / scale
    low = F.when((F.col("target") > 0) & (F.col("target") < F.col("source_size")), F.log(F.col("target") / F.col("source_size")) / least).otherwise(0.0)
    state = sources.where(F.col("source_size") > 0).select(
        "place", "target", scale.alias("scale"), low.alias("low"), (F.log(F.lit(float(limit))) / least).alias("high"), F.lit(0.0).alias("dual"), F.lit(False).alias("done")
    )
    state = landed(state, "duals")
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.exp(F.least(F.col("dual") * x, F.lit(700.0))), F.lit(float(limit)))
        words = F.col("k") * F.col("size") * rate
        slope = F.when(rate < limit, words * x).otherwise(0.0)
        whole = lambda c: F.sum(F.round(c * FINE).cast("decimal(38,0)")).cast("double") / FINE
        reached = counts.join(_few(state.where(~F.col("done")), n_sources), "place").groupBy("place").agg(whole(words).alias("words"), whole(slope).alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap >= 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - gap / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        near = F.abs(gap) <= F.greatest(F.lit(0.5), 1e-7 * F.col("target"))
        moved = state.join(reached, "place", "left").withColumn("near", F.col("done") | F.coalesce(near, F.lit(True))).select(
            "place", "target", "scale", F.when(F.col("near"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("near"), F.col("high")).otherwise(high).alias("high"),
            F.when(F.col("near"), F.col("dual")).otherwise(step).alias("dual"), F.col("near").alias("done"),
        )
        state = landed(moved, "duals")
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("place", "scale", "dual")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, source, text_hash, size, source_size, target, rate, copies, taken (words)."""
    sized = sizes_of(docs)
    sources = landed(targets(sized, weights, limit), "targets")
    n_sources = sources.count()
    known = sized.join(_few(sources.select(F.col("source").alias("_source"), "place"), n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    counts = landed(known.groupBy("place", "size").agg(F.count("*").alias("k")), "size-counts")
    solved = duals(counts, sources, n_sources, limit)
    bound = sources.select("place", "source_size", "target").join(solved, "place", "left")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(F.least(F.col("dual") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(float(limit))))
    rated = known.join(_few(bound, n_sources), "place").select(
        "doc_id", "source", "text_hash", "place", "size", "source_size", "target", F.round(rate * (1 << UNIT)).cast("bigint").alias("share"), F.xxhash64("doc_id", "text_hash").alias("spread")
    )
    order = ["size", "spread", "doc_id"]
    dealt = landed(rated.repartitionByRange(shuffle_width(docs.sparkSession), "place", *order).withColumn("part", F.spark_partition_id()), "rates")

    run = Window.partitionBy("part", "place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("upto", F.sum("share").over(run)).withColumn("seq", F.count("*").over(run))
    earlier = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part and source
    offsets = dealt.groupBy("part", "place").agg(F.sum("share").alias("shares"), F.count("*").alias("rows")).select(
        "part", "place", F.coalesce(F.sum("shares").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before")
    )
    end = F.col("before") + F.col("upto") + (1 << (UNIT - 1))
    rounded = inside.join(offsets, ["part", "place"]).select(
        "doc_id", "source", "text_hash", "place", "size", "source_size", "target", (F.col("share") / (1 << UNIT)).alias("rate"), (F.col("rows_before") + F.col("seq")).alias("seq"),
        (F.shiftright(end, UNIT) - F.shiftright(end - F.col("share"), UNIT)).alias("copies"),
    )
    for _ in range(2):
        rounded = _nearer(landed(rounded, "copies"), n_sources, limit)
    return rounded.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _nearer(rounded: DataFrame, n_sources: int, limit: int) -> DataFrame:
    """One copy more or less of the one document per source that brings the source nearest to its target."""
    gaps = rounded.groupBy("place").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    able = F.when(F.col("gap") > 0, F.col("copies") < limit).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    left = F.abs(F.abs(F.col("gap")) - F.col("size"))
    picks = (
        rounded.join(_few(gaps, n_sources), "place").where(able & (left < F.abs(F.col("gap")))).groupBy("place")
        .agg(F.min(F.struct(left.alias("left"), F.col("seq"), F.signum("gap").cast("bigint").alias("sign"))).alias("p"))
        .select("place", "p.seq", "p.sign")
    )
    return rounded.join(_few(picks, n_sources), ["place", "seq"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign")
