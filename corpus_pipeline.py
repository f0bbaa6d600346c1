"""The training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and
hands the table to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import golay, lines, mixing, packing, toxicity
from fleetlens.llm.common import landed, table, text_or_empty
from fleetlens.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the lexicon is learned from the training labels."""
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.kept(docs, lexicon).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but the first document; n_chars follows the text."""
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints that link at four or fewer bits (four-word shingles) one row stays: the first by doc_id (none last), then text hash."""
    return golay.survivors(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without words are taken once."""
    taken = mixing.mix(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").cast("int").alias("copies"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "copies")
    # Rows equal in id, source and text were rounded apart; the first takes the copies of all.
    single = docs.withColumn("_hash_of", F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", "source", "_hash_of"])
    same = single["doc_id"].eqNullSafe(F.col("_id")) & single["source"].eqNullSafe(F.col("_source")) & (F.col("_hash_of") == F.col("_hash"))
    return single.join(taken, same).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # scores, fingerprints and retrieval are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
