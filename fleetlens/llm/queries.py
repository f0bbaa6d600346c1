"""One query per operator over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import golay, hyperdim, lines, mixing, negatives, neural, packing, secrets, toxicity, trie, voronoi, wavelet, winnow
from fleetlens.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.tokens_per_document(spark, table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op2_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op3_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op5_lexicon_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return neural.score(table(spark, folder, "documents"))


def op7_lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_credential_links(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def op9_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi.top_k(table(spark, folder, "embeddings"))


def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.compare_edited(table(spark, folder, "documents"))


def op11_hilbert_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op13_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    return hyperdim.identified(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_entropy_mixing": op2_entropy_mixing,
    "op3_line_runs": op3_line_runs,
    "op4_golay_simhash": op4_golay_simhash,
    "op5_lexicon_toxicity": op5_lexicon_toxicity,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_lexical_packing": op7_lexical_packing,
    "op8_credential_links": op8_credential_links,
    "op9_voronoi_top_k": op9_voronoi_top_k,
    "op10_winnowing": op10_winnowing,
    "op11_hilbert_negatives": op11_hilbert_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hyperdimensional_language": op13_hyperdimensional_language,
}

ORACLES: dict[str, str] = {
    "op3_line_runs": lines.ORACLE,
    "op9_voronoi_top_k": voronoi.ORACLE,
    "op11_hilbert_negatives": negatives.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
}
