"""Checks on derived documents before they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.text import lines_of, rx
from fleetlens.operators.extract import citation_extract
from fleetlens.operators.pii import personal_values


def normalize_citation(cited: Column) -> Column:
    """Forward slashes, no leading ``./`` or ``/``; the dot of a hidden file stays."""
    unix = F.replace(cited, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(unix, r"\A(?:\./)*/*", "")


def _with_corpus(documents: DataFrame) -> DataFrame:
    """Documents name in ``corpus_repo`` whose files they talk about; without the column it is their own repository."""
    return documents if "corpus_repo" in documents.columns else documents.withColumn("corpus_repo", F.col("repo"))


def citation_check(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, cited, valid): distinct cited files and whether they exist.

    A bare base name that exists anywhere in the repository is accepted. Paths and base names are
    one key space, so existence is one semi join: files are shuffled once and never copied per document.
    """
    body = _with_corpus(documents).where(F.col("document") != dims.REPORT_SECTION)
    linked = body.select("repo", "corpus_repo").distinct()
    cited = citation_extract(body).select("repo", normalize_citation(F.col("cited")).alias("cited")).distinct()
    base = F.substring_index(F.col("path"), "/", -1)
    known = files.select(F.col("repo").alias("corpus_repo"), F.explode(F.array(
        F.concat(F.lit("p:"), F.col("path")), F.concat(F.lit("b:"), base))).alias("key"))
    cited_base = F.substring_index(F.col("cited"), "/", -1)
    probes = cited.join(linked, "repo").select("repo", "corpus_repo", "cited", F.explode(F.array(
        F.concat(F.lit("p:"), F.col("cited")), F.concat(F.lit("b:"), cited_base))).alias("key"))
    hit = probes.join(known, ["corpus_repo", "key"], "left_semi").select("repo", "cited").distinct().withColumn("hit", F.lit(True))
    return cited.join(hit, ["repo", "cited"], "left").select("repo", "cited", F.coalesce("hit", F.lit(False)).alias("valid"))


def carried_lines(text: Column) -> Column:
    """array<struct<value, path>>: each line with the last ``ruta:`` seen so far, inside the row."""
    def step(acc: Column, value: Column) -> Column:
        raw = F.regexp_extract(value, rx(r"\A\s*-?\s*ruta:\s*(.+?)\s*\z"), 1)
        path = F.when(raw != "", F.regexp_replace(F.trim(raw), r"\A[\"']+|[\"']+\z", "")).otherwise(acc["path"])
        return F.struct(path.alias("path"), F.concat(acc["lines"], F.array(F.struct(value.alias("value"), path.alias("path")))).alias("lines"))

    start = F.struct(F.lit(None).cast("string").alias("path"), F.array().cast("array<struct<value:string,path:string>>").alias("lines"))
    return F.aggregate(lines_of(text), start, step, lambda acc: acc["lines"])


def carry_path(documents: DataFrame) -> DataFrame:
    """(repo, document, line, value, path): each line with the last ``ruta:`` seen so far; no shuffle."""
    kept = [c for c in ("repo", "corpus_repo", "document") if c in documents.columns]
    lines = documents.select(*kept, F.posexplode(carried_lines(F.col("text"))).alias("n", "l"))
    return lines.select(*kept, (F.col("n") + 1).alias("line"), F.col("l.value").alias("value"), F.col("l.path").alias("path"))


def manifest_seal(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """(repo, document, text): every ``sha256:`` line after a path gets the real hash or a pending mark."""
    lines = carry_path(_with_corpus(documents))
    known = hashes.select(F.col("repo").alias("corpus_repo"), "path", "sha256")
    joined = lines.join(known, ["corpus_repo", "path"], "left")
    value = F.col("value")
    indent = F.regexp_extract(value, r"\A(\s*)", 1)
    sealed = F.concat(indent, F.lit('sha256: "'), F.coalesce(F.col("sha256"), F.lit(dims.PENDING_SHA)), F.lit('"'))
    is_hash = value.rlike(r"\A\s*sha256:") & F.col("path").isNotNull()
    ordered = F.array_sort(F.collect_list(F.struct("line", F.when(is_hash, sealed).otherwise(value).alias("value"))))
    text = F.concat(F.array_join(F.transform(ordered, lambda l: l["value"]), "\n"), F.lit("\n"))
    return joined.groupBy("repo", "document").agg(text.alias("text"))


def missing_documents(documents: DataFrame, required=dims.REQUIRED_DOCUMENTS) -> DataFrame:
    """(repo, missing): required documents a repository lacks, in their order."""
    names = F.array(*[F.lit(d) for d in required])
    present = F.collect_set(F.when(F.col("document").isin(*required), F.col("document")))
    return documents.groupBy("repo").agg(F.array_except(names, present).alias("missing"))


def human_inputs_guard(documents: DataFrame, required=dims.REQUIRED_DOCUMENTS) -> DataFrame:
    """(repo, human): some required document lacks the derived mark, so people wrote it."""
    own = F.col("document").isin(*required) & ~F.upper(F.col("text")).contains(dims.DERIVED_MARK)
    return documents.groupBy("repo").agg(F.bool_or(own).alias("human"))


def publish_gate(documents: DataFrame, files: DataFrame, required=dims.REQUIRED_DOCUMENTS) -> DataFrame:
    """(repo, missing, citations, invented, invented_share, personal_documents, publishable)."""
    checked = citation_check(documents, files).groupBy("repo").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(~F.col("valid")).alias("invented"))
    personal = documents.groupBy("repo").agg(
        F.count_if(personal_values("text") > 0).alias("personal_documents"))
    joined = missing_documents(documents, required).join(personal, "repo").join(checked, "repo", "left")
    citations = F.coalesce(F.col("citations"), F.lit(0))
    invented = F.coalesce(F.col("invented"), F.lit(0))
    publishable = (F.size("missing") == 0) & (invented == 0) & (citations > 0) & (F.col("personal_documents") == 0)
    return joined.select(
        "repo", "missing", citations.alias("citations"), invented.alias("invented"),
        F.when(citations > 0, invented / citations).otherwise(F.lit(0.0)).alias("invented_share"), "personal_documents",
        publishable.alias("publishable"),
    )
