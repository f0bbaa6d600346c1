"""Possibly personal data: counts and marks, never a matched value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.functions.text import NOT_SPACE, SPACE, column_name, lines_of, literal, rstrip, rx, scanned, strip
from fleetlens.operators.ranking import ranked

# An address is searched from its sign: what precedes it is read backwards to the end of its run, what follows forwards.
# Every character is looked at a bounded number of times, however long a run is.
LOCAL_RUN = r"\A[A-Za-z0-9._%+-]++"
DOMAIN = rx(r"\A[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
BEFORE = 40  # characters kept of what stands before an address


def _addresses(text: str) -> str:
    """SQL for array<struct<tail, used, before, address>>: the matches of ``dims.EMAIL``, with empty addresses where a sign has none.

    A fold over the parts between the signs carries how much of a part the address before it used up, since matches do
    not overlap. A local part starts at the first word boundary of its run.
    """
    run = f"reverse(regexp_extract(reverse(substring(x.`left`, s.last.used + 1)), {literal(LOCAL_RUN)}, 0))"
    led = "concat(substring(x.`left`, length(x.`left`) - length(r), IF(length(x.`left`) > length(r), 1, 0)), r)"
    word, other = literal(rx(r"\A\w++")), literal(rx(r"\A\W*+"))
    local = (
        f"transform(array({run}), r -> IF(length(x.`left`) > length(r) AND substring(x.`left`, length(x.`left`) - length(r), 1) rlike {literal(rx(r'\w'))}, "
        f"regexp_replace({led}, {word}, ''), regexp_replace({led}, {other}, '')))[0]"
    )
    found = "l <> '' AND x.domain <> ''"
    step = (
        f"transform(array({local}), l -> named_struct('tail', right(concat(s.last.tail, x.`left`, '@'), {BEFORE}), 'used', IF({found}, length(x.domain), 0), "
        f"'before', right(concat(s.last.tail, left(x.`left`, length(x.`left`) - length(l))), {BEFORE}), 'address', IF({found}, concat(l, '@', x.domain), '')))[0]"
    )
    parts = f"transform(array(split({text}, '@', -1)), p -> zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> named_struct('left', a, 'domain', regexp_extract(b, {literal(DOMAIN)}, 0))))[0]"
    return scanned(parts, "named_struct('tail', '', 'used', 0, 'before', '', 'address', '')", step, "struct<tail:string,used:int,before:string,address:string>")


def email_items(text: str | Column, drop_after_colon: bool = True) -> Column:
    """Distinct addresses in column ``text`` that may lead to a person.

    Dropped: machine and documentation addresses, templates, and the user part
    of a URL (``://`` in the token before the address).
    """
    text = column_name(text)
    found = F.expr(f"filter({_addresses(text)}, a -> a.address <> '')")
    ending = r"(?:\$|\}|:|//)\z" if drop_after_colon else r"(?:\$|\}|//)\z"

    def personal(m: Column) -> Column:
        last_token = F.regexp_extract(m["before"], rx(rf"({NOT_SPACE}+){SPACE}*\z"), 1)
        return (
            ~m["address"].rlike(rx(dims.IMPERSONAL_EMAIL, "i"))
            & ~rstrip(m["before"]).rlike(ending)
            & ~last_token.contains("://")
        )

    kept = F.array_distinct(F.transform(F.filter(found, personal), lambda m: m["address"]))
    return F.when(F.col(text).contains("@"), kept).otherwise(F.array().cast("array<string>"))


def distinct_hits(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _lower_hits(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.lower(v)))


def personal_emails(documents: DataFrame) -> DataFrame:
    """(repo, document, emails): number of distinct personal addresses, never their text."""
    return documents.select(
        "repo", "document", F.size(email_items("text")).alias("emails")
    ).where("emails > 0")


def personal_values(text: str) -> Column:
    """How many distinct identity numbers and addresses the column ``text`` transcribes."""
    return F.size(distinct_hits(F.col(text), rx(dims.RUT))) + F.size(email_items(text))


def pii_scan(files: DataFrame) -> DataFrame:
    """One row per own file that holds a value with the shape of personal data.

    A field name alone is not data. Spreadsheets are always reported. The sha256 is that of the raw
    bytes: a stored ``sha256`` column or ``bytes`` where the corpus has one, else of the text as it came.
    """
    raw = F.col("sha256") if "sha256" in files.columns else F.sha2(F.col("bytes" if "bytes" in files.columns else "content").cast("binary"), 256)
    text, path = F.col("content"), F.col("path")
    own = files.where(~F.col("third_party"))
    sheet = F.col("ext").isin(*dims.SPREADSHEET_EXTENSIONS)
    readable = F.col("text")
    in_test = paths.test_path(path)

    counted = own.where(sheet | readable).select(
        "repo", "path", "ext", "size", sheet.alias("sheet"), in_test.alias("in_test_path"), "content",
        F.when(sheet, 0).otherwise(F.size(distinct_hits(text, rx(dims.RUT)))).alias("rut"),
        F.when(sheet, 0).otherwise(F.size(email_items("content"))).alias("correo"),
        F.when(sheet, 0).otherwise(F.size(distinct_hits(text, rx(dims.PHONE_CL)))).alias("telefono"),
        raw.alias("sha256"),
    )
    found = counted.where(F.col("sheet") | (F.col("rut") + F.col("correo") + F.col("telefono") > 0))
    empty = F.array().cast("array<string>")
    special = F.when(F.col("sheet"), empty).otherwise(
        F.sort_array(_lower_hits(text, rx(dims.SPECIAL_CATEGORY, "i"))))
    fields = F.when(F.col("sheet"), 0).otherwise(F.size(_lower_hits(text, rx(dims.SENSITIVE_FIELD, "i"))))
    doubtful = ~F.col("sheet") & (F.col("in_test_path") | (F.size("special_category") > 0))
    return (
        found.withColumn("campos_sensibles", fields)
        .withColumn("special_category", special)
        .select(
            "repo", "path", "sha256",
            F.when(F.col("sheet"), "planilla").otherwise("patrones de dato personal").alias("reason"),
            F.struct("rut", "correo", "telefono", "campos_sensibles").alias("counts"),
            "in_test_path", "special_category",
            F.when(doubtful, "[VERIFICAR]").otherwise("[PENDIENTE]").alias("mark"),
        )
    )


def _total() -> Column:
    counts = F.col("counts")
    return counts["rut"] + counts["correo"] + counts["telefono"] + counts["campos_sensibles"]


def pii_order(findings: DataFrame) -> DataFrame:
    """Rank of every finding per repository by total counts, then path."""
    return ranked(findings, ["repo"], [_total().desc(), F.col("path")], "rank")


def gitignore_patterns(files: DataFrame) -> DataFrame:
    """(repo, patterns): lines of the root .gitignore that are not comments."""
    lines = F.transform(lines_of(F.col("content")), strip)
    kept = F.filter(lines, lambda l: (l != "") & ~l.startswith("#"))
    return files.where(F.col("path") == ".gitignore").select("repo", kept.alias("patterns"))


def pii_ignore_status(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``ignored_anchored``; the pattern table has one row per repository."""
    joined = findings.join(patterns, "repo", "left")
    return joined.withColumn("ignored_anchored", paths.gitignore_anchored(F.col("path"), F.col("patterns"))).drop(
        "patterns"
    )
