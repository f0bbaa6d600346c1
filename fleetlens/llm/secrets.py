"""Secrets and multipart credentials with DataFrame functions only.

Base spans are the matches of three patterns with code point positions. Further
spans come from linking: identifiers, secrets and endpoints of a text are
interval-joined within ``SCOPE`` code points, and a weak candidate is reported
only where its complementary parts stand near it (an identifier needs a secret,
a secret an identifier, an endpoint both). The join is an equi join on (text,
window) against one summary row per window, part and text, so its output is
linear in the spans.

Defined cases: null and empty texts have no spans; rows that repeat doc_id and
text each get the same spans, and rows without doc_id are handled like others;
an empty table gives an empty result; an unbroken run of any length takes time in proportion
to it. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import literal, scanned
from fleetlens.llm.common import landed, text_or_empty

SCOPE = 400
KINDS = ("assign", "access", "hex", "ident", "weak_secret", "endpoint")
# Fixed patterns of the base spans. Runs of fewer than the least length can't hold a match that starts later,
# so the length stands in the pattern; for assign a short value uses up its text and is dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts: worth nothing alone.
IDENT = r"""(?i)\b(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
# No repeated group, and a host name is judged once per run of its characters: time stays linear in a run.
ENDPOINT = r"""https?://[^\s"'<>]++|(?<![\w.-])(?:[0-9]{1,3}+\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b|(?<![\w.-])[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.(?:com|net|org|io|dev|cloud)\b"""
SPAN = "struct<start:bigint,no:int,end:bigint>"


def _spans(pattern: str, no: int, value_group: int | None = None, least: int = 0) -> Column:
    """Spans of all matches in ``text``: the gaps between them and the matches give the places.

    Splitting and extracting step through a text in the same way, leftmost and without overlap.
    """
    p = literal(pattern)
    matches = f"regexp_extract_all(text, {p}, 0)"
    values = f"regexp_extract_all(text, {p}, {value_group})" if value_group else matches
    sizes = f"transform(arrays_zip(split(text, {p}, -1), {matches}, {values}), v -> named_struct('gap', length(v.`0`), 'size', length(v.`1`), 'value', length(v.`2`)))"
    placed = scanned(
        sizes, f"named_struct('start', 0, 'no', {no}, 'end', 0, 'kept', false)",
        f"named_struct('start', s.last.end + x.gap, 'no', {no}, 'end', s.last.end + x.gap + coalesce(x.size, 0), 'kept', coalesce(x.value >= {least}, false))",
        "struct<start:bigint,no:int,end:bigint,kept:boolean>",
    )
    return F.expr(f"transform(filter({placed}, v -> v.kept), v -> named_struct('start', v.start, 'no', v.no, 'end', v.end))").cast(f"array<{SPAN}>")


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _if(found: Column, spans: Column) -> Column:
    return F.when(found, spans).otherwise(_none())


def find_parts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, base spans, and weak candidates of texts that hold a possible partner."""
    text = text_or_empty()
    whole = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    text = F.col("text")
    base = whole.select(
        "doc_id", "text_hash", "text", text.rlike(IDENT).alias("has_ident"),
        _if(text.rlike(ASSIGN), _spans(ASSIGN, 0, 2, 6)).alias("assign"),
        _if(text.contains("AKIA"), _spans(ACCESS, 1)).alias("access"),
        _if(text.rlike("[0-9a-f]{24}"), _spans(HEX, 2)).alias("hex"),
    )
    identified = F.col("has_ident") | (F.size("access") > 0)
    return base.select(
        "doc_id", "text_hash", F.concat("assign", "access", "hex").alias("base"),
        F.concat(
            _if(F.col("has_ident"), _spans(IDENT, 3)),
            _if(identified, _spans(SECRET, 4)),
            _if(identified, _spans(ENDPOINT, 5)),
        ).alias("weak"),
    )


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates whose complementary parts co-occur: doc_id, text_hash, linked (array of spans)."""
    window = lambda c: F.floor(c / F.lit(scope)).cast("bigint")
    role = F.when(F.col("s.no").isin(1, 3), "identifier").when(F.col("s.no") == 5, "endpoint").otherwise("secret")
    able = parts.where(F.size("weak") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = able.select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("s")).where(F.col("s.no") != 5).select(
        "doc_id", "text_hash", role.alias("role"), "s.start", "s.end"
    )
    summary = (
        spans.withColumn("window", F.explode(F.sequence(window(F.col("start")), window(F.col("end")))))
        .groupBy("doc_id", "text_hash", "window", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    weak = able.select("doc_id", "text_hash", F.explode("weak").alias("s")).withColumn(
        "window", F.explode(F.sequence(window(F.col("s.start") - scope), window(F.col("s.end") + scope)))
    )
    w, p = weak.alias("w"), summary.alias("p")
    near = (
        F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.text_hash") == F.col("p.text_hash")) & (F.col("w.window") == F.col("p.window"))
        & (F.col("p.last") >= F.col("w.s.start") - scope) & (F.col("p.first") <= F.col("w.s.end") + scope)
    )
    found = w.join(p, near).groupBy("w.doc_id", "w.text_hash", "w.s").agg(
        F.max(F.col("p.role") == "identifier").alias("identifier"), F.max(F.col("p.role") == "secret").alias("secret")
    )
    no = F.col("s.no")
    kept = found.where(((no == 3) & F.col("secret")) | ((no == 4) & F.col("identifier")) | ((no == 5) & F.col("identifier") & F.col("secret")))
    return kept.groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("linked"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, base and linked (arrays of spans: start, no in ``KINDS``, end)."""
    parts = landed(find_parts(docs), "secret-parts")
    linked = link_parts(parts, scope).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "linked")
    return parts.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "base", F.coalesce("linked", _none()).alias("linked")
    )


def digest(found: DataFrame) -> DataFrame:
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )
