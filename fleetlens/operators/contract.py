"""README contract: what may be written, block by block; human text is never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.text import (
    blank_to_null, literal, newline_count, newlines, normalize_newlines, normalize_text, rstrip, rx, scanned, strip, text_sha12,
)

BEGIN = rx(dims.BLOCK_BEGIN, "i")
MARKER = rx(rf"{dims.BLOCK_BEGIN}|{dims.BLOCK_END}", "i")
END = rx(rf"\A{dims.BLOCK_END}", "i")
LOCK = rx(dims.LOCK_MARK, "i")
FINGERPRINT = rx(dims.FINGERPRINT_MARK, "i")


def placeholder_readme(text: Column, repo: Column, mode: str = "contract") -> Column:
    """Not documentation: absent, short, or only the repository title.

    Three definitions exist. ``contract`` measures the normalized text and drops
    a title line in any case; ``selection`` measures the trimmed text and drops
    the exact title.
    """
    if mode == "contract":
        body = normalize_text(text)
        title = F.concat(F.lit(r"(?Udim)^#\s*\Q"), repo, F.lit(r"\E\s*$"))
        rest = strip(F.regexp_replace(body, title, F.lit("")))
    else:
        body = strip(text)
        rest = strip(F.replace(body, F.concat(F.lit("# "), repo), F.lit("")))
    return F.coalesce((F.length(body) < dims.PLACEHOLDER_SIZE) | (rest == ""), F.lit(True))


def merge_action(text: Column, repo: Column) -> Column:
    """The order matters: lock, then markers, then size."""
    return (
        F.when(text.rlike(LOCK), "bloqueado")
        .when(text.rlike(BEGIN), "fusionado")
        .when(placeholder_readme(text, repo), "creado")
        .otherwise("respetado")
    )


def marked(text: str) -> str:
    """SQL for array<struct<gap, mark, ends, id, sha>> of column ``text``: the text before each marker and the marker, the last without one.

    Two passes over the text; whatever follows works on the markers in their order.
    """
    m, begin = literal(MARKER), literal(BEGIN)
    zipped = f"arrays_zip(split({text}, {m}, -1), regexp_extract_all({text}, {m}, 0))"
    return (
        f"transform({zipped}, v -> named_struct('gap', v.`0`, 'mark', v.`1`, 'ends', coalesce(v.`1` rlike {literal(END)}, false), "
        f"'id', regexp_extract(v.`1`, {begin}, 1), 'sha', regexp_extract(v.`1`, {begin}, 2)))"
    )


def inside(first: str, last: str) -> str:
    """SQL for the text after marker ``first`` up to marker ``last`` (places in ``m``)."""
    return f"array_join(transform(slice(m, {first} + 2, {last} - {first}), (v, i) -> IF(i < {last} - {first} - 1, concat(v.gap, v.mark), v.gap)), '')"


def block_items(text: str) -> Column:
    """array<struct<line, marker, id, sha, content>> of column ``text`` in document order.

    A BEGIN pairs with the first END after it, whose id is not compared: a fold over the markers from the last one
    carries the nearest END.
    """
    places = "reverse(transform(m, (v, i) -> named_struct('i', i, 'ends', v.ends)))"
    nearest = f"reverse({scanned(places, '-1', 'IF(x.ends, x.i, s.last)', 'int')})"
    lines = scanned(
        f"transform(m, v -> named_struct('before', {newlines('v.gap')}, 'inside', coalesce({newlines('v.mark')}, 0)))",
        "named_struct('line', 1, 'next', 1)", "named_struct('line', s.last.next + x.before, 'next', s.last.next + x.before + x.inside)", "struct<line:int,next:int>")
    begins = f"filter(transform(arrays_zip({nearest}, {lines}), (z, i) -> named_struct('i', i, 'last', z.`0`, 'line', z.`1`.line)), z -> z.last > z.i AND NOT m[z.i].ends)"
    shaped = f"transform({begins}, z -> named_struct('line', z.line, 'marker', m[z.i].mark, 'id', m[z.i].id, 'sha', m[z.i].sha, 'content', {inside('z.i', 'z.last')}))"
    return F.expr(f"CASE WHEN {text} rlike {literal(BEGIN)} THEN transform(array({marked(text)}), m -> {shaped})[0] END")


def outer_blocks() -> str:
    """SQL for array<struct<first, last>> over markers ``m``: a small state machine that is inside a block or outside."""
    states = scanned(
        "transform(m, (v, i) -> named_struct('i', i, 'ends', v.ends, 'begins', v.mark IS NOT NULL AND NOT v.ends))",
        "named_struct('open', -1, 'first', -1, 'last', -1)",
        "CASE WHEN s.last.open < 0 AND x.begins THEN named_struct('open', x.i, 'first', -1, 'last', -1) "
        "WHEN s.last.open >= 0 AND x.ends THEN named_struct('open', -1, 'first', s.last.open, 'last', x.i) "
        "ELSE named_struct('open', s.last.open, 'first', -1, 'last', -1) END", "struct<open:int,first:int,last:int>")
    return f"filter({states}, s -> s.last >= 0)"


def block_pairing(readmes: DataFrame) -> DataFrame:
    """(repo, n, id, begin_line, end_line): each BEGIN with the first END after it.

    The pairing is a look-ahead inside the row, so no window and no shuffle.
    """
    exploded = readmes.select("repo", F.posexplode(block_items("text")).alias("n", "b"))
    end = F.col("b.line") + newline_count(F.concat(F.col("b.marker"), F.col("b.content")))
    return exploded.select("repo", "n", "b.id", F.col("b.line").alias("begin_line"), end.alias("end_line"))


def managed_blocks(readmes: DataFrame) -> DataFrame:
    """(repo, n, id, declared_sha, current_sha, frozen, content)."""
    exploded = readmes.select("repo", F.posexplode(block_items("text")).alias("n", "b"))
    declared, current = blank_to_null(F.col("b.sha")), text_sha12(F.col("b.content"))
    frozen = F.coalesce(declared != current, F.lit(False))
    return exploded.select(
        "repo", "n", "b.id", declared.alias("declared_sha"), current.alias("current_sha"),
        frozen.alias("frozen"), "b.content",
    )


def merge_blocks(readmes: DataFrame, generated: str = "generated") -> DataFrame:
    """(repo, action, content, conflicts): non-frozen blocks replaced, all other text kept.

    ``generated`` names the column with the new text. A BEGIN nested in another
    block belongs to the outer one.
    """
    text, body = F.col("text"), normalize_text(F.col(generated))

    def between(first: str, last: str) -> str:
        """Everything after marker ``first`` and before marker ``last``, other markers included."""
        return f"array_join(transform(slice(m, {first} + 2, {last} - {first}), (v, i) -> IF(i < {last} - {first} - 1, concat(v.gap, coalesce(v.mark, '')), v.gap)), '')"

    content = inside("b.first", "b.last")
    cut = f"transform({outer_blocks()}, b -> named_struct('first', b.first, 'last', b.last, 'id', m[b.first].id, 'sha', m[b.first].sha, 'content', {content}))"
    judged = readmes.where(text.rlike(BEGIN)).select("repo", "text", body.alias("_body"), text_sha12(body).alias("_sha"), F.expr(marked("text")).alias("m")).select(
        "*", F.expr(cut).alias("_cut")
    )
    frozen = F.transform("_cut", lambda b: F.struct(*[b[c].alias(c) for c in ("first", "last", "id")], ((b["sha"] != "") & (b["sha"] != text_sha12(b["content"]))).alias("frozen")))
    judged = judged.select("repo", "text", "_body", "_sha", "m", frozen.alias("_blocks"))
    whole = f"concat(m[b.first].mark, {inside('b.first', 'b.last')}, m[b.last].mark)"
    fresh = "concat('<!-- AI:BEGIN id=', b.id, ' sha=', _sha, ' -->\\n', _body, '\\n<!-- AI:END id=', b.id, ' -->')"
    before = between("IF(n = 0, -1, _blocks[n - 1].last)", "b.first")
    tail = between("_blocks[size(_blocks) - 1].last", "size(m) - 1")
    merged = F.expr(f"concat(array_join(transform(_blocks, (b, n) -> concat({before}, IF(b.frozen, {whole}, {fresh}))), ''), {tail})")
    ended = F.when(merged.endswith("\n"), merged).otherwise(F.concat(merged, F.lit("\n")))
    open_blocks = F.exists("_blocks", lambda b: ~b["frozen"])
    return judged.where(F.size("_blocks") > 0).select(
        "repo",
        F.when(open_blocks, "fusionado").otherwise("respetado").alias("action"),
        F.when(open_blocks, ended).otherwise(F.col("text")).alias("content"),
        F.transform(F.filter("_blocks", lambda b: b["frozen"]), lambda b: b["id"]).alias("conflicts"),
    )


def wrap_block(content: Column, block: str = dims.MAIN_BLOCK) -> Column:
    """New text inside a managed block with its hash."""
    body = normalize_text(content)
    return F.concat(
        F.lit(f"<!-- AI:BEGIN id={block} sha="), text_sha12(body), F.lit(" -->\n"), body,
        F.lit(f"\n<!-- AI:END id={block} -->\n"))


def fingerprint_read(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, FINGERPRINT, 1))


def fingerprint_remove(text: Column) -> Column:
    return F.concat(rstrip(F.regexp_replace(text, FINGERPRINT, "")), F.lit("\n"))


def fingerprint_seal(text: Column, sha: Column) -> Column:
    """Any marker removed, one appended; sealing twice changes nothing."""
    bare = rstrip(F.regexp_replace(text, FINGERPRINT, ""))
    return F.concat(bare, F.lit("\n\n" + dims.FINGERPRINT_PREFIX), sha, F.lit(" -->\n"))


def change_gate(readmes: DataFrame, fingerprints: DataFrame, force: bool = False) -> DataFrame:
    """(repo, previous, sha, gate, skip): sealed fingerprint against the current one."""
    sealed = readmes.select("repo", fingerprint_read(F.col("text")).alias("previous"))
    joined = fingerprints.select("repo", "sha").join(sealed, "repo", "left")
    gate = (
        F.when(F.col("previous").isNull(), "sin_sello")
        .when(F.col("previous") == F.col("sha"), "sin_cambios")
        .otherwise("cambio")
    )
    skip = (gate == "sin_cambios") & F.lit(not force)
    return joined.select("repo", "previous", "sha", gate.alias("gate"), skip.alias("skip"))


def plan_actions(
    config: DataFrame, readmes: DataFrame, fingerprints: DataFrame, candidate_counts: DataFrame
) -> DataFrame:
    """(repo, plan, action, gate, writes, candidates): dry run per repository.

    ``config`` (repo, enabled) and ``candidate_counts`` (repo, candidates) have
    one row per repository; nothing here multiplies rows.
    """
    action = readmes.select("repo", merge_action(F.col("text"), F.col("repo")).alias("action"))
    joined = (
        change_gate(readmes, fingerprints).select("repo", "gate", "skip")
        .join(action, "repo", "left")
        .join(config.select("repo", "enabled"), "repo", "left")
        .join(candidate_counts, "repo", "left")
    )
    act = F.coalesce(F.col("action"), F.lit("creado"))
    enabled = F.coalesce(F.col("enabled"), F.lit(True))
    plan = (
        F.when(~enabled, "desactivado")
        .when(act.isin("bloqueado", "respetado"), act)
        .when(F.col("skip"), "sin_cambios")
        .otherwise(act)
    )
    return joined.select(
        "repo", plan.alias("plan"), act.alias("action"), "gate",
        plan.isin("creado", "fusionado").alias("writes"),
        F.coalesce(F.col("candidates"), F.lit(0)).cast("bigint").alias("candidates"),
    )


# --- configuration ----------------------------------------------------------

FALSE_VALUES = ("false", "0", "0.0", "", "[]", "{}")


def config_unknown_keys(settings: Column) -> Column:
    return F.sort_array(F.array_except(F.map_keys(settings), F.array(*[F.lit(k) for k in dims.CONFIG_KEYS])))


def config_resolve(config: DataFrame) -> DataFrame:
    """Typed settings with defaults; bad input never fails, it only warns.

    ``raw`` is a JSON object per repository (null when the file is absent).
    """
    settings = F.from_json(F.col("raw"), "map<string,string>")
    parsed = config.select("repo", "raw", settings.alias("m"))
    m = F.col("m")
    present = F.col("raw").isNotNull()

    def has(key: str) -> Column:
        return F.coalesce(F.map_contains_key(m, key), F.lit(False))

    def flag(key: str, default: bool) -> Column:
        truthy = F.coalesce(~F.lower(m[key]).isin(*FALSE_VALUES), F.lit(False))
        return F.when(has(key), truthy).otherwise(F.lit(default))

    lang = F.when(has("lang"), strip(F.lower(F.coalesce(m["lang"], F.lit("none"))))).otherwise("es")
    known = lang.isin(*dims.CONFIG_LANGUAGES)
    ignore = m["ignore_paths"]
    as_list = F.when(ignore.startswith("["), F.from_json(ignore, "array<string>")).otherwise(F.array(ignore))
    cleaned = F.filter(F.transform(as_list, strip), lambda p: p.isNotNull() & (p != ""))
    unknown = config_unknown_keys(m)
    warnings = F.array_compact(F.array(
        F.when(present & m.isNull(), F.lit("not_a_map")),
        F.when(m.isNotNull() & ~known, F.concat(
            F.lit("unknown_lang:"), lang)),
        F.when(F.size(unknown) > 0, F.concat(
            F.lit("unknown_keys:"), F.array_join(unknown, ", "))),
    ))
    return parsed.select(
        "repo", present.alias("present"), flag("enabled", True).alias("enabled"),
        F.when(known, lang).otherwise("es").alias("lang"),
        F.coalesce(cleaned, F.array().cast("array<string>")).alias("ignore_paths"),
        strip(F.coalesce(m["declared"], F.lit(""))).alias("declared"),
        flag("artifacts", False).alias("artifacts"), flag("cleanup", True).alias("cleanup"),
        flag("insumos", False).alias("insumos"), warnings.alias("warnings"),
    )


# --- hooks ------------------------------------------------------------------

def ref_class(ref: Column) -> Column:
    return (
        F.when(ref == "main", "rama main")
        .when(ref.rlike(r"\A[0-9a-f]{7,40}\z"), "SHA fijado")
        .otherwise(F.concat(F.lit("tag/rama "), ref))
    )


def hook_audit(hooks: DataFrame, workflow: str) -> DataFrame:
    """(repo, has_hook, ref, ref_type, inherits_secrets, engine_ref, coherent).

    ``workflow`` is the path of the shared workflow that hooks call.
    """
    text = F.col("text")
    quoted = r"\Q" + workflow + r"\E"
    ref = blank_to_null(F.regexp_extract(text, rx(rf"uses:\s*{quoted}@(\S+)"), 1))
    engine = blank_to_null(F.regexp_extract(text, rx(r"engine_ref:\s*(\S+)"), 1))
    present = text.isNotNull()
    return hooks.select(
        "repo", present.alias("has_hook"), ref.alias("ref"),
        F.when(ref.isNotNull(), ref_class(ref)).alias("ref_type"),
        text.contains("secrets: inherit").alias("inherits_secrets"), engine.alias("engine_ref"),
        F.when(present, F.coalesce(engine == ref, F.lit(False))).alias("coherent"),
    )


def hook_drift(repos: DataFrame, hooks: DataFrame, desired: str, create_missing: bool = False) -> DataFrame:
    """(repo, state): the installed hook against the desired text."""
    joined = repos.select("repo").join(hooks.select("repo", "text"), "repo", "left")
    same = normalize_newlines(F.col("text")) == normalize_newlines(F.lit(desired))
    state = (
        F.when(F.col("text").isNull(), "would_install" if create_missing else "missing")
        .when(same, "current")
        .otherwise("differs")
    )
    return joined.select("repo", state.alias("state"))
