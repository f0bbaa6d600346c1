"""Text primitives as Column expressions.

Every primitive stays inside one row: no shuffle, no Python worker. Patterns
are compiled in the dialect closest to Python ``re`` on ``str``: Unicode
character classes (``U``) and ``\\n`` as the only line terminator (``d``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of Python's str.strip()/split(): Unicode White_Space plus U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
LINE_SPACE = r"[\s\x1c-\x1f&&[^\n]]"

# Separators of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Items folded at once by ``scanned``: appending to a short array is cheap.
SCAN_BLOCK = 128


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Python-like semantics; ``flags`` may hold i, m, s, x."""
    return f"(?Ud{flags}){pattern}"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column) -> Column:
    return F.when(value != F.lit(""), value)


def strip(value: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(value, rx(rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z"), "")


def rstrip(value: Column) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(value, rx(rf"(?<!{SPACE}){SPACE}++\z"), "")


def lines_of(text: Column) -> Column:
    """Python ``splitlines()``: no trailing empty element."""
    parts = F.split(text, LINE_BREAK, -1)
    last_blank = F.element_at(parts, -1) == F.lit("")
    return F.when(last_blank, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def find_line(text: Column, needle: Column) -> Column:
    """1-based line of the first literal occurrence, null when absent."""
    position = F.position(needle, text)
    return F.when(position > 0, newline_count(F.substr(text, F.lit(1), position - 1)) + 1)


def column_name(value: str | Column) -> str:
    """The name of a column given by its name or as ``F.col`` of it."""
    return value if isinstance(value, str) else repr(value)[len("Column<'"):-len("'>")]


def literal(value: str) -> str:
    """A string as a SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def scanned(items: str, zero: str, step: str, kind: str) -> str:
    """SQL for the states (of type ``kind``) after each item of a left fold, in order; ``step`` names the state before ``s.last`` and the item ``x``.

    Appending to an array copies it, so items are folded in blocks and the blocks joined: n items cost about n * SCAN_BLOCK / 2 + (n / SCAN_BLOCK)^2 / 2 copies.
    One string is parsed at once; built from columns, an expression of this size costs the driver a quarter of a second.
    """
    one = f"transform(array(CAST({step} AS {kind})), z -> named_struct('last', z, 'out', concat(s.out, array(z))))[0]"
    block = (
        f"aggregate(part, named_struct('last', acc.last, 'out', CAST(array() AS array<{kind}>)), (s, x) -> {one}, "
        "s -> named_struct('last', s.last, 'out', concat(acc.out, array(s.out))))"
    )
    cut = f"transform(sequence(1, greatest(size(every), 1), {SCAN_BLOCK}), at -> slice(every, at, {SCAN_BLOCK}))"
    first = f"named_struct('last', CAST({zero} AS {kind}), 'out', CAST(array() AS array<array<{kind}>>))"
    return f"transform(array({items}), every -> aggregate({cut}, {first}, (acc, part) -> {block}, acc -> flatten(acc.out)))[0]"


def newlines(value: str) -> str:
    return f"(length({value}) - length(replace({value}, '\\n', '')))"


def matches(text: str | Column, pattern: str, groups: dict[str, int]) -> Column:
    """All matches in the column ``text`` (its name, or ``F.col`` of it) as array<struct<line, *groups>>, null where there are none.

    Two passes whatever the number of groups: the gaps between matches and the whole matches, which give the
    places, and each group is taken from its short match. Both passes walk the text leftmost and without overlap, so they align;
    no pattern may look beyond its match for more than a word boundary. Unmatched optional groups are the empty string.
    """
    return F.expr(match_sql(column_name(text), pattern, groups))


def match_sql(text: str, pattern: str, groups: dict[str, int]) -> str:
    """SQL of :func:`matches`; ``text`` may be any SQL that is cheap to name twice."""
    p = literal(pattern)
    found = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"
    lines = f"transform(m, v -> named_struct('before', {newlines('v.`0`')}, 'inside', coalesce({newlines('v.`1`')}, 0)))"
    placed = scanned(lines, "named_struct('line', 1, 'next', 1)", "named_struct('line', s.last.next + x.before, 'next', s.last.next + x.before + x.inside)", "struct<line:int,next:int>")
    fields = ", ".join(f"'{name}', " + ("w.`1`" if number == 0 else f"regexp_extract(w.`1`, {p}, {number})") for name, number in groups.items())
    shaped = f"zip_with(slice(m, 1, size(m) - 1), slice({placed}, 1, size(m) - 1), (w, at) -> named_struct('line', at.line{', ' + fields if fields else ''}))"
    return f"CASE WHEN {text} rlike {p} THEN transform(array({found}), m -> {shaped})[0] END"


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """struct<line, value> of the first match, null when there is none.

    ``rlike`` stops at the first hit, so a text without one costs one scan.
    """
    return F.when(
        text.rlike(pattern),
        F.struct(first_line(text, pattern).alias("line"), F.regexp_extract(text, pattern, group).alias("value")),
    )


def first_line(text: Column, pattern: str) -> Column:
    """Line of the first match; the text must have one."""
    return newline_count(F.element_at(F.split(text, pattern, 2), 1)) + 1


def fold(text: Column) -> Column:
    """Lower case, with the two letters that only case-insensitive matching equates."""
    return F.translate(F.lower(text), "\u017f\u212a", "sk")


def literal_core(pattern: str) -> str | None:
    """The literal behind ``\\bword\\b`` or a plain literal pattern, lower-cased."""
    core = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return core.lower() if re.fullmatch(r"[\w@/ -]+", core) else None


def may_match(folded: Column, patterns: tuple[str, ...]) -> Column:
    """Necessary condition for any of the case-insensitive patterns: a cheap substring test."""
    cores = [literal_core(p) for p in patterns]
    return F.lit(True) if None in cores else contains_any(folded, cores)


def match_all(df: DataFrame, text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """Explode :func:`matches` into rows: ``n`` (0-based), ``line`` and the groups."""
    kept = [c for c in df.columns if c != text]
    exploded = df.select(*kept, F.posexplode(matches(text, pattern, groups)).alias("n", "m"))
    return exploded.select(*kept, "n", "m.*")


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line with its 1-based number."""
    kept = [c for c in df.columns if c != text]
    exploded = df.select(*kept, F.posexplode(lines_of(F.col(text))).alias("n", "value"))
    return exploded.select(*kept, (F.col("n") + 1).alias("line"), "value")


def normalize_text(text: Column) -> Column:
    """CRLF to LF, every line right-trimmed, then the whole text trimmed."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    trimmed = F.regexp_replace(unix, rx(rf"(?<!{LINE_SPACE}){LINE_SPACE}++(?=\n|\z)"), "")
    return strip(trimmed)


def text_sha12(text: Column) -> Column:
    """First 12 hexadecimal digits of the sha256 of the normalized text."""
    return F.substring(F.sha2(normalize_text(text), 256), 1, 12)


def normalize_newlines(text: Column) -> Column:
    """CRLF to LF, trimmed, exactly one final newline."""
    return F.concat(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), F.lit("\n"))


def normalize_command(command: Column) -> Column:
    """Cut a trailing shell comment and collapse white space."""
    body = F.regexp_replace(strip(command), rx(r"\A((?:(?! #)[\s\S])*+) #[\s\S]*+\z"), "$1")
    return strip(F.regexp_replace(body, rx(f"{SPACE}+"), " "))


def strip_fence(text: Column, languages: tuple[str, ...] = ("markdown", "md")) -> Column:
    """Drop one outer code fence, bare or of one of the languages."""
    body = strip(text)
    opened = body.startswith("```")
    inner = strip(F.regexp_replace(body, rf"\A```(?:{'|'.join(languages)})?", ""))
    closed = strip(F.regexp_replace(inner, r"```\z", ""))
    return F.when(opened, closed).otherwise(body)


def literal_map(mapping: dict[str, str]) -> Column:
    """A dictionary as a constant-folded map literal: a lookup without a join."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, str | None], key: Column) -> Column:
    known = {k: v for k, v in mapping.items() if v is not None}
    return F.try_element_at(literal_map(known), key)


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    condition = F.lit(False)
    for needle in needles:
        condition = condition | text.contains(needle)
    return condition


def first_needle(text: Column, pairs: tuple[tuple[str, str], ...], default: str | None) -> Column:
    """The value of the first needle contained in the text, in the given order."""
    result = None
    for needle, value in pairs:
        test = text.contains(needle)
        result = F.when(test, F.lit(value)) if result is None else result.when(test, F.lit(value))
    return result.otherwise(F.lit(default))
