"""Evidence extraction: one scan of the corpus, one explode, no shuffle.

Each extractor is a Column expression over ``content`` giving
array<struct<kind, value, method, line>>. ``signals`` chooses the extractors of
the row's language, concatenates their arrays and explodes once.

The Python extractors are line-anchored patterns, not a syntax tree: files that
do not parse still report. Imports are read from the code alone, without strings and comments.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.text import blank_to_null, fold, literal, literal_core, match_sql, matches, newlines, rx, strip, strip_fence
from fleetlens.sources.corpus import analysis_scope

ITEM = "array<struct<kind:string,value:string,method:string,line:int>>"


@dataclass(frozen=True)
class Extractor:
    lang: str
    build: Callable[[str], list[Column]]


def _items(found: Column, kind: str, value, method=None) -> Column:
    shaped = F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            value(m).alias("value"),
            (method(m) if method else F.lit(None).cast("string")).alias("method"),
            m["line"].alias("line"),
        ),
    )
    return F.coalesce(shaped.cast(ITEM), F.array().cast(ITEM))


def _group1(kind: str, *patterns: str) -> Callable[[str], list[Column]]:
    """Extractor for patterns whose first group is the value."""
    def build(text: str) -> list[Column]:
        return [_items(matches(text, p, {"g1": 1}), kind, lambda m: m["g1"]) for p in patterns]

    return build


# --- Python -----------------------------------------------------------------

# Blanks inside a statement; a backslash at the end of a line joins the next one.
PY_GAP = r"(?:[ \t]++|\\\r?\n)*+"
PY_IMPORT = rx(rf"^[ \t]*+import(?=[ \t\\]){PY_GAP}([\w.]++(?:{PY_GAP}(?:,{PY_GAP}[\w.]++|as\b{PY_GAP}\w++))*+)", "m")
PY_FROM = rx(rf"^[ \t]*+from(?=[ \t\\.]){PY_GAP}\.*+{PY_GAP}([^\W\d][\w.]*+)(?=[ \t\\]){PY_GAP}import\b", "m")
# What the reader of a program skips: strings over several lines, strings in one line, comments. Possessive, so a long string costs no stack.
PY_OPAQUE = (
    r"\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\"|\z)|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)"
    r"|\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?|#[^\n]*+"
)
PY_FUNCTION = rx(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", "m")
PY_CLASS = rx(r"^[ \t]*class[ \t]+(\w+)", "m")
PY_ROUTE = rx(r"@(\w+)\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]+)", "i")
PY_ENV = (
    rx(r"os\.getenv\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]"),
    rx(r"os\.environ\.get\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]"),
    rx(r"os\.environ\[\s*['\"]([A-Z][A-Z0-9_]*)['\"]"),
)


def python_code(text: str) -> str:
    """SQL for a Python text whose strings and comments are reduced to their line breaks.

    Only a string over several lines can hide an import at the start of a line, so a text without triple quotes is left as it is.
    """
    p = literal(PY_OPAQUE)
    pieces = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (code, skipped) -> concat(code, coalesce(regexp_replace(skipped, '[^\\\\n]++', ''), '')))"
    return f"CASE WHEN contains({text}, {literal('"' * 3)}) OR contains({text}, {literal("'" * 3)}) THEN array_join({pieces}, '') ELSE {text} END"


def _py_imports(text: str) -> list[Column]:
    """Modules of ``import a, b as c`` and ``from m import ...``; names are split, however many there are."""
    def each(pattern: str, value: str) -> Column:
        return F.expr(f"flatten(transform(array({python_code(text)}), code -> {value.replace('FOUND', match_sql('code', pattern, {'g1': 1}))}))")

    listed = f"transform(FOUND, m -> transform(split(m.g1, ','), n -> named_struct('line', m.line, 'g1', regexp_extract(n, {literal(rx(r'[\w.]+'))}, 0))))"
    names = F.flatten(each(PY_IMPORT, listed))
    return [_items(names, "import", lambda m: m["g1"]), _items(each(PY_FROM, "FOUND"), "import", lambda m: m["g1"])]


def _py_routes(text: str) -> list[Column]:
    found = matches(text, PY_ROUTE, {"verb": 2, "path": 3})
    return [_items(found, "route", lambda m: m["path"], lambda m: F.upper(m["verb"]))]


# --- JavaScript / TypeScript ------------------------------------------------

JS_IMPORT = (
    # What is imported holds neither a quote nor another import, so a text is passed over once.
    rx(r"import\s++(?:(?:(?!\bimport\b)[^'\"])*?(?<!\s)\s++from\s++)?['\"]([^'\"]+)['\"]"),
    rx(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
)
JS_EXPORT = rx(
    r"export\s+(?:default\s+)?(?:function|class|const|let|var)?\s*([A-Za-z_$][\w$]*)?"
)
JS_COMPONENT = rx(r"(?:function|const)\s+([A-Z][A-Za-z0-9_$]*)")
JS_FETCH = rx(r"fetch\s*\(\s*['\"`]([^'\"`]+)")
JS_AXIOS = rx(r"axios\.(get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)", "i")
JS_ROUTE = rx(r"(?:path|route)\s*[:=]\s*['\"]([^'\"]+)['\"]")
JS_ENV = rx(
    r"(?:import\.meta\.env|process\.env)"
    r"(?:\.([A-Z][A-Z0-9_]*)|\[[\"']([A-Z][A-Z0-9_]*)[\"']\])"
)


def _js_exports(text: str) -> list[Column]:
    named = F.filter(matches(text, JS_EXPORT, {"g1": 1}), lambda m: m["g1"] != F.lit(""))
    return [_items(named, "export", lambda m: m["g1"])]


def _js_api_calls(text: str) -> list[Column]:
    fetched = _items(
        matches(text, JS_FETCH, {"g1": 1}), "api_call", lambda m: m["g1"], lambda m: F.lit("FETCH")
    )
    axios = _items(
        matches(text, JS_AXIOS, {"verb": 1, "g2": 2}), "api_call",
        lambda m: m["g2"], lambda m: F.upper(m["verb"]),
    )
    return [fetched, axios]


def _js_env(text: str) -> list[Column]:
    found = matches(text, JS_ENV, {"g1": 1, "g2": 2})
    return [_items(found, "env_var", lambda m: F.coalesce(blank_to_null(m["g1"]), m["g2"]))]


# --- SQL --------------------------------------------------------------------

SQL_TABLE = (
    rx(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?([A-Za-z_][\w$.-]*)", "i"),
    rx(r"\b(?:FROM|JOIN|INTO|UPDATE)\s+[\"`]?([A-Za-z_][\w$.-]*)", "i"),
)
SQL_OPERATIONS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")

EXTRACTORS = {
    "py_imports": Extractor("python", _py_imports),
    "py_functions": Extractor("python", _group1("function", PY_FUNCTION)),
    "py_classes": Extractor("python", _group1("class", PY_CLASS)),
    "py_routes": Extractor("python", _py_routes),
    "py_env_vars": Extractor("python", _group1("env_var", *PY_ENV)),
    "js_imports": Extractor("javascript", _group1("import", *JS_IMPORT)),
    "js_exports": Extractor("javascript", _js_exports),
    "js_components": Extractor("javascript", _group1("component", JS_COMPONENT)),
    "js_api_calls": Extractor("javascript", _js_api_calls),
    "js_routes": Extractor("javascript", _group1("js_route", JS_ROUTE)),
    "js_env_vars": Extractor("javascript", _js_env),
    "sql_tables": Extractor("sql", _group1("table", *SQL_TABLE)),
}

LANGUAGES_OF = {
    "python": dims.PYTHON_LANGUAGES,
    "javascript": dims.SCRIPT_LANGUAGES,
    "sql": dims.SQL_LANGUAGES,
}


@cache
def signal_items(names: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """(language filter, lang label, array of items) over ``content`` and ``language``.

    Expressions are unresolved, so one build serves every DataFrame.
    """
    language = F.col("language")
    by_lang: dict[str, list[Column]] = {}
    for name in names:
        extractor = EXTRACTORS[name]
        by_lang.setdefault(extractor.lang, []).extend(extractor.build("content"))
    wanted = [x for lang in by_lang for x in LANGUAGES_OF[lang]]
    items, label = None, None
    for lang, arrays in by_lang.items():
        test = language.isin(*LANGUAGES_OF[lang])
        joined = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
        items = F.when(test, joined) if items is None else items.when(test, joined)
        label = F.when(test, F.lit(lang)) if label is None else label.when(test, F.lit(lang))
    return language.isin(*wanted), label, items


def signals(files: DataFrame, *names: str) -> DataFrame:
    """Long table (repo, file, lang, kind, value, method, line, third_party).

    Without names every extractor runs. Language and size are filtered before
    ``content`` is looked at.
    """
    chosen = names or tuple(EXTRACTORS)
    wanted, label, items = signal_items(chosen)
    scoped = analysis_scope(files).where(wanted)
    exploded = scoped.select(
        "repo", F.col("path").alias("file"), label.alias("lang"), "third_party", F.explode(items).alias("s")
    )
    return exploded.select("repo", "file", "lang", "s.kind", "s.value", "s.method", "s.line", "third_party")


def sql_operation_counts(files: DataFrame) -> DataFrame:
    """Whole-word counts of the seven SQL verbs, one row per file and verb."""
    scoped = analysis_scope(files).where(F.col("language").isin(*dims.SQL_LANGUAGES))
    counts = F.array(*[
        F.struct(
            F.lit(verb).alias("operation"),
            F.regexp_count(F.col("content"), F.lit(rx(rf"\b{verb}\b", "i"))).alias("n"),
        )
        for verb in SQL_OPERATIONS
    ])
    return scoped.select("repo", F.col("path").alias("file"), F.inline(counts))


# --- HTML assets ------------------------------------------------------------

def asset_pattern(tags: str = "script|link") -> str:
    return rx(rf"<(?:{tags})[^<>]*?(?:src|href)\s*=\s*[\"']([^\"']+)[\"']", "i")


def asset_items(content: str, needles=dims.ASSET_TO_TECH, tags: str = "script|link") -> Column:
    """array<struct<tech, asset, line>>: every needle of every asset URL."""
    known = [(n, t) for n, t in needles if t is not None]
    found = matches(content, asset_pattern(tags), {"asset": 1})

    def techs(m: Column) -> Column:
        hits = F.array(*[
            F.when(F.lower(m["asset"]).contains(n), F.struct(
                F.lit(t).alias("tech"), m["asset"].alias("asset"), m["line"].alias("line")))
            for n, t in known
        ])
        return F.array_compact(hits)

    return F.flatten(F.transform(found, techs))


def html_assets(files: DataFrame, needles=dims.ASSET_TO_TECH, tags: str = "script|link") -> DataFrame:
    """Technologies loaded by a script or link tag; HTML files only."""
    pages = files.where(F.col("language") == "HTML")
    return pages.select(
        "repo", F.col("path").alias("file"), "third_party",
        F.inline(asset_items("content", needles, tags)),
    )


# --- mentions ---------------------------------------------------------------

def mention_items(content: str, folded: str, patterns=dims.TECHNOLOGY_PATTERNS) -> Column:
    """array<struct<tech, line, pattern>>: first match of each pattern, null where there is none.

    Column ``folded`` is ``fold(content)``; a substring test on it spares the pattern
    search for most files.
    """
    hits = []
    for tech, alternatives in patterns.items():
        for p in alternatives:
            pattern, core = literal(rx(p, "i")), literal_core(p)
            likely = f"contains({folded}, {literal(core)}) AND " if core else ""
            before = f"element_at(split({content}, {pattern}, 2), 1)"
            item = f"named_struct('tech', {literal(tech)}, 'line', {newlines(before)} + 1, 'pattern', {literal(p)})"
            hits.append(f"CASE WHEN {likely}{content} rlike {pattern} THEN {item} END")
    return F.expr(f"array({', '.join(hits)})")


def mention_rows(files: DataFrame, patterns=dims.TECHNOLOGY_PATTERNS) -> DataFrame:
    """(repo, tech, file, line, pattern, weight): one row per file and pattern that matches."""
    weight = F.when(F.col("name").isin(*dims.PRIORITY_FILES), F.lit(10)).otherwise(F.lit(1))
    scoped = analysis_scope(files).withColumn("_folded", fold(F.col("content")))
    exploded = scoped.select(
        "repo", F.col("path").alias("file"), weight.alias("weight"),
        F.explode(mention_items("content", "_folded", patterns)).alias("m"),
    )
    return exploded.where("m is not null").select("repo", "m.tech", "file", "m.line", "m.pattern", "weight")


# --- documents --------------------------------------------------------------

def citation_items(text: str) -> Column:
    found = matches(text, rx(dims.CITATION), {"cited": 1, "cited_line": 2})
    return F.filter(found, lambda m: ~m["cited"].isin(*dims.NOT_A_CITATION))


def citation_extract(documents: DataFrame) -> DataFrame:
    """(repo, document, cited, cited_line, line): file citations of each document."""
    return documents.select("repo", "document", F.inline(citation_items("text"))).select(
        "repo", "document", "cited", blank_to_null(F.col("cited_line")).cast("int").alias("cited_line"), "line"
    )


def split_sections(responses: DataFrame) -> DataFrame:
    """(repo, n, document, text): sections of a response; of a repeated name the last one counts, the preamble is dropped."""
    text, mark = F.col("text"), rx(dims.SECTION_MARK, "m")
    names = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    bodies = F.split(text, mark, -1)
    bodies = F.slice(bodies, F.lit(2), F.size(bodies))
    zipped = F.arrays_zip(names.alias("document"), bodies.alias("body"))
    numbered = F.transform(zipped, lambda s, i: F.struct(i.alias("n"), s["document"].alias("document"), s["body"].alias("body")))
    last = F.filter(numbered, lambda s: s["n"] == F.size(names) - F.array_position(F.reverse(names), s["document"]))
    kept = [c for c in responses.columns if c not in ("text", "n", "document")]
    return responses.select(*kept, F.explode(last).alias("s")).select(
        *kept, F.col("s.n").alias("n"), F.col("s.document").alias("document"), strip(F.col("s.body")).alias("text")
    )


def parse_verdict(responses: DataFrame) -> DataFrame:
    """(repo, verdict, path, reason) from a tolerant JSON answer; invalid gives no rows."""
    entry = "array<struct<ruta:string,porque:string>>"
    parsed = F.from_json(strip_fence(F.col("text"), ("json",)), f"borrar {entry}, revisar {entry}")

    def labelled(name: str) -> Column:
        rows = F.coalesce(parsed[name], F.array().cast(entry))
        return F.transform(rows, lambda r: F.struct(
            F.lit(name).alias("verdict"), r["ruta"].alias("path"), r["porque"].alias("reason")))

    return responses.select("repo", F.inline(F.concat(labelled("borrar"), labelled("revisar"))))

