"""Equivalent SQL of every registered query that SQL can express.

Written for an engine with RE2 patterns, list functions and lambdas, apart from
the operators: only the fixed word lists and formats are shared.
"""

from __future__ import annotations

import re

from fleetlens import dims
from fleetlens.plans import derived as d
from fleetlens.plans.derived import q

SCOPE = "repo_"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def has(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {q(f'(?{flags})' * bool(flags) + pattern)})"


def nl(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def case(expr: str, mapping: dict[str, str | None], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items() if v is not None)
    return f"CASE {expr} {arms} ELSE {default} END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def found(source: str, where: str, pattern: str, groups: dict[str, int], keys: str, text: str = "content") -> str:
    """All matches of a pattern with their line, one row each."""
    p = q(pattern)
    alls = "".join(f", regexp_extract_all({text}, {p}, {n}) AS all_{g}" for g, n in groups.items())
    picks = "".join(f", all_{g}[i_] AS {g}" for g in groups)
    before = "array_to_string(f_[1:i_], '') || array_to_string(w_[1:i_ - 1], '')"
    return (
        f"SELECT {keys}, i_{picks}, {nl(before)} + 1 AS line FROM (SELECT *, unnest(range(1, len(w_) + 1)) AS i_ FROM ("
        f"SELECT {keys}, regexp_extract_all({text}, {p}, 0) AS w_, regexp_split_to_array({text}, {p}) AS f_{alls} "
        f"FROM {source} WHERE {where}))"
    )


def first(text: str, pattern: str) -> str:
    """Line of the first match of a pattern that does match."""
    return f"({nl(f'regexp_split_to_array({text}, {q(pattern)})[1]')} + 1)"


CTES: dict[str, str] = {}

CTES["tracked"] = (
    f"SELECT repo, path, CAST(length(content) AS BIGINT) AS size, content FROM ({d.select_sql('orders', d.CORPUS)})"
)
NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"
LANGUAGE = case(EXT, dims.LANGUAGE_OF_EXTENSION, "'Other'")
TEXT = f"({EXT} IN {names(dims.TEXT_EXTENSIONS)} OR {NAME} IN {names(dims.IMPORTANT_FILES)})"
THIRD = has("path", "|".join(dims.THIRD_PARTY_PATTERNS), "i")
EXCLUDED = has("path", "|".join(dims.EXCLUDED_PATH_PATTERNS), "i")
DEPTH = "(len(string_split(path, '/')) - 1)"
CTES["files"] = (
    f"SELECT repo, path, {NAME} AS name, {EXT} AS ext, {LANGUAGE} AS language, size, {TEXT} AS text, "
    f"{NAME} IN {names(dims.IMPORTANT_FILES)} AS important, {THIRD} AS third_party, content FROM tracked "
    f"WHERE NOT list_has_any(string_split(path, '/')[:-2], {array(dims.IGNORED_DIRS)}) "
    f"AND {NAME} NOT IN {names(dims.IGNORED_FILES)} AND NOT {EXCLUDED}"
)

SIGNAL_PARTS: dict[str, list[tuple[str, str, str, str, dict[str, int], str, str]]] = {
    # name -> (lang, languages, kind, pattern, groups, value, method)
    "py_functions": [("python", "Python", "function", r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", {"g": 1}, "g", "NULL")],
    "py_classes": [("python", "Python", "class", r"(?m)^[ \t]*class[ \t]+(\w+)", {"g": 1}, "g", "NULL")],
    "py_routes": [("python", "Python", "route", r"(?i)@(\w+)\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]+)", {"a": 2, "b": 3}, "b", "upper(a)")],
    "py_env_vars": [
        ("python", "Python", "env_var", p + r"\s*['\"]([A-Z][A-Z0-9_]*)['\"]", {"g": 1}, "g", "NULL")
        for p in (r"os\.getenv\s*\(", r"os\.environ\.get\s*\(", r"os\.environ\[")
    ],
    "js_imports": [
        ("javascript", "JS", "import", r"import\s+(?:[\s\S]*?\s+from\s+)?['\"]([^'\"]+)['\"]", {"g": 1}, "g", "NULL"),
        ("javascript", "JS", "import", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", {"g": 1}, "g", "NULL"),
    ],
    "js_exports": [("javascript", "JS", "export", r"export\s+(?:default\s+)?(?:function|class|const|let|var)?\s*([A-Za-z_$][\w$]*)?", {"g": 1}, "nullif(g, '')", "NULL")],
    "js_components": [("javascript", "JS", "component", r"(?:function|const)\s+([A-Z][A-Za-z0-9_$]*)", {"g": 1}, "g", "NULL")],
    "js_api_calls": [
        ("javascript", "JS", "api_call", r"fetch\s*\(\s*['\"`]([^'\"`]+)", {"g": 1}, "g", "'FETCH'"),
        ("javascript", "JS", "api_call", r"(?i)axios\.(get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)", {"a": 1, "b": 2}, "b", "upper(a)"),
    ],
    "js_routes": [("javascript", "JS", "js_route", r"(?:path|route)\s*[:=]\s*['\"]([^'\"]+)['\"]", {"g": 1}, "g", "NULL")],
    "js_env_vars": [("javascript", "JS", "env_var", r"(?:import\.meta\.env|process\.env)(?:\.([A-Z][A-Z0-9_]*)|\[[\"']([A-Z][A-Z0-9_]*)[\"']\])", {"a": 1, "b": 2}, "coalesce(nullif(a, ''), b)", "NULL")],
    "sql_tables": [
        ("sql", "SQL", "table", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?([A-Za-z_][\w$.-]*)", {"g": 1}, "g", "NULL"),
        ("sql", "SQL", "table", r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+[\"`]?([A-Za-z_][\w$.-]*)", {"g": 1}, "g", "NULL"),
    ],
}
LANGS = {"Python": "('Python')", "JS": names(dims.SCRIPT_LANGUAGES), "SQL": "('SQL')"}
IN_SCOPE = "text"


def part_sql(name: str) -> str:
    if name == "py_imports":
        item = r"[\w.]+(?:[ \t]+as[ \t]+\w+)?"
        listed = found("files", f"{IN_SCOPE} AND language = 'Python'", rf"(?m)^[ \t]*import[ \t]+({item}(?:[ \t]*,[ \t]*{item})*)", {"g": 1}, "repo, path, third_party")
        from_ = found("files", f"{IN_SCOPE} AND language = 'Python'", r"(?m)^[ \t]*from[ \t]+\.*[ \t]*([A-Za-z_][\w.]*)[ \t]+import\b", {"g": 1}, "repo, path, third_party")
        one = "regexp_extract(unnest(string_split(g, ',')), '[^ \\t]+')"
        return (
            f"SELECT repo, path AS file, 'python' AS lang, 'import' AS kind, {one} AS value, CAST(NULL AS VARCHAR) AS method, line, third_party FROM ({listed}) "
            f"UNION ALL SELECT repo, path, 'python', 'import', g, NULL, line, third_party FROM ({from_})"
        )
    selects = []
    for lang, languages, kind, pattern, groups, value, method in SIGNAL_PARTS[name]:
        rows = found("files", f"{IN_SCOPE} AND language IN {LANGS[languages]}", pattern, groups, "repo, path, third_party")
        selects.append(
            f"SELECT repo, path AS file, '{lang}' AS lang, '{kind}' AS kind, {value} AS value, "
            f"CAST({method} AS VARCHAR) AS method, line, third_party FROM ({rows}) WHERE ({value}) IS NOT NULL")
    return " UNION ALL ".join(selects)


for _name in ("py_imports", *SIGNAL_PARTS):
    CTES[f"s_{_name}"] = part_sql(_name)
CTES["signals"] = " UNION ALL ".join(f"SELECT * FROM s_{n}" for n in ("py_imports", *SIGNAL_PARTS))

# --- manifests

CTES["lns"] = (
    "SELECT repo, path, name, third_party, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS raw FROM ("
    "SELECT repo, path, name, third_party, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM ("
    f"SELECT repo, path, name, third_party, string_split(content, chr(10)) AS a FROM files WHERE name IN {names(dims.MANIFEST_KIND)}))"
)


def json_map(section: str, extra: str = "") -> str:
    line = "instr(content, '\"' || k || '\"')"
    at = f"CASE WHEN {line} > 0 THEN {nl(f'content[1:{line} - 1]')} + 1 END"
    return (
        f"SELECT repo, path AS file, name, third_party, k, json_extract_string(content, '$.{section}.\"' || k || '\"') AS v, "
        f"'{section}' AS section, {at} AS line FROM (SELECT *, unnest(json_keys(content, '$.{section}')) AS k FROM files "
        f"WHERE name = 'package.json'{extra})"
    )


NPM = ("dependencies", "devDependencies", "peerDependencies")
CTES["d_npm"] = " UNION ALL ".join(f"SELECT repo, file, third_party, k AS name, v AS version, section, line FROM ({json_map(s)})" for s in NPM)
REQ_NAME = "regexp_extract(l, '^[^<>=!~\\[; ]*')"
CTES["d_req"] = (
    f"SELECT repo, path AS file, third_party, {REQ_NAME} AS name, nullif({strip(f'substr(l, length({REQ_NAME}) + 1)')}, '') AS version, "
    f"'requirements' AS section, line FROM (SELECT *, {strip('raw')} AS l FROM lns WHERE name IN {names(dims.REQUIREMENTS_FILES)}) "
    f"WHERE l <> '' AND NOT regexp_matches(l, '^(#|-r|--)') AND {REQ_NAME} <> ''"
)
PYPROJECT = q(r"^[\"']?([A-Za-z0-9._-]+)[\"']?\s*[>=<~^]*\s*[\"']")
CTES["d_pyp"] = (
    f"SELECT repo, path AS file, third_party, n AS name, CAST(NULL AS VARCHAR) AS version, 'pyproject' AS section, line FROM ("
    f"SELECT *, regexp_extract({strip('raw')}, {PYPROJECT}, 1) AS n FROM lns WHERE name = 'pyproject.toml') "
    f"WHERE n <> '' AND lower(n) NOT IN {names(dims.PYPROJECT_METADATA)}"
)


def image_sql(where: str, pattern: str, section: str) -> str:
    return (
        f"SELECT repo, path AS file, third_party, n AS name, CAST(NULL AS VARCHAR) AS version, '{section}' AS section, line FROM ("
        f"SELECT *, regexp_extract(raw, {q(pattern)}, 1) AS n FROM lns WHERE {where}) WHERE n <> ''"
    )


CTES["d_doc"] = image_sql("name = 'Dockerfile'", r"(?i)^\s*FROM\s+(\S+)", "docker-image")
CTES["d_com"] = image_sql(f"name IN {names(dims.COMPOSE_FILES)}", r"^\s*image:\s*[\"']?([^\"'\s]+)", "compose-image")
KIND = case("regexp_extract(file, '[^/]*$')", dims.MANIFEST_KIND)
FDEPTH = "(len(string_split(file, '/')) - 1)"
CTES["deps_all"] = (
    f"SELECT repo, file, {KIND} AS kind, {FDEPTH} AS depth, third_party, name, version, section, line FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {c}" for c in ("d_npm", "d_req", "d_pyp", "d_doc", "d_com"))
    + f") WHERE NOT {has('file', dims.MANIFEST_IGNORED_PATH, 'i')}"
)
CTES["deps"] = "SELECT * EXCLUDE (third_party) FROM deps_all WHERE NOT third_party"
CTES["scripts"] = f"SELECT repo, file, k AS name, v AS command, line FROM ({json_map('scripts')}) WHERE NOT third_party"
CTES["mans"] = (
    f"SELECT repo, path, {case('name', dims.MANIFEST_KIND)} AS kind, third_party, {DEPTH} AS depth, "
    "CASE WHEN name = 'package.json' THEN json_extract_string(content, '$.name') END AS project_name FROM files "
    f"WHERE name IN {names(dims.MANIFEST_KIND)} AND NOT {has('path', dims.MANIFEST_IGNORED_PATH, 'i')}"
)

# --- technologies


def token_sql(x: str) -> str:
    cut = f"regexp_replace(lower({strip(x)}), '^@([^/]*/)?', '')"
    return strip(f"regexp_extract(regexp_extract({cut}, '^[^<>=!~\\^\\[; ]*'), '^[^.]*')")


def tech_sql(x: str) -> str:
    arms = " ".join(f"WHEN starts_with(lower({strip(x)}), {q(p)}) THEN {q(t)}" for p, t in dims.PREFIX_TO_TECH)
    return f"CASE {arms} ELSE {case(token_sql(x), dims.MODULE_TO_TECH)} END"


ASSET = r"(?i)<(?:script|link)[^>]*?(?:src|href)\s*=\s*[\"']([^\"']+)[\"']"
NEEDLES = [(n, t) for n, t in dims.ASSET_TO_TECH if t]


def assets_sql(source: str, where: str, pattern: str, needles, keys: str) -> str:
    rows = found(source, where, pattern, {"asset": 1}, keys, "content")
    values = ", ".join(f"({q(n)}, {q(t)})" for n, t in needles)
    return f"SELECT r.*, v.tech FROM ({rows}) r JOIN (VALUES {values}) v(needle, tech) ON contains(lower(r.asset), v.needle)"


CTES["assets"] = assets_sql("files", "language = 'HTML'", ASSET, NEEDLES, "repo, path, third_party")
CTES["ev_declared"] = (
    f"SELECT repo, tech, 0 AS rank, file, depth, line, detail, false AS third_party FROM ("
    f"SELECT repo, {tech_sql('name')} AS tech, file, depth, line, name AS detail FROM deps "
    f"UNION ALL SELECT repo, 'Node.js', path, depth, 1, 'package.json' FROM mans WHERE NOT third_party AND kind = 'npm' "
    f"UNION ALL SELECT repo, 'Docker', path, depth, 1, path FROM mans WHERE NOT third_party AND kind IN ('docker', 'compose')"
    ") WHERE tech IS NOT NULL"
)
CTES["ev_imported"] = (
    f"SELECT repo, tech, 1 AS rank, file, {FDEPTH} AS depth, line, value AS detail, third_party FROM ("
    f"SELECT *, {tech_sql('value')} AS tech FROM (SELECT * FROM s_py_imports UNION ALL SELECT * FROM s_js_imports)) WHERE tech IS NOT NULL"
)
CTES["ev_vendored"] = (
    f"SELECT repo, tech, 2 AS rank, path AS file, {DEPTH} AS depth, line, asset AS detail, third_party FROM assets"
)
MENTION_VALUES = [(t, p) for t, ps in dims.TECHNOLOGY_PATTERNS.items() for p in ps]
CTES["mentions"] = " UNION ALL ".join(
    f"SELECT repo, {q(t)} AS tech, path AS file, {first('content', '(?i)' + p)} AS line, {q(p)} AS pattern, "
    f"CASE WHEN name IN {names(dims.PRIORITY_FILES)} THEN 10 ELSE 1 END AS weight, third_party "
    f"FROM files WHERE {IN_SCOPE} AND {has('content', p, 'i')}"
    for t, p in MENTION_VALUES
)
CTES["ev_mentioned"] = f"SELECT repo, tech, 3 AS rank, file, {FDEPTH} AS depth, line, pattern AS detail, third_party FROM mentions"
CTES["ev"] = " UNION ALL ".join(f"SELECT * FROM ev_{p}" for p in dims.PROVENANCE_ORDER)
EV_ORDER = "rank, CASE WHEN rank = 0 THEN depth ELSE 0 END, file, line, detail"
CTES["ev_n"] = f"SELECT *, row_number() OVER (PARTITION BY repo, tech ORDER BY {EV_ORDER}) AS n, min(rank) OVER (PARTITION BY repo, tech) AS best FROM ev"
CTES["ev_kept"] = (
    "SELECT * FROM ev_n WHERE NOT (tech IN ('Node.js', 'Docker') AND rank = 0 AND n > 1) "
    "AND (rank < 3 OR (best = 3 AND n = 1))"
)
PROV = "['declared', 'imported', 'vendored', 'mentioned'][best + 1]"
CONF = "['high', 'high', 'medium', 'low'][best + 1]"
CTES["techs"] = (
    f"SELECT repo, tech, {PROV} AS provenance, {CONF} AS confidence, count(*) AS n_evidence, "
    "arg_min(file, n) AS file, arg_min(line, n) AS line, arg_min(detail, n) AS detail FROM ev_kept GROUP BY repo, tech, best"
)
CTES["hits"] = " UNION ALL ".join(
    f"SELECT repo, {q(c)} AS category, path AS file, {first('content', '(?i)' + p)} AS line, "
    f"lower(regexp_extract(content, {q('(?i)' + p)})) AS keyword, third_party FROM files "
    f"WHERE text AND NOT {has('path', dims.CAPABILITY_EXCLUDED_PATH, 'i')} AND {has('content', p, 'i')}"
    for c, p in ((c, "|".join(rf"\b{re.escape(w)}\b" for w in ws)) for c, ws in dims.CAPABILITY_KEYWORDS.items())
)
TECH_SUPPORT = ", ".join(f"({q(c)}, {q(t)})" for c, ts in dims.CAPABILITY_SUPPORT_TECH.items() for t in ts)
DEP_SUPPORT = ", ".join(f"({q(c)}, {q(t)})" for c, ts in dims.CAPABILITY_SUPPORT_DEPS.items() for t in ts)
CTES["corro"] = (
    "SELECT repo, category, arg_min(label, k || label) AS corroborated_by FROM ("
    f"SELECT repo, category, '0' AS k, 'tecnología ' || s.tech AS label FROM techs JOIN (VALUES {TECH_SUPPORT}) s(category, tech) "
    "ON techs.tech = s.tech WHERE provenance <> 'mentioned' UNION ALL "
    f"SELECT repo, category, '1', 'dependencia ' || s.dep FROM (SELECT repo, {token_sql('name')} AS n FROM deps "
    f"UNION SELECT repo, lower({strip('name')}) FROM deps) x JOIN (VALUES {DEP_SUPPORT}) s(category, dep) ON x.n = s.dep"
    ") GROUP BY repo, category"
)
CTES["caps"] = (
    "SELECT h.repo, h.category, CASE WHEN own >= 3 THEN 'medium' ELSE 'low' END AS confidence, own AS own_files, corroborated_by, keyword, file, line, third_party "
    "FROM (SELECT *, "
    "count(*) FILTER (NOT third_party) OVER (PARTITION BY repo, category) AS own FROM hits) h JOIN corro c USING (repo, category) WHERE own > 0"
)

# --- inventories
CTES["env"] = (
    "SELECT repo, value, file, line, lang FROM (SELECT *, row_number() OVER (PARTITION BY repo, value ORDER BY file, line) AS r FROM "
    "(SELECT * FROM s_py_env_vars UNION ALL SELECT * FROM s_js_env_vars)) WHERE r = 1"
)
CTES["api"] = (
    "SELECT DISTINCT repo, file, line, method, value AS path, CASE WHEN kind = 'route' THEN 'backend_route' ELSE 'frontend_api_call' END AS type "
    "FROM (SELECT * FROM s_py_routes UNION ALL SELECT * FROM s_js_api_calls)"
)
CTES["tabs"] = (
    "SELECT DISTINCT repo, file, line, value FROM s_sql_tables"
)
SCORE = " + ".join(f"CASE WHEN contains(lower(path), {q(w)}) THEN 1 ELSE 0 END" for w in dims.IMPORTANT_KEYWORDS)
CTES["important"] = (
    f"SELECT repo, path, CAST(score AS BIGINT) AS score FROM ("
    f"SELECT repo, path, {SCORE} + CASE WHEN lower(name) IN {names(dims.CORE_MANIFESTS)} THEN 10 ELSE 0 END + CASE WHEN important THEN 5 ELSE 0 END AS score FROM files) "
    "WHERE score > 0"
)
CTES["langs"] = (
    "SELECT repo, language, count(*) AS n FROM files WHERE language <> 'Other' GROUP BY ALL"
)

# --- personal data
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def emails_sql(source: str, keys: str, text: str) -> str:
    """(keys, e): distinct personal addresses; the 40 characters before are rebuilt from the pieces."""
    p = q(r"\b" + ADDRESS)
    before = "right(array_to_string(f_[1:i_], '') || array_to_string(w_[1:i_ - 1], ''), 40)"
    before = "right(array_to_string(list_transform(range(1, i_), lambda j: f_[j] || w_[j]), '') || f_[i_], 40)"
    return (
        f"SELECT DISTINCT {keys}, e FROM (SELECT {keys}, w_[i_] AS e, {before} AS b FROM (SELECT *, unnest(range(1, len(w_) + 1)) AS i_ FROM ("
        f"SELECT {keys}, regexp_extract_all({text}, {p}) AS w_, regexp_split_to_array({text}, {p}) AS f_ FROM {source}))) "
        f"WHERE NOT {has('e', dims.IMPERSONAL_EMAIL, 'i')} AND NOT regexp_matches(b, '(\\$|\\}}|:|//)\\s*$') "
        "AND NOT contains(regexp_extract(b, '(\\S+)\\s*$', 1), '://')"
    )


CTES["pii_files"] = (
    "SELECT repo, path, ext, size, text, third_party, content FROM files UNION ALL "
    "SELECT source, 'doc/d' || doc_id || '.txt', '.txt', length(text), true, false, text FROM documents"
)


def pii_cte(source: str) -> str:
    return (
        f"SELECT a.*, coalesce(m.correo, 0) AS correo FROM (SELECT repo, path, sha256(content) AS sha256, ext IN {names(dims.SPREADSHEET_EXTENSIONS)} AS sheet, "
        f"len(list_distinct(regexp_extract_all(content, {q(dims.RUT)}))) AS rut, "
        f"len(list_distinct(regexp_extract_all(content, {q(dims.PHONE_CL)}))) AS telefono, "
        f"len(list_distinct(list_transform(regexp_extract_all(content, {q('(?i)' + dims.SENSITIVE_FIELD)}), lambda x: lower(x)))) AS campos_sensibles, "
        f"list_sort(list_distinct(list_transform(regexp_extract_all(content, {q('(?i)' + dims.SPECIAL_CATEGORY)}), lambda x: lower(x)))) AS special, "
        f"{has('path', dims.TEST_PATH, 'i')} AS in_test_path FROM {source} WHERE NOT third_party AND (ext IN {names(dims.SPREADSHEET_EXTENSIONS)} OR text)) a "
        f"LEFT JOIN (SELECT repo, path, count(*) AS correo FROM ({emails_sql(source, 'repo, path', 'content')}) GROUP BY ALL) m USING (repo, path) "
        "WHERE sheet OR rut + telefono + coalesce(correo, 0) > 0"
    )


CTES["pii"] = pii_cte("files")
CTES["pii_both"] = pii_cte("pii_files")
PII_MARK = "CASE WHEN NOT sheet AND (in_test_path OR len(special) > 0) THEN '[VERIFICAR]' ELSE '[PENDIENTE]' END"
CTES["ignores"] = (
    "SELECT repo, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS pats "
    "FROM files WHERE path = '.gitignore'"
)
COVERED = (
    "coalesce(len(list_filter(pats, lambda p: starts_with(p, '/') AND (path = trim(p, '/') OR starts_with(path, trim(p, '/') || '/')))) > 0, false)"
)

# --- cleanup
CTES["modules"] = (
    "SELECT DISTINCT repo, string_split(regexp_extract(value, '[^/]*$'), '.')[1] AS stem FROM (SELECT * FROM s_py_imports UNION ALL SELECT * FROM s_js_imports)"
)
SUFFIXED = q(rf"^(.+?){dims.VARIANT_SUFFIX}$")
FOLDER = f"path[1:length(path) - length({NAME})]"
SUFFIX = f"regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)"
CTES["variants"] = (
    f"SELECT repo, path, size, base FROM (SELECT repo, path, size, {FOLDER} || regexp_extract({STEM}, {SUFFIXED}, 1) || {SUFFIX} AS base "
    f"FROM files WHERE regexp_matches({STEM}, {SUFFIXED})) v WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo = v.repo AND f.path = v.base)"
)
PROTECTED = has("path", "|".join(dims.PROTECTED_PATHS), "i")
ARTEFACT = has("path", dims.GENERATOR_ARTEFACT, "i")
RESIDUE = has("path", dims.BUILD_RESIDUE, "i")
ENTRY = has("content", "|".join(dims.ENTRY_POINTS), "m")


def unmentioned(source: str) -> str:
    return (
        f"SELECT s.* FROM ({source}) s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = s.repo AND f.text "
        f"AND f.stem <> s.stem AND contains(f.content, s.stem))"
    ).replace("files f", f"(SELECT *, {STEM} AS stem FROM files) f")


CTES["suspects"] = (
    f"SELECT repo, path, size, {STEM} AS stem FROM files WHERE NOT {PROTECTED} AND NOT {ARTEFACT} AND NOT {RESIDUE} AND NOT third_party AND text "
    f"AND ext NOT IN {names(dims.NON_CODE_EXTENSIONS)} AND NOT {ENTRY} AND {STEM} NOT IN {names(dims.CONVENTIONAL_STEMS)} "
    f"AND (repo, {STEM}) NOT IN (SELECT repo, stem FROM modules) AND (repo, path) NOT IN (SELECT repo, path FROM variants)"
)
CTES["cands"] = (
    f"SELECT repo, path, size, CASE WHEN {ARTEFACT} THEN 'artefacto del generador' ELSE 'resto de build o entorno' END AS category, 'alta' AS confidence "
    f"FROM tracked WHERE {ARTEFACT} OR ({RESIDUE} AND NOT {PROTECTED}) "
    f"UNION ALL SELECT repo, path, size, 'variante o respaldo', 'media' FROM variants WHERE NOT {PROTECTED} AND NOT {ARTEFACT} AND NOT {RESIDUE} "
    f"UNION ALL SELECT repo, path, size, 'huerfano aparente', 'media' FROM ({unmentioned('SELECT * FROM suspects')})"
)

# --- fleet
CTES["repos"] = d.select_sql("customer", d.REPOS)
CTES["hooks"] = d.select_sql("customer", d.HOOKS)
CTES["pulls"] = d.select_sql("orders", d.PULLS)
CTES["readmes"] = d.select_sql("documents", d.README)
USES = q(r"uses:\s*" + re.escape(d.WORKFLOW) + r"@(\S+)")
CTES["audit0"] = (
    f"SELECT repo, text, text IS NOT NULL AS has_hook, nullif(regexp_extract(text, {USES}, 1), '') AS ref, "
    "contains(text, 'secrets: inherit') AS inherits_secrets, nullif(regexp_extract(text, 'engine_ref:\\s*(\\S+)', 1), '') AS engine_ref FROM hooks"
)
REF_KIND = "CASE WHEN ref = 'main' THEN 'rama main' WHEN regexp_matches(ref, '^[0-9a-f]{7,40}$') THEN 'SHA fijado' ELSE 'tag/rama ' || ref END"
CTES["audit"] = (
    f"SELECT repo, has_hook, ref, CASE WHEN ref IS NOT NULL THEN {REF_KIND} END AS ref_type, inherits_secrets, engine_ref, "
    "CASE WHEN has_hook THEN coalesce(engine_ref = ref, false) END AS coherent FROM audit0"
)
CTES["latest"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY closed_at DESC, number DESC) AS rank FROM pulls WHERE state = 'closed' AND branch = 'bot/docs') WHERE rank <= 10"
)


def summary_sql(text: str, cut: bool = True) -> str:
    stripped = f"list_transform(string_split(CASE WHEN ends_with({text}, chr(10)) THEN left({text}, length({text}) - 1) ELSE {text} END, chr(10)), lambda l: {strip('l')})"
    kept = f"list_filter({stripped}, lambda l: l <> '' AND NOT starts_with(l, '![') AND NOT starts_with(l, '[!['))"
    if not cut:
        return kept
    kept += "[1:35]"
    return f"list_transform({kept}, lambda l: CASE WHEN length(l) > 240 THEN l[1:240] || '...' ELSE l END)"


CTES["root_readme"] = "SELECT repo, content AS text FROM files WHERE path = 'README.md' AND content <> ''"
CTES["health"] = (
    "SELECT h.*, readme_bytes < 200 OR coalesce(len(s) = 0 OR (len(s) = 1 AND ltrim(lower(s[1]), '# ') = lower(h.repo)), true) AS readme_placeholder FROM ("
    "SELECT repo, coalesce(max(size) FILTER (path = 'README.md'), 0) AS readme_bytes, bool_or(starts_with(upper(name), 'LICEN') OR upper(name) = 'COPYING') AS has_license, "
    "bool_or(regexp_matches(path, '^(tests|test|spec)/|/tests/|/__tests__/')) AS has_tests, bool_or(starts_with(path, '.github/workflows/')) AS has_ci, "
    "bool_or(name IN ('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml')) AS has_docker, bool_or(path = '.gitignore') AS has_gitignore, count(*) AS n_files "
    f"FROM files GROUP BY repo) h LEFT JOIN (SELECT repo, {summary_sql('text')} AS s FROM root_readme) r USING (repo)"
)
DEBT = (
    "CASE WHEN readme_bytes = 0 THEN 100 WHEN readme_placeholder THEN 80 WHEN readme_bytes < 1000 THEN 40 ELSE 0 END + CASE WHEN has_license THEN 0 ELSE 10 END "
    "+ CASE WHEN has_tests THEN 0 ELSE 10 END + CASE WHEN has_ci THEN 0 ELSE 5 END + CASE WHEN has_gitignore THEN 0 ELSE 5 END"
)
CTES["debts"] = f"SELECT *, CAST({DEBT} AS BIGINT) AS debt FROM health"
CTES["cards"] = "SELECT d.*, r.private, r.description, r.html_url FROM debts d JOIN repos r ON d.repo = r.name"

# --- claims
CTES["guides"] = "SELECT repo, content AS text FROM files WHERE ext = '.md'"
CTES["cmds"] = (
    "SELECT DISTINCT repo, value FROM ("
    "SELECT repo, unnest(['npm run ' || name, 'yarn ' || name, 'pnpm ' || name, 'npx ' || name, trim(regexp_replace(string_split(command, ' #')[1], '\\s+', ' ', 'g'))]) AS value FROM scripts "
    f"UNION ALL SELECT repo, unnest({array(dims.NPM_COMMANDS)}) FROM mans WHERE NOT third_party AND kind = 'npm' "
    "UNION ALL SELECT repo, unnest(['pip install -r ' || path, 'pip install -r requirements.txt']) FROM mans WHERE NOT third_party AND kind = 'python' AND ends_with(path, '.txt') "
    f"UNION ALL SELECT repo, unnest({array(dims.DOCKER_COMMANDS)}) FROM mans WHERE NOT third_party AND kind IN ('docker', 'compose')) WHERE value <> ''"
)
CTES["known"] = (
    "SELECT repo, 'env' AS kind, value FROM env UNION SELECT repo, 'endpoint', upper(method) || ' ' || path FROM api UNION SELECT repo, 'technology', tech FROM techs "
    "UNION SELECT repo, 'table', value FROM tabs UNION SELECT repo, 'command', value FROM cmds"
)
ALIASES = ", ".join(f"({q(a)}, {q(t)})" for a, t in dims.TECHNOLOGY_ALIASES)
COMMANDS = " UNION ALL ".join(
    f"SELECT repo, unnest(regexp_extract_all(text, {q('(?im)' + p)}, 1)) AS c FROM guides" for p in dims.COMMAND_CLAIMS
)
CTES["claimed"] = (
    f"SELECT DISTINCT repo, kind, value FROM (SELECT repo, 'env' AS kind, unnest(regexp_extract_all(text, {q(dims.ENV_CLAIM)}, 1)) AS value FROM guides) "
    f"WHERE contains(value, '_') AND value NOT IN {names(dims.IGNORED_ENV_NAMES)} "
    f"UNION SELECT repo, 'endpoint', upper(a) || ' ' || b FROM (SELECT repo, unnest(regexp_extract_all(text, {q('(?i)' + dims.ENDPOINT_CLAIM)}, 1)) AS a, "
    f"unnest(regexp_extract_all(text, {q('(?i)' + dims.ENDPOINT_CLAIM)}, 2)) AS b FROM guides) "
    f"UNION SELECT repo, 'technology', tech FROM guides JOIN (VALUES {ALIASES}) v(alias, tech) ON contains(lower(text), alias) "
    f"UNION SELECT repo, 'table', t FROM (SELECT repo, unnest(regexp_extract_all(text, {q(dims.TABLE_CLAIM)}, 1)) AS t FROM guides) WHERE lower(t) NOT IN {names(dims.GENERIC_WORDS)} AND NOT starts_with(lower(t), 'http') "
    f"UNION SELECT repo, 'command', x FROM (SELECT repo, trim(regexp_replace(string_split({strip('c')}, ' #')[1], '\\s+', ' ', 'g')) AS x FROM ({COMMANDS})) WHERE x <> ''"
)
CTES["unsupported"] = (
    "SELECT repo, kind, value, CASE WHEN kind = 'endpoint' THEN 'error' ELSE 'warning' END AS severity FROM claimed c "
    "WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = c.repo AND k.kind = c.kind AND k.value = c.value) "
    "AND (kind NOT IN ('table', 'command') OR EXISTS (SELECT 1 FROM known k WHERE k.repo = c.repo AND k.kind = c.kind))"
)


def structure_sql(source: str) -> str:
    parts = [f"SELECT repo, 'length' AS kind, 'too_short' AS value, 'error' AS severity FROM {source} WHERE length({strip('text')}) < 300"]
    parts += [f"SELECT repo, 'concept', {q(c)}, 'warning' FROM {source} WHERE NOT contains(lower(text), {q(c)})" for c in dims.REQUIRED_CONCEPTS]
    parts += [f"SELECT repo, 'uncertain', {q(c)}, 'warning' FROM {source} WHERE contains(lower(text), {q(c)})" for c in dims.UNCERTAIN_PHRASES]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


# --- derived documents
CTES["responses"] = d.select_sql("customer", d.RESPONSES)
SECTION = q("(?m)" + dims.SECTION_MARK)
CTES["sections"] = (
    f"SELECT repo, i_ - 1 AS n, names_[i_] AS document, {strip('parts_[i_ + 1]')} AS text FROM (SELECT *, unnest(range(1, len(names_) + 1)) AS i_ FROM ("
    f"SELECT repo, regexp_extract_all(text, {SECTION}, 1) AS names_, regexp_split_to_array(text, {SECTION}) AS parts_ FROM responses)) "
    "QUALIFY i_ = max(i_) OVER (PARTITION BY repo, names_[i_])"
)
CITES = found("sections", "true", dims.CITATION, {"cited": 1, "cl": 2}, "repo, document", "text")
CTES["cites"] = f"SELECT repo, document, cited, TRY_CAST(nullif(cl, '') AS BIGINT) AS cited_line, line FROM ({CITES}) WHERE cited NOT IN {names(dims.NOT_A_CITATION)}"
CTES["response_files"] = "SELECT r.repo, f.path, f.content FROM files f JOIN responses r ON f.repo = r.corpus_repo"
CTES["checked"] = (
    "SELECT repo, cited, EXISTS (SELECT 1 FROM response_files f WHERE f.repo = c.repo AND (f.path = c.cited OR regexp_extract(f.path, '[^/]*$') = regexp_extract(c.cited, '[^/]*$'))) AS valid "
    "FROM (SELECT DISTINCT repo, regexp_replace(replace(cited, chr(92), '/'), '^(\\./)*/*', '') AS cited FROM cites WHERE document <> 'INFORME') c"
)
RUTA = q(r"^\s*-?\s*ruta:\s*(.+?)\s*$")
CTES["carried"] = (
    "SELECT repo, document, line, value, last_value(p IGNORE NULLS) OVER (PARTITION BY repo, document ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM ("
    f"SELECT repo, document, line, value, nullif(trim(regexp_extract(value, {RUTA}, 1), '\"' || chr(39)), '') AS p FROM ("
    "SELECT repo, document, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS value FROM (SELECT repo, document, string_split(text, chr(10)) AS a FROM sections WHERE text <> '')))"
)
MISSING = "list_filter(['00-PROBLEMA.md', '01-SOLUCION.md', 'MANIFIESTO.yaml'], lambda x: NOT list_contains(list(document), x))"
CTES["missing"] = (
    "SELECT repo, array_to_string(list_filter(['00-PROBLEMA.md', '01-SOLUCION.md', 'MANIFIESTO.yaml'], lambda x: NOT list_contains(ds, x)), '|') AS missing "
    "FROM (SELECT repo, list(document) AS ds FROM sections GROUP BY repo)"
)

# --- contract
NORM_LINES = "regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '(?m)[ \\t\\r\\f\\v]+$', '', 'g')"


def norm(x: str) -> str:
    return strip(NORM_LINES.format(x))


BEGIN = r"(?i)<!--\s*AI:BEGIN\s+id=([\w.-]+)(?:\s+sha=([0-9a-f]+))?\s*-->"
END = r"(?i)<!--\s*AI:END(?:\s+id=([\w.-]+))?\s*-->"
# Markers with their offsets; each BEGIN takes the first END that starts after it.
CTES["begins"] = (
    f"SELECT repo, text, i_, id, sha, w_[i_] AS marker, length(array_to_string(f_[1:i_], '')) + length(array_to_string(w_[1:i_ - 1], '')) AS pos_ FROM ("
    f"SELECT *, unnest(range(1, len(w_) + 1)) AS i_, unnest(regexp_extract_all(text, {q(BEGIN)}, 1)) AS id, unnest(regexp_extract_all(text, {q(BEGIN)}, 2)) AS sha FROM ("
    f"SELECT repo, text, regexp_extract_all(text, {q(BEGIN)}) AS w_, regexp_split_to_array(text, {q(BEGIN)}) AS f_ FROM readmes))"
)
CTES["blocks"] = (
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY pos_) - 1 AS n, id, nullif(sha, '') AS sha, {nl('text[1:pos_]')} + 1 AS begin_line, marker, rest, "
    f"regexp_split_to_array(rest, {q(END)})[1] AS content FROM (SELECT *, text[pos_ + length(marker) + 1:] AS rest FROM begins) WHERE regexp_matches(rest, {q(END)})"
)
MARK = r"(?i)<!--\s*ai-readme-fingerprint:\s*sha256:([0-9a-f]{8,64})\s*-->"
SHORT = f"length({norm('text')}) < 200"
TITLE_ONLY = f"{strip(f'''regexp_replace({norm('text')}, '(?im)^#\\s*' || repo || '\\s*$', '')''')} = ''"
ACTION = (
    f"CASE WHEN regexp_matches(text, '(?i)<!--\\s*ai-readme:lock\\s*-->') THEN 'bloqueado' WHEN regexp_matches(text, {q(BEGIN)}) THEN 'fusionado' "
    f"WHEN {SHORT} OR {TITLE_ONLY} THEN 'creado' ELSE 'respetado' END"
)
CTES["current"] = f"SELECT repo, CASE WHEN CAST(string_split(repo, '_')[2] AS BIGINT) % 2 = 0 THEN {q(d.SEAL)} ELSE sha256(repo) END AS sha FROM readmes"
CTES["gates"] = (
    f"SELECT c.repo, previous, c.sha, CASE WHEN previous IS NULL THEN 'sin_sello' WHEN previous = c.sha THEN 'sin_cambios' ELSE 'cambio' END AS gate, coalesce(previous = c.sha, false) AS skip "
    f"FROM current c LEFT JOIN (SELECT repo, nullif(regexp_extract(text, {q(MARK)}, 1), '') AS previous FROM readmes) r USING (repo)"
)
CTES["config"] = d.select_sql("customer", d.CONFIG)
CTES["conf"] = "SELECT repo, raw, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM config"
UNKNOWN = f"array_to_string(list_sort(list_filter(json_keys(j), lambda k: NOT list_contains({array(dims.CONFIG_KEYS)}, k))), '{{0}}')"

ORACLES: dict[str, str] = {}


def sql(body: str) -> str:
    """The body with the WITH clause of every table it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return f"WITH {head} {body}" if needed else body


def add(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


ROUTE = r"(?i)@(\w+)\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]+)"
add("match_all", "SELECT repo, path, i_ - 1 AS n, line, verb, route FROM (" + found("files", "language = 'Python'", ROUTE, {"verb": 2, "route": 3}, "repo, path") + ")")
FM = r"(?i)\b(react|flask|leaflet)\b"
add("first_match", f"SELECT repo, path, {first('content', FM)} AS line, regexp_extract(content, {q(FM)}) AS value FROM files WHERE regexp_matches(content, {q(FM)})")
add("find_line", f"SELECT doc_id, CASE WHEN instr(text, 'an') > 0 THEN {nl('text[1:instr(text, {0}) - 1]'.format(q('an')))} + 1 END AS line FROM documents")
SPLITLINES = q("\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]")
add("text_lines", f"SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS value FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, regexp_split_to_array(text, {SPLITLINES}) AS a FROM documents))")
add("normalize_text", f"SELECT doc_id, sha256({norm('text')}) AS sha FROM documents")
add("text_sha12", f"SELECT doc_id, left(sha256({norm('text')}), 12) AS sha12 FROM documents")
add("normalize_newlines", f"SELECT doc_id, sha256({strip('replace(text, chr(13) || chr(10), chr(10))')} || chr(10)) AS sha FROM documents")
add("dedupe_first", "SELECT repo, value, min(struct_pack(f := file, l := line)).f AS file, min(struct_pack(f := file, l := line)).l AS line FROM s_sql_tables GROUP BY repo, value")
add("scan_corpus", "SELECT * EXCLUDE (content) FROM files")
add("read_content", "SELECT doc_id, sha256(regexp_replace(replace(text, '�', ''), '\\r\\n?', chr(10), 'g') || chr(10) || 'A' || chr(10) || 'B') AS sha FROM documents")
add("file_sha256", "SELECT repo, path, sha256(content) AS sha256 FROM tracked")
add("collect_incremental", "SELECT name FROM repos WHERE name NOT IN (SELECT repo FROM files)")
add("path_excluded", f"SELECT repo, path, {EXCLUDED} OR path IN ('docs', 'LICENSE') OR starts_with(path, 'docs/') OR starts_with(path, 'LICENSE/') AS excluded FROM tracked")
add("path_third_party", f"SELECT repo, path, {THIRD} AS third_party FROM tracked")
add("language_of", f"SELECT repo, path, {LANGUAGE} AS language FROM tracked")
add("is_text_file", f"SELECT repo, path, {TEXT} AS text FROM tracked")
add("analysis_scope", "SELECT repo, path, size FROM files WHERE text")
add("in_scope_repo", "SELECT repo, starts_with(lower(repo), 'repo_') AS in_scope FROM hooks")
add("active_repo", "SELECT name FROM repos WHERE NOT archived AND NOT disabled AND NOT fork AND name NOT IN ('repo_1', 'repo_2')")
add("size_gate", "SELECT name, size, CASE WHEN size > 300000 THEN 'over_limit:' || CAST(round_even(size / 1024, 0) AS BIGINT) || ' of 293 MB' END AS omitted_reason FROM repos")
add("test_path", f"SELECT repo, path, {has('path', dims.TEST_PATH, 'i')} AS test FROM tracked")
add("protected_path", f"SELECT repo, path, {PROTECTED} AS protected FROM tracked")
add("entry_point", f"SELECT repo, path, {ENTRY} AS entry FROM files")
add("conclusive_only", "SELECT repo, tech, provenance, confidence FROM techs WHERE provenance <> 'mentioned'")
CTES["deployment"] = f"SELECT repo, path FROM files WHERE {' OR '.join(f'contains(lower(path), {q(t)})' for t in dims.DEPLOYMENT_TOKENS)}"
add("deployment_files", "SELECT * FROM deployment")
add("gitignore_anchored", f"SELECT repo, path, {COVERED} AS ignored FROM tracked LEFT JOIN ignores USING (repo)")
for _name in ("py_imports", *SIGNAL_PARTS):
    add(_name, f"SELECT * EXCLUDE (third_party) FROM s_{_name}")
OPS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
add("sql_operation_counts", " UNION ALL ".join(f"SELECT repo, path AS file, '{o}' AS operation, len(regexp_extract_all(content, '(?i)\\b{o}\\b')) AS n FROM files WHERE {IN_SCOPE} AND language = 'SQL'" for o in OPS))
CTES["crawled"] = "SELECT 'pages' AS repo, 'p' || page_id || '.html' AS path, html AS content FROM pages"
WIDE = ASSET.replace("script|link", "script|link|a")
add("html_assets", "SELECT repo, path AS file, third_party, tech, asset, line FROM assets UNION ALL SELECT repo, path, false, tech, asset, line FROM ("
    + assets_sql("crawled", "true", WIDE, (("the", "The"), ("example", "Example")), "repo, path") + ")")
add("tech_mentions", "SELECT repo, tech, CAST(sum(weight) AS BIGINT) AS total, CASE WHEN sum(weight) >= 10 THEN 'high' WHEN sum(weight) >= 3 THEN 'medium' ELSE 'low' END AS confidence, "
    "count(*) AS n, arg_min(file, r) AS file, arg_min(line, r) AS line FROM (SELECT *, row_number() OVER (PARTITION BY repo, tech ORDER BY file, line, pattern) AS r FROM mentions) GROUP BY repo, tech")
add("citation_extract", "SELECT * FROM cites")
add("split_sections", "SELECT repo, n, document, text FROM sections")
CTES["replies"] = d.select_sql("customer", d.REPLIES)
CTES["replied"] = "SELECT repo, CASE WHEN json_valid(t) THEN t END AS j FROM (SELECT repo, regexp_replace(text, '^```json\\s*|\\s*```$', '', 'g') AS t FROM replies)"
add("parse_verdict", " UNION ALL ".join(
    f"SELECT repo, '{v}' AS verdict, x->>'ruta' AS path, x->>'porque' AS reason FROM (SELECT repo, unnest(CAST(json_extract(j, '$.{v}') AS JSON[])) AS x FROM replied)" for v in ("borrar", "revisar")))
add("strip_fence", f"SELECT doc_id, sha256({strip('text')}) AS sha FROM documents")
add("discover_manifests", "SELECT m.repo, m.path, m.kind, m.third_party, m.depth, m.project_name, coalesce(a.n, 0) AS n_dependencies, coalesce(s.n, 0) AS n_scripts FROM mans m "
    "LEFT JOIN (SELECT repo, file, count(*) AS n FROM deps_all GROUP BY ALL) a ON m.repo = a.repo AND m.path = a.file LEFT JOIN (SELECT repo, file, count(*) AS n FROM scripts GROUP BY ALL) s ON m.repo = s.repo AND m.path = s.file")
for _key, _names in (("npm_dependencies", ("package.json",)), ("requirements_dependencies", dims.REQUIREMENTS_FILES), ("pyproject_dependencies", ("pyproject.toml",)),
                     ("docker_images", ("Dockerfile",)), ("compose_images", dims.COMPOSE_FILES)):
    add(_key, f"SELECT repo, file, kind, name, version, section, line FROM deps_all WHERE regexp_extract(file, '[^/]*$') IN {names(_names)}")
add("npm_scripts", "SELECT repo, file, name, command, line FROM scripts")
add("declared_dependencies", "SELECT repo, file, kind, depth, name, version, section, line FROM deps")
add("root_dependencies", "SELECT repo, file, 'npm' AS ecosystem, name, version, section, CAST(NULL AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, name ORDER BY "
    "CASE section WHEN 'peerDependencies' THEN 0 WHEN 'devDependencies' THEN 1 ELSE 2 END) AS r FROM d_npm WHERE file = 'package.json') WHERE r = 1 "
    f"UNION ALL SELECT repo, path, 'python', {strip('raw')}, NULL, NULL, line FROM lns WHERE path IN ('requirements.txt', 'requirements-dev.txt') AND {strip('raw')} <> '' AND NOT starts_with({strip('raw')}, '#')")
add("normalize_token", f"SELECT repo, file, line, name, {token_sql('name')} AS token FROM deps")
add("tech_for", f"SELECT repo, file, line, name, {tech_sql('name')} AS tech FROM deps")
add("tech_declared", f"SELECT repo, tech, file, line, detail FROM (SELECT *, row_number() OVER (PARTITION BY repo, tech ORDER BY {EV_ORDER}) AS n FROM ev_declared) WHERE NOT (tech IN ('Node.js', 'Docker') AND n > 1)")
add("tech_imported", "SELECT repo, tech, file, line, detail FROM ev_imported")
add("tech_mentioned_only", "SELECT repo, tech, file, line FROM techs WHERE provenance = 'mentioned'")
add("capability_corroboration", "SELECT * FROM corro")
add("pii_ignore_status", f"SELECT repo, path, {PII_MARK} AS mark, {COVERED} AS ignored_anchored FROM pii LEFT JOIN ignores USING (repo)")
add("orphan_by_import", f"SELECT repo, path, {STEM} AS stem FROM files WHERE (repo, {STEM}) NOT IN (SELECT repo, stem FROM modules)")
add("orphan_by_mention", "SELECT repo, path, stem FROM (" + unmentioned("SELECT * FROM suspects") + ")")
add("variant_of", "SELECT repo, path, size, base FROM variants")
add("verdict_join", "SELECT repo, path, size, category, confidence, CASE WHEN v = 'borrar' THEN 'borrar' ELSE 'revisar' END AS verdict, CASE WHEN v IS NULL THEN "
    "'no_verdict:' || category ELSE 'leido' END AS reason FROM cands "
    "LEFT JOIN (SELECT repo, path, CASE WHEN contains(path, '7') THEN 'borrar' ELSE 'revisar' END AS v FROM tracked WHERE ends_with(path, '_old.py')) USING (repo, path)")
add("citation_check", "SELECT repo, cited, valid FROM checked")
add("manifest_seal", "SELECT repo, document, string_agg(CASE WHEN regexp_matches(value, '^\\s*sha256:') AND c.path IS NOT NULL THEN regexp_extract(value, '^\\s*') || 'sha256: \"' || coalesce(sha256(content), '[PENDIENTE] sin calcular') || '\"' ELSE value END, chr(10) ORDER BY line) || chr(10) AS text "
    "FROM carried c LEFT JOIN response_files f USING (repo, path) WHERE document = 'MANIFIESTO.yaml' GROUP BY repo, document")
CTES["shown"] = "SELECT name AS repo, private, description FROM repos WHERE NOT private OR ends_with(name, '13')"
add("leak_check", "SELECT DISTINCT 'private name published' AS problem, p.name AS repo FROM repos p JOIN shown s ON p.private AND contains(lower(s.repo || ' ' || s.description), p.name) AND regexp_matches(s.repo || ' ' || s.description, '(?i)(^|[^A-Za-z0-9_])' || p.name || '([^A-Za-z0-9_]|$)') "
    "UNION SELECT 'private card published', repo FROM shown WHERE private")
add("prior_rejection", "SELECT DISTINCT repo FROM latest WHERE merged_at IS NULL")
CTES["open_pulls"] = d.select_sql("orders", d.OPEN_PULLS)
add("residual_prs", "SELECT o.repo, o.url FROM open_pulls o JOIN audit a ON o.repo = a.repo WHERE o.state = 'open' AND o.branch = 'bot/docs' AND a.has_hook AND NOT starts_with(lower(a.repo), 'repo_')")
add("provenance_rank", "SELECT * FROM techs")
add("ranked_evidence", "SELECT repo, tech, CAST(rank AS BIGINT) AS rank, file, line, detail, third_party FROM ev_kept")
add("capability_signals", "SELECT * FROM caps")
add("env_inventory", "SELECT * FROM env")
add("api_inventory", "SELECT * FROM api")
add("table_inventory", "SELECT * FROM tabs")
CTES["roots"] = "SELECT repo, string_split(path, '/')[1] AS root, count(*) AS n FROM files GROUP BY ALL"
add("structure_counts", "SELECT * FROM roots")
add("language_counts", "SELECT * FROM langs")
PII_ROWS = (f"SELECT repo, path, sha256, CASE WHEN sheet THEN 'planilla' ELSE 'patrones de dato personal' END AS reason, CASE WHEN sheet THEN 0 ELSE rut END AS rut, CASE WHEN sheet THEN 0 ELSE correo END AS correo, "
    f"CASE WHEN sheet THEN 0 ELSE telefono END AS telefono, CASE WHEN sheet THEN 0 ELSE campos_sensibles END AS campos_sensibles, in_test_path, CASE WHEN sheet THEN '' ELSE array_to_string(special, '|') END AS special_category, {PII_MARK} AS mark FROM ")
add("pii_scan", PII_ROWS + "pii_both")
add("stream_pii", PII_ROWS + "pii")
CTES["docs"] = d.select_sql("documents", d.DOCUMENT)
add("personal_emails", f"SELECT repo, document, count(*) AS emails FROM ({emails_sql('docs', 'repo, document', 'text')}) GROUP BY ALL")
add("cleanup_summary", "SELECT repo, category, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN category IS NULL THEN round_even(100.0 * count(*) / any_value(total), 1) END AS pct_files "
    "FROM cands JOIN (SELECT repo, count(*) AS total FROM files GROUP BY repo) USING (repo) GROUP BY GROUPING SETS ((repo, category), (repo))")


CTES["parts"] = (
    "SELECT repo, 'api' AS part, method || ' ' || path AS entry FROM api UNION ALL SELECT repo, 'dependencies', file || '::' || name || '@' || coalesce(version, '') FROM deps "
    "UNION ALL SELECT repo, 'env', value FROM env UNION ALL SELECT repo, 'important_files', path FROM important UNION ALL SELECT repo, 'scripts', name || '=' || command FROM scripts "
    "UNION ALL SELECT repo, 'tables', value FROM tabs UNION ALL SELECT repo, 'technologies', tech || ':' || provenance FROM techs WHERE provenance <> 'mentioned' "
    "UNION ALL SELECT DISTINCT repo, NULL, NULL FROM files"
)
CTES["printed"] = "SELECT repo, part || ':' || entry || '*' || count(*) AS l FROM parts WHERE part IS NOT NULL GROUP BY repo, part, entry"
CTES["prints"] = "SELECT repo, left(md5(l), 4) AS bucket, sha256(string_agg(l, chr(10) ORDER BY encode(l))) AS s FROM printed GROUP BY ALL"
add("fingerprint", "SELECT repo, sha256(coalesce(string_agg(bucket || s, '' ORDER BY bucket), '')) AS sha, count(bucket) AS buckets FROM (SELECT DISTINCT repo FROM files) LEFT JOIN prints USING (repo) GROUP BY repo")
CTES["file_parts"] = (
    "SELECT repo, 'api' AS part, method || ' ' || path AS entry FROM api UNION ALL SELECT repo, 'dependencies', file || '::' || name || '@' || coalesce(version, '') FROM deps "
    "UNION ALL SELECT repo, 'env', value FROM (SELECT DISTINCT repo, file, value FROM signals WHERE kind = 'env_var') "
    "UNION ALL SELECT repo, 'important_files', path FROM important UNION ALL SELECT repo, 'scripts', name || '=' || command FROM scripts "
    "UNION ALL SELECT repo, 'tables', value FROM tabs "
    "UNION ALL SELECT repo, 'technologies', tech || ':' || ['declared', 'imported', 'vendored'][rank + 1] FROM (SELECT DISTINCT repo, file, tech, rank FROM ev WHERE rank < 3)"
)
LANE_SUMS = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {15 * n + 1}, 15) AS HUGEINT)), 0) AS l{n}" for n in range(4))
CTES["lanes"] = f"SELECT repo, count(*) AS entries, {LANE_SUMS} FROM (SELECT repo, sha256(part || ':' || entry) AS h FROM file_parts) GROUP BY repo"
add("fingerprint_updated", "SELECT f.repo, f.n AS files, coalesce(entries, 0) AS entries, sha256(concat_ws(':', coalesce(entries, 0), coalesce(l0, 0), coalesce(l1, 0), coalesce(l2, 0), coalesce(l3, 0))) AS sha "
    "FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo) f LEFT JOIN lanes USING (repo)")
add("health_facts", "SELECT * FROM health")


CTES["items0"] = (
    "SELECT repo, 'languages' AS field, language || ':' || n AS value FROM langs UNION ALL SELECT repo, 'technologies', tech || ':' || provenance FROM techs WHERE provenance <> 'mentioned' "
    "UNION ALL SELECT repo, 'dependencies', name || coalesce(version, '') FROM deps UNION ALL SELECT repo, 'endpoints', method || ' ' || path FROM api UNION ALL SELECT repo, 'tables', value FROM tabs "
    "UNION ALL SELECT repo, 'env_vars', value FROM env UNION ALL SELECT repo, 'key_files', path FROM important UNION ALL SELECT repo, 'manifests', kind || ':' || path FROM mans WHERE NOT third_party"
)
CTES["items"] = "SELECT repo, field, value, count(*) AS n FROM items0 GROUP BY ALL"
add("card_items", "SELECT * FROM items")
COUNTED = ", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in ("dependencies", "endpoints", "tables", "env_vars", "key_files", "manifests"))
CTES["itemised"] = (
    "SELECT repo, " + ", ".join(f"CAST(sum(n) FILTER (field = '{n}') AS BIGINT) AS n_{n}" for n in ("dependencies", "endpoints", "tables", "env_vars", "key_files", "manifests"))
    + ", " + ", ".join(f"string_agg(value, '|' ORDER BY encode(value)) FILTER (field = '{n}') AS {n}" for n in ("languages", "technologies")) + " FROM items GROUP BY repo"
)
CTES["full_cards"] = f"SELECT c.repo, c.private, c.description, c.html_url, c.debt, {COUNTED}, coalesce(languages, '') AS languages, coalesce(technologies, '') AS technologies FROM cards c LEFT JOIN itemised USING (repo)"
add("repo_card", "SELECT * EXCLUDE (description, html_url) FROM full_cards")
add("private_rollup", "SELECT count(*) AS total, count(*) FILTER (readme_bytes = 0) AS no_readme, count(*) FILTER (readme_placeholder) AS placeholder, count(*) FILTER (NOT has_license) AS no_license, "
    "count(*) FILTER (NOT has_tests) AS no_tests, count(*) FILTER (NOT has_ci) AS no_ci FROM cards WHERE private HAVING count(*) > 0")
add("ref_type_counts", "SELECT coalesce(ref_type, 'no reconocida') AS ref_type, count(*) AS n FROM audit WHERE has_hook GROUP BY ALL")
INSIDE = "starts_with(lower(repo), 'repo_')"
add("fleet_audit_summary", f"SELECT count(*) AS repos, count(*) FILTER ({INSIDE}) AS in_scope, count(*) FILTER ({INSIDE} AND has_hook) AS in_scope_hook, count(*) FILTER ({INSIDE} AND NOT has_hook) AS in_scope_no_hook, "
    f"count(*) FILTER (NOT {INSIDE}) AS out_of_scope, count(*) FILTER (NOT {INSIDE} AND has_hook) AS out_of_scope_hook, count(*) FILTER (inherits_secrets) AS inherit_secrets, "
    "count(*) FILTER (has_hook AND NOT coherent) AS incoherent, count(*) FILTER (has_hook AND ref_type = 'SHA fijado') AS pinned_sha FROM audit")
add("run_inventory", "SELECT f.repo, count(*) AS files, " + ", ".join(
    f"(SELECT count(*) FROM {src} x WHERE x.repo = f.repo{cond}) AS {alias}" for alias, src, cond in (
        ("own_manifests", "mans", " AND NOT third_party"), ("dependencies", "deps", ""), ("scripts", "scripts", ""), ("endpoints", "api", ""), ("tables", "tabs", ""),
        ("env_vars", "env", ""), ("third_party_manifests", "mans", " AND third_party"))) + " FROM files f GROUP BY f.repo")
add("weak_signals", "SELECT repo, array_to_string(list_sort(list(DISTINCT category)), '|') AS weak FROM caps WHERE confidence = 'low' GROUP BY repo")
CTES["problems"] = f"SELECT * FROM unsupported UNION ALL {structure_sql('guides')}"
add("validation_summary", "SELECT g.repo, coalesce(e, 0) = 0 AS valid, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(c1, 0) AS environment_variables, coalesce(c2, 0) AS endpoints, coalesce(u, 0) AS unsupported_technologies, "
    "coalesce(c3, 0) AS table_mentions, coalesce(c4, 0) AS commands FROM (SELECT DISTINCT repo FROM guides) g "
    "LEFT JOIN (SELECT repo, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (kind = 'technology') AS u FROM problems GROUP BY repo) p ON g.repo = p.repo "
    "LEFT JOIN (SELECT repo, count(*) FILTER (kind = 'env') AS c1, count(*) FILTER (kind = 'endpoint') AS c2, count(*) FILTER (kind = 'table') AS c3, count(*) FILTER (kind = 'command') AS c4 FROM claimed GROUP BY repo) c ON g.repo = c.repo")
CTES["persons"] = f"SELECT repo, document, count(*) AS n FROM ({emails_sql('sections', 'repo, document', 'text')}) GROUP BY ALL"
add("publish_gate", "SELECT m.repo, missing, coalesce(c, 0) AS citations, coalesce(i, 0) AS invented, CASE WHEN coalesce(c, 0) > 0 THEN coalesce(i, 0) / c ELSE 0.0 END AS invented_share, pd AS personal_documents, missing = '' AND coalesce(i, 0) = 0 AND coalesce(c, 0) > 0 AND pd = 0 AS publishable FROM missing m "
    "LEFT JOIN (SELECT repo, count(*) AS c, count(*) FILTER (NOT valid) AS i FROM checked GROUP BY repo) k ON m.repo = k.repo "
    f"JOIN (SELECT repo, count(*) FILTER (regexp_matches(text, {q(dims.RUT)}) OR persons.n > 0) AS pd FROM sections LEFT JOIN persons USING (repo, document) GROUP BY repo) p ON m.repo = p.repo")
add("evidence_top_n", "SELECT repo, tech, CAST(rank AS BIGINT) AS rank, n, file, line, detail FROM ev_n WHERE n <= 5")
add("carry_path", "SELECT * FROM carried")
add("block_pairing", f"SELECT repo, n, id, begin_line, begin_line + {nl('marker || content')} AS end_line FROM blocks")
add("latest_pulls", "SELECT repo, rank, number, closed_at, merged_at FROM latest")
add("summary_lines", f"SELECT repo, unnest(range(1, len(s) + 1)) AS rank, unnest(s) AS value FROM (SELECT repo, {summary_sql('text', False)} AS s FROM readmes)")
add("important_files", "SELECT * FROM important")
add("debt_score", "SELECT repo, debt FROM debts")
add("debt_ranking", "SELECT repo, debt, row_number() OVER (ORDER BY debt DESC, lower(repo), repo) AS rank FROM debts")
SEL_SHORT = f"(length({strip('text')}) < 200 OR {strip('''replace({0}, '# ' || repo, '')'''.format(strip('text')))} = '')"
CTES["sweep"] = (
    "SELECT r.name AS repo, h.repo IS NOT NULL AS has_hook, coalesce(b, 0) AS readme_bytes, coalesce(ph, true) AS placeholder, r.pushed_at, x.repo IS NOT NULL AS rejected FROM repos r "
    "LEFT JOIN (SELECT repo FROM hooks WHERE text IS NOT NULL) h ON r.name = h.repo "
    f"LEFT JOIN (SELECT repo, length(text) AS b, {SEL_SHORT} AS ph FROM root_readme) m ON r.name = m.repo "
    "LEFT JOIN (SELECT DISTINCT repo FROM latest WHERE merged_at IS NULL) x ON r.name = x.repo WHERE starts_with(lower(r.name), 'repo_1') AND NOT archived AND NOT disabled AND NOT fork"
)
add("sweep_selection", "SELECT *, 'selected' AS list FROM (SELECT *, row_number() OVER (ORDER BY NOT placeholder, readme_bytes, pushed_at, repo) AS rank FROM sweep WHERE has_hook AND NOT rejected) "
    "UNION ALL SELECT *, NULL, CASE WHEN NOT has_hook AND rejected THEN 'no_hook,rejected' WHEN NOT has_hook THEN 'no_hook' ELSE 'rejected' END FROM sweep WHERE NOT has_hook OR rejected")
add("candidate_order", "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE confidence WHEN 'alta' THEN 0 ELSE 1 END, size DESC, path) AS rank FROM cands")
add("pii_order", "SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN sheet THEN 0 ELSE rut + correo + telefono + campos_sensibles END DESC, path) AS rank FROM pii")
add("manifest_order", "SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY third_party, depth, path) AS rank FROM mans")
add("deletion_candidates", "SELECT * FROM cands")
add("claims_minus_evidence", "SELECT * FROM unsupported")
add("config_unknown_keys", f"SELECT repo, {UNKNOWN.format('|')} AS unknown FROM conf")
add("missing_documents", "SELECT repo, missing FROM missing")
add("union_signals", "SELECT * FROM signals")
for _key, _kind in (("claims_env", "env"), ("claims_endpoints", "endpoint"), ("claims_technologies", "technology"), ("claims_tables", "table"), ("claims_commands", "command")):
    add(_key, f"SELECT * FROM unsupported WHERE kind = '{_kind}'")
add("known_commands", "SELECT repo, value FROM cmds")
add("normalize_command", f"SELECT DISTINCT repo, trim(regexp_replace(string_split({strip('l')}, ' #')[1], '\\s+', ' ', 'g')) AS command FROM (SELECT repo, unnest(CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS l FROM guides)")
CTES["doc_texts"] = "SELECT source || '/d_' || doc_id AS repo, text FROM documents"
add("claims_structure", structure_sql("doc_texts"))
add("placeholder_readme", f"SELECT repo, {SHORT} OR {TITLE_ONLY} AS contract, {SEL_SHORT} AS selection FROM readmes")
add("merge_action", f"SELECT repo, {ACTION} AS action FROM readmes")
add("managed_blocks", f"SELECT repo, n, id, sha AS declared_sha, left(sha256({norm('content')}), 12) AS current_sha, coalesce(sha <> left(sha256({norm('content')}), 12), false) AS frozen FROM blocks")
GEN = "'# nuevo ' || repo"
NEW_BLOCK = f"'<!-- AI:BEGIN id=' || id || ' sha=' || left(sha256({GEN}), 12) || ' -->' || chr(10) || {GEN} || chr(10) || '<!-- AI:END id=' || id || ' -->'"
CTES["judged"] = f"SELECT *, coalesce(sha <> left(sha256({norm('content')}), 12), false) AS frozen, marker || content || regexp_extract(rest, {q(END)}) AS whole FROM blocks"
CTES["cut"] = (
    "SELECT r.repo, r.text, count(*) FILTER (NOT frozen) AS opened, string_agg(id, '|' ORDER BY n) FILTER (frozen) AS conflicts, "
    f"list(whole ORDER BY n) AS wholes, list(CASE WHEN frozen THEN whole ELSE {NEW_BLOCK.replace('repo', 'r.repo')} END ORDER BY n) AS news FROM readmes r JOIN judged j ON r.repo = j.repo GROUP BY r.repo, r.text"
)
REPLACED = "list_reduce(list_prepend(text, list_transform(range(1, len(wholes) + 1), lambda k: k::VARCHAR)), lambda acc, k: replace(acc, wholes[k::BIGINT], news[k::BIGINT]))"
add("merge_blocks", f"SELECT repo, CASE WHEN opened > 0 THEN 'fusionado' ELSE 'respetado' END AS action, sha256(CASE WHEN opened = 0 THEN text WHEN ends_with(m, chr(10)) THEN m ELSE m || chr(10) END) AS sha, coalesce(conflicts, '') AS conflicts FROM (SELECT *, {REPLACED} AS m FROM cut)")
add("fingerprint_read", f"SELECT repo, nullif(regexp_extract(text, {q(MARK)}, 1), '') AS sealed FROM readmes")
add("fingerprint_seal", f"SELECT repo, sha256(regexp_replace(regexp_replace(text, {q(MARK)}, '', 'g'), '\\s+$', '') || chr(10) || chr(10) || '<!-- ai-readme-fingerprint: sha256:' || sha256(repo) || ' -->' || chr(10)) AS sha FROM readmes")
add("change_gate", "SELECT * FROM gates")
NUMBER = "CAST(string_split(repo, '_')[2] AS BIGINT)"
PLAN = "CASE WHEN NOT enabled THEN 'desactivado' WHEN action IN ('bloqueado', 'respetado') THEN action WHEN skip THEN 'sin_cambios' ELSE action END"
add("plan_actions", f"SELECT repo, {PLAN} AS plan, action, gate, {PLAN} IN ('creado', 'fusionado') AS writes, candidates FROM (SELECT g.repo, gate, skip, {ACTION.replace('|| repo ||', '|| r.repo ||')} AS action, "
    f"{NUMBER.replace('repo', 'g.repo')} % 5 <> 0 AS enabled, CASE WHEN {NUMBER.replace('repo', 'g.repo')} % 3 = 0 THEN {NUMBER.replace('repo', 'g.repo')} % 4 ELSE 0 END AS candidates FROM gates g JOIN readmes r ON g.repo = r.repo)")
LANG = "CASE WHEN list_contains(json_keys(j), 'lang') THEN trim(lower(json_extract_string(j, '$.lang'))) ELSE 'es' END"
IGNORE = "CASE WHEN json_type(j, '$.ignore_paths') = 'ARRAY' THEN CAST(json_extract(j, '$.ignore_paths') AS VARCHAR[]) WHEN json_type(j, '$.ignore_paths') = 'VARCHAR' THEN [json_extract_string(j, '$.ignore_paths')] ELSE [] END"
add("config_resolve", "SELECT repo, raw IS NOT NULL AS present, coalesce(json_extract_string(j, '$.enabled') <> 'false', true) AS enabled, "
    f"CASE WHEN {LANG} IN ('es', 'en') THEN {LANG} ELSE 'es' END AS lang, array_to_string(list_filter(list_transform({IGNORE}, lambda x: trim(x)), lambda x: x <> ''), '|') AS ignore_paths, "
    "trim(coalesce(json_extract_string(j, '$.declared'), '')) AS declared, coalesce(json_extract_string(j, '$.artifacts') = 'true', false) AS artifacts, coalesce(json_extract_string(j, '$.cleanup') <> 'false', true) AS cleanup, "
    "coalesce(json_extract_string(j, '$.insumos') = 'true', false) AS insumos, "
    "concat_ws('|', CASE WHEN raw IS NOT NULL AND j IS NULL THEN 'not_a_map' END, "
    f"CASE WHEN {LANG} NOT IN ('es', 'en') THEN 'unknown_lang:' || {LANG} END, "
    f"CASE WHEN {UNKNOWN.format(', ')} <> '' THEN 'unknown_keys:' || {UNKNOWN.format(', ')} END) AS warnings FROM conf")
add("human_inputs_guard", f"SELECT repo, bool_or(document IN {names(dims.REQUIRED_DOCUMENTS)} AND NOT contains(upper(text), 'DERIVADO DEL CODIGO')) AS human FROM sections GROUP BY repo")
HINT = "CASE " + " ".join(f"WHEN contains(upper(value), {q(n)}) THEN {q(h)}" for n, h in dims.ENV_HINTS) + f" ELSE {q(dims.DEFAULT_ENV_HINT)} END"
add("env_example_rows", f"SELECT repo, value, file, line, {HINT} AS hint FROM env WHERE value NOT IN {names(dims.RUNTIME_ENV)}")
add("api_doc_rows", "SELECT repo, section, method, path, file, line FROM (SELECT *, CASE WHEN type = 'frontend_api_call' THEN 'consumed' ELSE 'exposed' END AS section, row_number() OVER (PARTITION BY repo, type, method, path ORDER BY file, line) AS r FROM api) WHERE r = 1")
add("public_view", "SELECT * EXCLUDE (private) FROM full_cards WHERE NOT private")
README_SHOWN = "CASE WHEN readme_bytes = 0 THEN 'vacio' WHEN readme_placeholder THEN 'marcador' ELSE printf('%.1f KB', round_even(readme_bytes / 1024, 1)) END"
add("inventory_rows", f"SELECT c.repo, c.repo || CASE WHEN private THEN ' (privado)' ELSE '' END AS shown, debt, {README_SHOWN} AS readme, " + ", ".join(f"CASE WHEN {f} THEN 'si' ELSE '-' END AS {f}" for f in ("has_tests", "has_ci", "has_license"))
    + ", coalesce(st, '-') AS stack FROM cards c LEFT JOIN (SELECT repo, string_agg(tech, ', ' ORDER BY tech) AS st FROM techs WHERE provenance <> 'mentioned' GROUP BY repo) t ON c.repo = t.repo")
add("hook_audit", "SELECT * FROM audit")
add("ref_class", f"SELECT repo, {REF_KIND} AS kind FROM audit WHERE ref IS NOT NULL")
add("hook_drift", f"SELECT name AS repo, CASE WHEN text IS NULL THEN 'missing' WHEN {strip('replace(text, chr(13) || chr(10), chr(10))')} = 'uses: {d.WORKFLOW}@v2' || chr(10) || 'engine_ref: v2' THEN 'current' ELSE 'differs' END AS state FROM repos LEFT JOIN hooks ON repos.name = hooks.repo")
add("stream_change_gate", "SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS sha, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
add("stream_evidence", "SELECT * FROM signals")
NAMED = ("SELECT DISTINCT p.repo FROM full_cards p JOIN full_cards s ON p.private AND NOT s.private AND "
         "regexp_matches(s.repo || ' ' || s.description, '(?i)(^|[^A-Za-z0-9_])' || p.repo || '([^A-Za-z0-9_]|$)')")
CTES["named"] = NAMED
add("card_sink", "SELECT * EXCLUDE (html_url), repo IN (SELECT repo FROM named) AS named FROM full_cards")
CTES["records"] = (
    "SELECT repo, 'files' AS section, language AS name, size || '|' || third_party AS detail, path AS file, CAST(NULL AS BIGINT) AS line FROM files "
    "UNION ALL SELECT repo, 'structure', root, CAST(n AS VARCHAR), NULL, NULL FROM roots UNION ALL SELECT repo, 'languages', language, CAST(n AS VARCHAR), NULL, NULL FROM langs "
    "UNION ALL SELECT repo, 'important_files', NULL, CAST(score AS VARCHAR), path, NULL FROM important "
    "UNION ALL SELECT repo, 'technologies', tech, provenance || '|' || confidence || '|' || n_evidence, file, line FROM techs "
    "UNION ALL SELECT repo, 'dependencies', name, kind || '|' || coalesce(section, '') || '|' || coalesce(version, ''), file, line FROM deps "
    "UNION ALL SELECT repo, 'scripts', name, command, file, line FROM scripts "
    "UNION ALL SELECT m.repo, 'manifests', m.kind, coalesce(m.project_name, '') || '|' || coalesce(a.n, 0) || '|' || coalesce(s.n, 0) || '|' || m.third_party, m.path, NULL FROM mans m "
    "LEFT JOIN (SELECT repo, file, count(*) AS n FROM deps_all GROUP BY ALL) a ON m.repo = a.repo AND m.path = a.file LEFT JOIN (SELECT repo, file, count(*) AS n FROM scripts GROUP BY ALL) s ON m.repo = s.repo AND m.path = s.file "
    "UNION ALL SELECT repo, 'env', value, lang, file, line FROM env UNION ALL SELECT repo, 'api', method || ' ' || path, type, file, line FROM api UNION ALL SELECT repo, 'tables', value, NULL, file, line FROM tabs "
    "UNION ALL SELECT repo, 'capabilities', category, confidence || '|' || own_files || '|' || corroborated_by || '|' || keyword, file, line FROM caps "
    "UNION ALL SELECT repo, 'signals', value, lang || '|' || kind || '|' || coalesce(method, ''), file, line FROM signals "
    f"UNION ALL SELECT repo, 'readme', NULL, unnest(s), NULL, unnest(range(1, len(s) + 1)) FROM (SELECT repo, {summary_sql('text', False)} AS s FROM root_readme)"
)
add("evidence_sink", "SELECT * FROM records")
add("evidence_replaced", "SELECT * FROM records")
add("store_replaced", "SELECT * FROM signals")


def digest_section(number: int, limit: int, source: str, order: str, line: str, where: str = "true") -> str:
    return (
        f"SELECT repo, {number} AS section, n, l, {limit} AS lim FROM (SELECT repo, {line} AS l, row_number() OVER (PARTITION BY repo ORDER BY {order + ', ' if order else ''}{line}) AS n "
        f"FROM {source} WHERE {where}) WHERE n <= {limit + 1}"
    )


def cited(value: str) -> str:
    return f"{value} || ' [' || file || ':' || line || ']'"


CTES["digest_config"] = f"SELECT repo, trim(coalesce(json_extract_string(j, '$.declared'), '')) AS declared FROM conf WHERE repo IN (SELECT repo FROM files)"
CTES["digest_manifests"] = (
    "SELECT m.*, m.path || ' (' || m.kind || ', ' || coalesce(a.n, 0) || ')' || CASE WHEN m.third_party THEN ' third party' ELSE '' END AS l FROM mans m "
    "LEFT JOIN (SELECT repo, file, count(*) AS n FROM deps_all GROUP BY ALL) a ON m.repo = a.repo AND m.path = a.file"
)
CTES["modules_shown"] = (
    "SELECT repo, file, count(*) FILTER (kind = 'class') || ' classes, ' || count(*) FILTER (kind = 'function') || ' functions, ' || count(*) FILTER (kind = 'import') || ' imports' AS outline "
    "FROM signals WHERE lang = 'python' AND kind IN ('class', 'function', 'import') GROUP BY ALL"
)
CTES["components_shown"] = "SELECT repo, file, count(*) || ' components' AS outline FROM signals WHERE kind = 'component' GROUP BY ALL"
CTES["readme_shown"] = f"SELECT repo, unnest(s) AS value, unnest(range(1, len(s) + 1)) AS i FROM (SELECT repo, {summary_sql('text').replace('[1:35]', '[1:36]')} AS s FROM root_readme)"
LIMITS = [1, 15, 25, 25, 20, 60, 60, 40, 30, 80, 150, 150, 100, 60, 60, 60, 35, 50]
DEP_LINE = "name || CASE WHEN kind = 'npm' THEN '@' ELSE '' END || coalesce(version, '')"
DEP_ORDER = "depth, file, line, name, section NULLS FIRST"
CTES["digest_rows"] = " UNION ALL ".join(digest_section(i, LIMITS[i], *args) for i, args in enumerate((
    ("digest_config", "", "'declared by people: ' || declared", "declared <> ''"),
    ("langs", "n DESC, language", "'language: ' || language"),
    ("techs", "tech", "'technology: ' || tech || ' ' || provenance || ' ' || file || ':' || line", "provenance <> 'mentioned'"),
    ("techs", "tech", "'only mentioned: ' || tech", "provenance = 'mentioned'"),
    ("digest_manifests", "third_party, depth, path", "l"),
    ("deps", DEP_ORDER, cited(DEP_LINE), "kind = 'npm'"),
    ("deps", DEP_ORDER, cited(DEP_LINE), "kind = 'python'"),
    ("scripts", "file, line, name", "name || '=' || command || ' [' || file || ']'"),
    ("roots", "n DESC, root", "'root: ' || root || ' ' || n"),
    ("important", "score DESC, path", "'key file: ' || path"),
    ("api", "file, line, method, path", cited("method || ' ' || path")),
    ("tabs", "file, line, value", cited("value")),
    ("env", "value", cited("value")),
    ("caps", "category, file, line", cited("category || ' ' || confidence || ' ' || keyword")),
    ("modules_shown", "file", "file || ': ' || outline"),
    ("components_shown", "file", "file || ': ' || outline"),
    ("readme_shown", "i", "value"),
    ("deployment", "path", "'deployment: ' || path"),
)))
add("context_digest", f"SELECT repo, left(t, {dims.MAX_CONTEXT_CHARS}) AS text, length(t) > {dims.MAX_CONTEXT_CHARS} AS truncated, coalesce(c, '') AS cut_sections FROM ("
    "SELECT repo, string_agg(l, chr(10) ORDER BY section, n) FILTER (n <= lim) AS t, (SELECT string_agg(CAST(section AS VARCHAR), ',' ORDER BY section) FROM (SELECT DISTINCT section FROM digest_rows y WHERE y.repo = x.repo AND n > lim)) AS c "
    "FROM digest_rows x GROUP BY repo)")
