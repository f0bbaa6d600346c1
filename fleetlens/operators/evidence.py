"""Per-repository inventories, key files, and the bounded text digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.text import first_needle, lines_of, strip
from fleetlens.operators.ranking import first_per_key, top_n, top_n_distinct


def env_inventory(signals: DataFrame) -> DataFrame:
    """(repo, value, file, line, lang): distinct variables with their first citation."""
    found = signals.where(F.col("kind") == "env_var").select("repo", "value", "file", "line", "lang")
    return first_per_key(found, ["repo", "value"], ["file", "line"])


def _first(df: DataFrame, order: list[Column | str], limit: int | None) -> DataFrame:
    """All rows, or with a limit the first ones of each repository with their ``rank``."""
    return df if limit is None else top_n(df, ["repo"], order, limit)


def api_inventory(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, type, method, path, file, line): distinct endpoints and calls; with a limit the first ones, ranked."""
    kind = F.col("kind")
    items = signals.where(kind.isin("route", "api_call")).select(
        "repo", "file", "line", "method", F.col("value").alias("path"),
        F.when(kind == "route", "backend_route").otherwise("frontend_api_call").alias("type"),
    )
    return items.distinct() if limit is None else top_n_distinct(items, ["repo"], ["file", "line", "method", "path"], limit)


def table_inventory(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, value, file, line): distinct table mentions; with a limit the first ones, ranked."""
    items = signals.where(F.col("kind") == "table").select("repo", "file", "line", "value")
    return items.distinct() if limit is None else top_n_distinct(items, ["repo"], ["file", "line", "value"], limit)


def structure_counts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, root, n): files per top-level path segment."""
    root = F.substring_index(F.col("path"), "/", 1)
    counted = files.groupBy("repo", root.alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return _first(counted, [F.col("n").desc(), F.col("root")], limit)


def language_counts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, language, n), ``Other`` left out."""
    known = files.where(F.col("language") != "Other")
    counted = known.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))
    return _first(counted, [F.col("n").desc(), F.col("language")], limit)


def importance(path: Column, name: Column) -> Column:
    lowered = F.lower(path)
    points = [F.when(lowered.contains(word), 1).otherwise(0) for word in dims.IMPORTANT_KEYWORDS]
    points.append(F.when(F.lower(name).isin(*dims.CORE_MANIFESTS), 10).otherwise(0))
    points.append(F.when(name.isin(*dims.IMPORTANT_FILES), 5).otherwise(0))
    return reduce(lambda a, b: a + b, points)


def important_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, path, score)."""
    scored = files.select("repo", "path", importance(F.col("path"), F.col("name")).alias("score"))
    return _first(scored.where("score > 0"), [F.col("score").desc(), F.col("path")], limit)


def deployment_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, path): paths that name a deployment tool; a path occurs once per repository."""
    named = files.where(F.lower(F.col("path")).rlike("|".join(dims.DEPLOYMENT_TOKENS)))
    return _first(named.select("repo", "path"), ["path"], limit)


def summary_items(text: Column, limit: int | None = None, width: int | None = None) -> Column:
    """array<string>: the non-blank, non-badge lines; with ``limit`` the first ones, with ``width`` each cut there."""
    stripped = F.transform(lines_of(text), strip)
    kept = F.filter(stripped, lambda l: (l != "") & ~l.startswith("![") & ~l.startswith("[!["))
    first = kept if limit is None else F.slice(kept, 1, limit)
    return first if width is None else F.transform(first, lambda l: F.when(
        F.length(l) > width, F.concat(F.substring(l, 1, width), F.lit("..."))).otherwise(l))


def summary_lines(readmes: DataFrame, limit: int | None = None, width: int | None = None) -> DataFrame:
    """(repo, rank, value): works inside each README row, no window needed."""
    exploded = readmes.select("repo", F.posexplode(summary_items(F.col("text"), limit, width)).alias("n", "value"))
    return exploded.select("repo", (F.col("n") + 1).alias("rank"), "value")


def existing_readme(files: DataFrame) -> DataFrame:
    """(repo, text): README.md, README or README.txt at the root, first one with text."""
    path = F.col("path")
    order = F.when(path == "README.md", 0).when(path == "README", 1).otherwise(2)
    found = files.where(path.isin("README.md", "README", "README.txt") & (F.col("content") != ""))
    picked = found.groupBy("repo").agg(F.min_by("content", order).alias("text"))
    return picked.select("repo", "text")


def env_example_rows(env: DataFrame) -> DataFrame:
    """(repo, value, file, line, hint): configuration variables, runtime ones left out."""
    name = strip(F.col("value"))
    kept = env.where((name != "") & ~name.isin(*dims.RUNTIME_ENV))
    hint = first_needle(F.upper(name), dims.ENV_HINTS, dims.DEFAULT_ENV_HINT)
    return kept.select("repo", name.alias("value"), "file", "line", hint.alias("hint"))


def api_doc_rows(api: DataFrame) -> DataFrame:
    """(repo, section, method, path, file, line): exposed and consumed endpoints, first citation."""
    section = F.when(F.col("type") == "frontend_api_call", "consumed").otherwise("exposed")
    rows = api.select("repo", section.alias("section"), "method", "path", "file", "line")
    return first_per_key(rows, ["repo", "section", "method", "path"], ["file", "line"])


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("fact", F.lit(name))


def run_inventory(
    files: DataFrame, manifests: DataFrame, api: DataFrame, tables: DataFrame, env: DataFrame
) -> DataFrame:
    """One row per repository with the size of each kind of evidence.

    Small per-kind counts are unioned and pivoted: one shuffle of counts
    instead of a chain of joins.
    """
    own = ~F.col("third_party")
    by_manifest = manifests.groupBy("repo").agg(
        F.count_if(own).alias("own_manifests"),
        F.sum(F.when(own, F.size("dependencies")).otherwise(0)).alias("dependencies"),
        F.sum(F.when(own, F.size("scripts")).otherwise(0)).alias("scripts"),
        F.count_if(F.col("third_party")).alias("third_party_manifests"),
    )
    unpivoted = by_manifest.unpivot(
        "repo", ["own_manifests", "dependencies", "scripts", "third_party_manifests"], "fact", "n"
    ).select("repo", "n", "fact")
    parts = [
        _count(files, "files"), unpivoted, _count(api, "endpoints"), _count(tables, "tables"),
        _count(env, "env_vars"),
    ]
    facts = ["files", "own_manifests", "dependencies", "scripts", "endpoints", "tables", "env_vars",
             "third_party_manifests"]
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.groupBy("repo").agg(*[
        F.coalesce(F.sum(F.when(F.col("fact") == f, F.col("n"))), F.lit(0)).alias(f) for f in facts
    ])


# --- digest -----------------------------------------------------------------

# Output format of the digest: the mark that opens each kind of line, and the items shown per section.
SECTIONS = {
    "declared": 1, "languages": 15, "technologies": 25, "mentioned": 25, "manifests": 20, "npm": 60, "python": 60, "scripts": 40,
    "roots": 30, "key_files": 80, "api": 150, "tables": 150, "env": 100, "capabilities": 60, "modules": 60, "components": 60, "readme": 35, "deployment": 50,
}


def _cited(prefix: Column) -> Column:
    return F.concat(prefix, F.lit(" ["), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("]"))


def _marked(mark: str, value: Column) -> Column:
    return F.concat(F.lit(f"{mark}: "), value)


def python_outline(signals: DataFrame) -> DataFrame:
    """(repo, file, outline): how many classes, functions and imports each Python file has."""
    kinds = {"class": "classes", "function": "functions", "import": "imports"}
    python = signals.where((F.col("lang") == "python") & F.col("kind").isin(*kinds))
    counted = python.groupBy("repo", "file").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()])
    shown = [F.concat(F.col(n).cast("string"), F.lit(f" {n}")) for n in kinds.values()]
    return counted.select("repo", "file", F.concat_ws(", ", *shown).alias("outline"))


def component_outline(signals: DataFrame) -> DataFrame:
    """(repo, file, outline): how many components each script file has."""
    counted = signals.where(F.col("kind") == "component").groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("repo", "file", F.concat(F.col("n").cast("string"), F.lit(" components")).alias("outline"))


def digest_lines(
    files: DataFrame, signals: DataFrame, manifests: DataFrame, technologies: DataFrame,
    capability_rows: DataFrame, readmes: DataFrame, declared: DataFrame, limits: dict[str, int] | None = None,
) -> DataFrame:
    """(repo, section, n, line, cut): the first lines of each section; ``cut`` where a section has more."""
    from fleetlens.operators.manifests import declared_dependencies, npm_scripts

    limits = SECTIONS | (limits or {})
    numbers = {name: i for i, name in enumerate(SECTIONS)}

    def section(name: str, df: DataFrame, order: list[Column | str], line: Column) -> DataFrame:
        limit = limits[name]
        kept = top_n(df.withColumn("_line", line), ["repo"], [*order, "_line"], limit + 1)
        return kept.select("repo", F.lit(numbers[name]).alias("section"), F.col("rank").cast("bigint").alias("n"), F.col("_line").alias("line"), (F.col("rank") > limit).alias("cut"))

    conclusive = F.col("provenance") != "mentioned"
    deps = declared_dependencies(manifests)
    dep_order = ["depth", "file", "line", "name", "section"]
    dep_name = F.concat(F.col("name"), F.when(F.col("kind") == "npm", "@").otherwise(""), F.coalesce(F.col("version"), F.lit("")))
    tech_line = _marked("technology", F.concat(F.col("tech"), F.lit(" "), F.col("provenance"), F.lit(" "), F.col("file"), F.lit(":"), F.col("line").cast("string")))
    manifest_line = F.concat(
        F.col("path"), F.lit(" ("), F.col("kind"), F.lit(", "), F.size("dependencies").cast("string"), F.lit(")"), F.when(F.col("third_party"), " third party").otherwise(""))
    declaration = strip(F.col("declared"))
    signal_line = _cited(F.concat(F.col("category"), F.lit(" "), F.col("confidence"), F.lit(" "), F.col("keyword")))
    parts = [
        section("declared", declared.where(declaration != ""), [], _marked("declared by people", declaration)),
        section("languages", language_counts(files), [F.col("n").desc(), "language"], _marked("language", F.col("language"))),
        section("technologies", technologies.where(conclusive), ["tech"], tech_line),
        section("mentioned", technologies.where(~conclusive), ["tech"], _marked("only mentioned", F.col("tech"))),
        section("manifests", manifests, ["third_party", "depth", "path"], manifest_line),
        section("npm", deps.where("kind = 'npm'"), dep_order, _cited(dep_name)),
        section("python", deps.where("kind = 'python'"), dep_order, _cited(dep_name)),
        section("scripts", npm_scripts(manifests), ["file", "line", "name"], F.concat(F.col("name"), F.lit("="), F.col("command"), F.lit(" ["), F.col("file"), F.lit("]"))),
        section("roots", structure_counts(files), [F.col("n").desc(), "root"], _marked("root", F.concat(F.col("root"), F.lit(" "), F.col("n").cast("string")))),
        section("key_files", important_files(files), [F.col("score").desc(), "path"], _marked("key file", F.col("path"))),
        section("api", api_inventory(signals), ["file", "line", "method", "path"], _cited(F.concat_ws(" ", "method", "path"))),
        section("tables", table_inventory(signals), ["file", "line", "value"], _cited(F.col("value"))),
        section("env", env_inventory(signals), ["value"], _cited(F.col("value"))),
        section("capabilities", capability_rows, ["category", "file", "line"], signal_line),
        section("modules", python_outline(signals), ["file"], F.concat(F.col("file"), F.lit(": "), F.col("outline"))),
        section("components", component_outline(signals), ["file"], F.concat(F.col("file"), F.lit(": "), F.col("outline"))),
        section("readme", summary_lines(readmes, limits["readme"] + 1, 240).withColumnRenamed("rank", "_n"), ["_n"], F.col("value")),
        section("deployment", deployment_files(files), ["path"], _marked("deployment", F.col("path"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def context_digest(lines: DataFrame, max_chars: int = dims.MAX_CONTEXT_CHARS) -> DataFrame:
    """(repo, text, truncated, cut_sections): a text of bounded size from :func:`digest_lines`.

    The text is the feature here, so sections have limits; every section that has more than it
    shows is named by number, and ``truncated`` tells whether the text itself was cut.
    """
    shown = F.array_sort(F.collect_list(F.when(~F.col("cut"), F.struct("section", "n", "line"))))
    text = lines.groupBy("repo").agg(
        F.array_join(F.transform(shown, lambda s: s["line"]), "\n").alias("full"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("cut"), F.col("section")))), ",").alias("cut_sections"),
    )
    return text.select("repo", F.substring("full", 1, max_chars).alias("text"), (F.length("full") > max_chars).alias("truncated"), "cut_sections")
