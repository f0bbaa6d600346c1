"""Manifest reading: projections over manifest rows, one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.functions.text import blank_to_null, find_line, lines_of, lookup, rx, strip
from fleetlens.operators.ranking import ranked

DEPENDENCIES = "array<struct<name:string,version:string,section:string,line:int>>"
SCRIPTS = "array<struct<name:string,command:string,line:int>>"
NPM_SCHEMA = (
    "name string, dependencies map<string,string>, devDependencies map<string,string>, "
    "peerDependencies map<string,string>, scripts map<string,string>"
)
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def _entries(mapping: Column) -> Column:
    return F.coalesce(
        F.map_entries(mapping), F.array().cast("array<struct<key:string,value:string>>")
    )


def _quoted_line(content: Column, key: Column) -> Column:
    return find_line(content, F.concat(F.lit('"'), key, F.lit('"')))


def npm_items(content: Column, parsed: Column) -> Column:
    def read(section: str) -> Column:
        return F.transform(_entries(parsed[section]), lambda e: F.struct(
            e["key"].alias("name"), e["value"].alias("version"), F.lit(section).alias("section"),
            _quoted_line(content, e["key"]).alias("line")))

    return F.concat(*[read(s) for s in NPM_SECTIONS]).cast(DEPENDENCIES)


def npm_script_items(content: Column, parsed: Column) -> Column:
    return F.transform(_entries(parsed["scripts"]), lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("command"),
        _quoted_line(content, e["key"]).alias("line"))).cast(SCRIPTS)


def _stripped_lines(content: Column) -> Column:
    return F.transform(lines_of(content), lambda l, i: F.struct(
        (i + 1).alias("line"), strip(l).alias("value")))


def _dependency(name: Column, version: Column, section: str, line: Column) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"), F.lit(section).alias("section"), line.alias("line")
    )


def requirements_items(content: Column) -> Column:
    """Skips blank, comment, ``-r`` and ``--`` lines; the version is the rest of the line."""
    named = F.transform(
        F.filter(_stripped_lines(content), lambda s: (s["value"] != "") & ~s["value"].rlike(r"\A(#|-r|--)")),
        lambda s: F.struct(
            s["line"].alias("line"), s["value"].alias("value"),
            strip(F.regexp_extract(s["value"], r"\A[^<>=!~\[; ]*", 0)).alias("name")),
    )
    kept = F.filter(named, lambda s: s["name"] != "")
    return F.transform(kept, lambda s: _dependency(
        s["name"],
        blank_to_null(strip(F.substr(s["value"], F.length(s["name"]) + 1))),
        "requirements", s["line"])).cast(DEPENDENCIES)


PYPROJECT_LINE = rx(r"\A[\"']?([A-Za-z0-9._-]+)[\"']?\s*[>=<~^]*\s*[\"']")


def pyproject_items(content: Column) -> Column:
    """Conservative line pattern; metadata keys skipped; no version."""
    named = F.transform(_stripped_lines(content), lambda s: F.struct(
        s["line"].alias("line"), F.regexp_extract(s["value"], PYPROJECT_LINE, 1).alias("name")))
    kept = F.filter(named, lambda s: (s["name"] != "") & ~F.lower(s["name"]).isin(*dims.PYPROJECT_METADATA))
    return F.transform(kept, lambda s: _dependency(
        s["name"], F.lit(None).cast("string"), "pyproject", s["line"])).cast(DEPENDENCIES)


def image_items(content: Column, pattern: str, section: str) -> Column:
    named = F.transform(lines_of(content), lambda l, i: F.struct(
        (i + 1).alias("line"), F.regexp_extract(l, pattern, 1).alias("name")))
    return F.transform(F.filter(named, lambda s: s["name"] != ""), lambda s: _dependency(
        s["name"], F.lit(None).cast("string"), section, s["line"])).cast(DEPENDENCIES)


DOCKER_IMAGE = rx(r"\A\s*FROM\s+(\S+)", "i")
COMPOSE_IMAGE = rx(r"\A\s*image:\s*[\"']?([^\"'\s]+)")


def is_manifest(name: Column, path: Column) -> Column:
    return name.isin(*dims.MANIFEST_KIND) & ~path.rlike(rx(dims.MANIFEST_IGNORED_PATH, "i"))


def dependency_items(name: Column, content: Column) -> Column:
    """Declared dependencies of one manifest, chosen by its file name."""
    parsed = F.from_json(content, NPM_SCHEMA)
    read = (
        F.when(name == "package.json", npm_items(content, parsed))
        .when(name.isin(*dims.REQUIREMENTS_FILES), requirements_items(content))
        .when(name == "pyproject.toml", pyproject_items(content))
        .when(name == "Dockerfile", image_items(content, DOCKER_IMAGE, "docker-image"))
        .when(name.isin(*dims.COMPOSE_FILES), image_items(content, COMPOSE_IMAGE, "compose-image"))
    )
    return F.coalesce(read, F.array().cast(DEPENDENCIES))


def discover_manifests(files: DataFrame) -> DataFrame:
    """One row per manifest at any depth, own and third party.

    (repo, path, kind, third_party, depth, project_name, dependencies, scripts);
    kinds without a reader keep empty lists. ``manifest_order`` gives the order.
    """
    item = manifest_item()
    return files.where(is_manifest(F.col("name"), F.col("path"))).select(
        "repo", "path", "third_party", paths.depth_of(F.col("path")).alias("depth"), item.alias("m")
    ).select("repo", "path", "m.kind", "third_party", "depth", "m.project_name", "m.dependencies", "m.scripts")


def manifest_item() -> Column:
    """struct<kind, project_name, dependencies, scripts> of one manifest."""
    name, content = F.col("name"), F.col("content")
    parsed = F.when(name == "package.json", F.from_json(content, NPM_SCHEMA))
    scripts = F.coalesce(npm_script_items(content, parsed), F.array().cast(SCRIPTS))
    return F.struct(
        lookup(dims.MANIFEST_KIND, name).alias("kind"), parsed["name"].alias("project_name"),
        dependency_items(name, content).alias("dependencies"), scripts.alias("scripts"),
    )


def declared_dependencies(manifests: DataFrame, include_third_party: bool = False) -> DataFrame:
    """Flattened dependencies: (repo, file, kind, name, version, section, line)."""
    chosen = manifests if include_third_party else manifests.where(~F.col("third_party"))
    return chosen.select(
        "repo", F.col("path").alias("file"), "kind", "depth", F.inline("dependencies")
    )


def npm_scripts(manifests: DataFrame) -> DataFrame:
    """Scripts of own manifests: (repo, file, name, command, line)."""
    own = manifests.where(~F.col("third_party"))
    return own.select("repo", F.col("path").alias("file"), F.inline("scripts"))


def dependencies_in(files: DataFrame, *file_names: str) -> DataFrame:
    """Dependencies read from the given manifest names, third party included."""
    chosen = files.where(F.col("name").isin(*file_names))
    return declared_dependencies(discover_manifests(chosen), include_third_party=True).drop("depth")


def npm_dependencies(files: DataFrame) -> DataFrame:
    return dependencies_in(files, "package.json")


def requirements_dependencies(files: DataFrame) -> DataFrame:
    return dependencies_in(files, *dims.REQUIREMENTS_FILES)


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    return dependencies_in(files, "pyproject.toml")


def docker_images(files: DataFrame) -> DataFrame:
    return dependencies_in(files, "Dockerfile")


def compose_images(files: DataFrame) -> DataFrame:
    return dependencies_in(files, *dims.COMPOSE_FILES)


def root_dependencies(files: DataFrame) -> DataFrame:
    """Root package.json plus the raw lines of the root requirements files.

    (repo, ecosystem, file, name, version, section, line). A name declared in
    several npm sections keeps the last one.
    """
    path, content = F.col("path"), F.col("content")
    parsed = F.from_json(content, NPM_SCHEMA)
    later = {"dependencies": NPM_SECTIONS[1:], "devDependencies": NPM_SECTIONS[2:], "peerDependencies": ()}

    def kept(item: Column) -> Column:
        condition = F.lit(True)
        for section, overriding in later.items():
            for other in overriding:
                hidden = F.coalesce(F.map_contains_key(parsed[other], item["name"]), F.lit(False))
                condition = condition & ~((item["section"] == section) & hidden)
        return condition

    npm = F.transform(F.filter(npm_items(content, parsed), kept), lambda d: F.struct(
        F.lit("npm").alias("ecosystem"), d["name"].alias("name"), d["version"].alias("version"),
        d["section"].alias("section"), F.lit(None).cast("int").alias("line")))
    raw_lines = F.filter(_stripped_lines(content), lambda s: (s["value"] != "") & ~s["value"].startswith("#"))
    python = F.transform(raw_lines, lambda s: F.struct(
        F.lit("python").alias("ecosystem"), s["value"].alias("name"), F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("section"), s["line"].alias("line")))
    item = "array<struct<ecosystem:string,name:string,version:string,section:string,line:int>>"
    roots = files.where(path.isin("package.json", "requirements.txt", "requirements-dev.txt"))
    items = F.when(path == "package.json", npm.cast(item)).otherwise(python.cast(item))
    return roots.select("repo", path.alias("file"), F.inline(items))


def manifest_order(manifests: DataFrame) -> DataFrame:
    """Own before third party, shallow before deep, then path.

    The rank is per repository and never holds one repository in one task.
    """
    return ranked(manifests, ["repo"], ["third_party", "depth", "path"], "rank")
