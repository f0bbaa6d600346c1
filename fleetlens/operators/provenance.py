"""Technologies by provenance, and capability signals with corroboration."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.functions.text import contains_any, first_line, fold, lookup, rx, strip
from fleetlens.operators.extract import asset_items, mention_items, mention_rows, signal_items
from fleetlens.operators.manifests import dependency_items, is_manifest
from fleetlens.operators.ranking import top_n

RANK = {name: i for i, name in enumerate(dims.PROVENANCE_ORDER)}
PRESENCE_TECHS = ("Node.js", "Docker")
ITEM = "array<struct<tech:string,rank:int,line:int,detail:string>>"


def normalize_token(name: Column) -> Column:
    """Comparable package name: no scope, no version, no submodule."""
    token = F.regexp_replace(F.lower(strip(name)), r"\A@(?:[^/]*/)?", "")
    token = F.regexp_extract(token, r"\A[^<>=!~\^\[; ]*", 0)
    return strip(F.regexp_extract(token, r"\A[^.]*", 0))


def tech_for(name: Column, modules=dims.MODULE_TO_TECH, prefixes=dims.PREFIX_TO_TECH) -> Column:
    """Technology of a dependency or module name, null when unknown.

    Prefix rules first, in order, then the exact normalized name. Both
    dictionaries are literals in the plan, so there is no join to place.
    """
    raw = F.lower(strip(name))
    exact = lookup(modules, normalize_token(name))
    result = None
    for prefix, tech in prefixes:
        test = raw.startswith(prefix)
        result = F.when(test, F.lit(tech)) if result is None else result.when(test, F.lit(tech))
    return exact if result is None else result.otherwise(exact)


def _item(tech: Column, provenance: str, line: Column, detail: Column) -> Column:
    return F.struct(
        tech.alias("tech"), F.lit(RANK[provenance]).alias("rank"), line.cast("int").alias("line"),
        detail.alias("detail"),
    )


def _or_empty(items: Column) -> Column:
    return F.coalesce(items.cast(ITEM), F.array().cast(ITEM))


@cache
def declared_items(read: str | None = None) -> Column:
    """Technologies one own manifest declares, plus the presence rule; ``read`` names a column that holds its dependencies."""
    name, path, content = F.col("name"), F.col("path"), F.col("content")
    kind = lookup(dims.MANIFEST_KIND, name)
    named = F.transform(F.col(read) if read else dependency_items(name, content), lambda d: _item(
        tech_for(d["name"]), "declared", d["line"], d["name"]))
    present = (
        F.when(kind == "npm", F.array(_item(F.lit("Node.js"), "declared", F.lit(1), F.lit("package.json"))))
        .when(kind.isin("docker", "compose"), F.array(_item(F.lit("Docker"), "declared", F.lit(1), path)))
    )
    own = is_manifest(name, path) & ~F.col("third_party")
    return _or_empty(F.when(own, F.concat(_or_empty(named), _or_empty(present))))


@cache
def imported_items(read: str | None = None) -> Column:
    """Technologies of the modules one file imports; ``read`` names a column that holds its signals."""
    wanted, _, items = signal_items(("py_imports", "js_imports"))
    if read:
        items = F.filter(read, lambda s: s["kind"] == "import")
    scoped = wanted & F.col("text")
    shaped = F.transform(items, lambda s: _item(tech_for(s["value"]), "imported", s["line"], s["value"]))
    return _or_empty(F.when(scoped, shaped))


@cache
def vendored_items() -> Column:
    shaped = F.transform(asset_items("content"), lambda a: _item(
        a["tech"], "vendored", a["line"], a["asset"]))
    return _or_empty(F.when(F.col("language") == "HTML", shaped))


@cache
def mentioned_items() -> Column:
    scoped = F.col("text")
    shaped = F.transform(mention_items("content", "_folded"), lambda m: _item(
        m["tech"], "mentioned", m["line"], m["pattern"]))
    return _or_empty(F.when(scoped, shaped))


def technology_items(*provenances: str, dependencies: str | None = None, signals: str | None = None) -> Column:
    """array<struct<tech, rank, line, detail>> of one file; needs ``_folded``, the content without case.

    ``dependencies`` and ``signals`` name columns that hold what was read from the file already.
    """
    makers = {
        "declared": lambda: declared_items(dependencies), "imported": lambda: imported_items(signals),
        "vendored": vendored_items, "mentioned": mentioned_items,
    }
    arrays = [makers[p]() for p in (provenances or dims.PROVENANCE_ORDER)]
    joined = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.filter(joined, lambda i: i["tech"].isNotNull())


def technology_evidence(files: DataFrame, *provenances: str) -> DataFrame:
    """(repo, tech, rank, file, depth, line, detail, third_party): one scan, one explode."""
    exploded = files.withColumn("_folded", fold(F.col("content"))).select(
        "repo", F.col("path").alias("file"), paths.depth_of(F.col("path")).alias("depth"), "third_party",
        F.explode(technology_items(*provenances)).alias("i"),
    )
    return exploded.select("repo", "i.tech", "i.rank", "file", "depth", "i.line", "i.detail", "third_party")


def evidence_order() -> list[Column]:
    by_depth = F.when(F.col("rank") == RANK["declared"], F.col("depth")).otherwise(F.lit(0))
    return [F.col("rank"), by_depth, F.col("file"), F.col("line"), F.col("detail")]


def evidence_top_n(evidence: DataFrame, n: int) -> DataFrame:
    """First n items per (repo, tech): strongest provenance, root-most manifest, file, line."""
    return top_n(evidence, ["repo", "tech"], evidence_order(), n, "n")


def _first_item() -> Column:
    fields = ["key", "depth_key", "file", "line", "detail"]
    values = [c.alias(n) for c, n in zip(evidence_order(), fields)]
    return F.min(F.struct(*values, "depth", "third_party"))


def ranked_evidence(evidence: DataFrame) -> DataFrame:
    """The items that count, all of them.

    A mention counts only where nothing stronger exists, and the presence of a manifest once; of
    these the first item is taken by a partial aggregate. All other items pass through unshuffled.
    """
    mention = F.col("rank") == RANK["mentioned"]
    presence = F.col("tech").isin(*PRESENCE_TECHS) & (F.col("rank") == RANK["declared"])
    columns = ["repo", "tech", "rank", "file", "depth", "line", "detail", "third_party"]
    plain = evidence.where(~mention & ~presence).select(*columns)
    firsts = evidence.where(mention | presence).groupBy("repo", "tech").agg(_first_item().alias("i"))
    firsts = firsts.select("repo", "tech", F.col("i.key").alias("rank"), *[F.col(f"i.{c}").alias(c) for c in columns[3:]])
    stronger = evidence.where(~mention).select("repo", "tech").distinct()
    lonely = firsts.where(mention).join(stronger, ["repo", "tech"], "left_anti")
    return plain.unionByName(firsts.where(~mention)).unionByName(lonely.select(*columns))


def provenance_rank(evidence: DataFrame) -> DataFrame:
    """(repo, tech, provenance, confidence, n_evidence, file, line, detail): one row per technology.

    The first item and the number of items; the items themselves are :func:`ranked_evidence`.
    """
    presence = F.col("tech").isin(*PRESENCE_TECHS) & (F.col("rank") == RANK["declared"])
    mention = F.col("rank") == RANK["mentioned"]
    grouped = evidence.groupBy("repo", "tech").agg(
        _first_item().alias("i"), F.count_if(~presence & ~mention).alias("plain"), F.bool_or(presence).cast("int").alias("present"))
    label = F.element_at(F.array(*[F.lit(p) for p in dims.PROVENANCE_ORDER]), F.col("i.key") + 1)
    count = F.when(F.col("i.key") == RANK["mentioned"], 1).otherwise(F.col("plain") + F.col("present")).cast("bigint")
    return grouped.select("repo", "tech", label.alias("provenance"), count.alias("n_evidence"), "i.file", "i.line", "i.detail").select(
        "repo", "tech", "provenance", lookup(dims.PROVENANCE_CONFIDENCE, F.col("provenance")).alias("confidence"),
        "n_evidence", "file", "line", "detail",
    )


def technologies(files: DataFrame) -> DataFrame:
    return provenance_rank(technology_evidence(files))


def conclusive_only(technologies: DataFrame) -> DataFrame:
    return technologies.where(F.col("provenance").isin(*dims.CONCLUSIVE_PROVENANCE))


def tech_declared(files: DataFrame) -> DataFrame:
    return ranked_evidence(technology_evidence(files, "declared"))


def tech_imported(files: DataFrame) -> DataFrame:
    return technology_evidence(files, "imported")


def tech_mentioned_only(technologies: DataFrame) -> DataFrame:
    return technologies.where(F.col("provenance") == "mentioned").select(
        "repo", "tech", "file", "line")


def tech_mentions(files: DataFrame, patterns=dims.TECHNOLOGY_PATTERNS) -> DataFrame:
    """(repo, tech, total, confidence, n, file, line): all mentions in one aggregate, the first one cited.

    The single mentions are :func:`mention_rows`.
    """
    first = F.min(F.struct("file", "line", "pattern"))
    grouped = mention_rows(files, patterns).groupBy("repo", "tech").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"), first.alias("i"))
    confidence = F.when(F.col("total") >= 10, "high").when(F.col("total") >= 3, "medium").otherwise("low")
    return grouped.select("repo", "tech", "total", confidence.alias("confidence"), "n", "i.file", "i.line")


# --- capabilities -----------------------------------------------------------

def keyword_pattern(words: tuple[str, ...]) -> str:
    # One boundary before all words: most places of a text are left after a single test.
    return rx(rf"\b(?:{'|'.join(rf'\Q{w}\E' for w in words)})\b", "i")


def capability_scope() -> Column:
    return F.col("text") & ~F.col("path").rlike(rx(dims.CAPABILITY_EXCLUDED_PATH, "i"))


def capability_items(keywords=dims.CAPABILITY_KEYWORDS) -> Column:
    """array<struct<category, line, keyword>> of one file; needs ``_folded``."""
    content = F.col("content")
    hits = []
    for category, words in keywords.items():
        pattern = keyword_pattern(words)
        possible = contains_any(F.col("_folded"), words)
        hits.append(F.when(possible & content.rlike(pattern), F.struct(
            F.lit(category).alias("category"), first_line(content, pattern).alias("line"),
            F.lower(F.regexp_extract(content, pattern, 0)).alias("keyword"))))
    return F.array_compact(F.array(*hits))


def capability_hits(files: DataFrame, keywords=dims.CAPABILITY_KEYWORDS) -> DataFrame:
    """(repo, file, third_party, category, line, keyword): first keyword per file and category."""
    return files.where(capability_scope()).withColumn("_folded", fold(F.col("content"))).select(
        "repo", F.col("path").alias("file"), "third_party", F.inline(capability_items(keywords)))


def _categories(value: Column, support: dict[str, tuple[str, ...]]) -> Column:
    return F.array_compact(F.array(*[
        F.when(value.isin(*names), F.lit(category)) for category, names in support.items()
    ]))


def capability_corroboration(
    technologies: DataFrame, dependencies: DataFrame,
    support_tech=dims.CAPABILITY_SUPPORT_TECH, support_deps=dims.CAPABILITY_SUPPORT_DEPS,
) -> DataFrame:
    """(repo, category, corroborated_by): technology before dependency, then alphabetical."""
    by_tech = conclusive_only(technologies).select(
        "repo", F.explode(_categories(F.col("tech"), support_tech)).alias("category"),
        F.lit(0).alias("kind"), F.concat(F.lit("tecnología "), F.col("tech")).alias("label"),
    )
    names = dependencies.select("repo", F.explode(F.array_distinct(F.array(
        normalize_token(F.col("name")), F.lower(strip(F.col("name")))))).alias("dep"))
    by_dep = names.select(
        "repo", F.explode(_categories(F.col("dep"), support_deps)).alias("category"),
        F.lit(1).alias("kind"), F.concat(F.lit("dependencia "), F.col("dep")).alias("label"),
    )
    best = by_tech.unionByName(by_dep).groupBy("repo", "category").agg(F.min(F.struct("kind", "label")).alias("b"))
    return best.select("repo", "category", F.col("b.label").alias("corroborated_by"))


def capability_signals(hits: DataFrame, corroboration: DataFrame) -> DataFrame:
    """(repo, category, confidence, own_files, corroborated_by, keyword, file, line, third_party).

    Every hit of the categories with an own file and support.
    """
    own = hits.groupBy("repo", "category").agg(F.count_if(~F.col("third_party")).alias("own_files"))
    confidence = F.when(F.col("own_files") >= 3, "medium").otherwise("low")
    kept = own.where(F.col("own_files") > 0).join(corroboration, ["repo", "category"])
    return hits.join(kept, ["repo", "category"]).select(
        "repo", "category", confidence.alias("confidence"), "own_files", "corroborated_by",
        "keyword", "file", "line", "third_party",
    )


def capabilities(files: DataFrame, technologies: DataFrame, dependencies: DataFrame) -> DataFrame:
    return capability_signals(capability_hits(files), capability_corroboration(technologies, dependencies))


def weak_signals(capability_rows: DataFrame) -> DataFrame:
    """(repo, weak): the low-confidence capabilities of each repository (at most seven)."""
    weak = capability_rows.where(F.col("confidence") == "low")
    return weak.groupBy("repo").agg(F.sort_array(F.collect_set("category")).alias("weak"))
