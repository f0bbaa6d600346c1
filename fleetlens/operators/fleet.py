"""Fleet level: health, cards, debt, selection, audit, leak check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.paths import in_scope
from fleetlens.functions.text import strip
from fleetlens.operators.contract import placeholder_readme
from fleetlens.operators.evidence import (
    api_inventory, env_inventory, important_files, language_counts, summary_items, table_inventory,
)
from fleetlens.operators.manifests import declared_dependencies
from fleetlens.operators.provenance import conclusive_only
from fleetlens.operators.ranking import ranked, top_n

README_FILES = ("README.md", "README", "README.txt")


def health_facts(files: DataFrame) -> DataFrame:
    """One row per repository of checkable facts: a single partial aggregate.

    All facts but the title come from a scan of paths and sizes; contents are
    read only behind the pushed filter on the README paths, and the title test
    runs inside that row, so texts never reach the shuffle.
    """
    path, name = F.col("path"), F.col("name")
    summary = summary_items(F.col("content"), 35, 240)
    first_line = F.regexp_replace(F.lower(strip(F.try_element_at(summary, F.lit(1)))), r"\A[# ]+", "")
    title_only = (F.size(summary) == 0) | ((F.size(summary) == 1) & (first_line == F.lower("repo")))
    priority = F.when(path == "README.md", 0).when(path == "README", 1).otherwise(2)
    titles = files.where(path.isin(*README_FILES) & (F.col("content") != "")).select(
        "repo", F.struct(priority.alias("p"), title_only.alias("t")).alias("title"))
    facts = files.select(
        "repo",
        F.when(path == "README.md", F.col("size")).otherwise(0).alias("bytes"),
        (F.upper(name).startswith("LICEN") | (F.upper(name) == "COPYING")).alias("license"),
        path.rlike(r"\A(tests|test|spec)/|/tests/|/__tests__/").alias("tests"),
        path.startswith(".github/workflows/").alias("ci"),
        name.isin("Dockerfile", "docker-compose.yml", "docker-compose.yaml").alias("docker"),
        (path == ".gitignore").alias("gitignore"),
    )
    grouped = facts.unionByName(titles, allowMissingColumns=True).groupBy("repo").agg(
        F.max("bytes").alias("readme_bytes"), F.min("title").alias("title"),
        F.bool_or("license").alias("has_license"), F.bool_or("tests").alias("has_tests"),
        F.bool_or("ci").alias("has_ci"), F.bool_or("docker").alias("has_docker"),
        F.bool_or("gitignore").alias("has_gitignore"), F.count("bytes").alias("n_files"),
    )
    placeholder = (F.col("readme_bytes") < dims.PLACEHOLDER_SIZE) | F.coalesce(F.col("title.t"), F.lit(True))
    return grouped.withColumn("readme_placeholder", placeholder).drop("title")


def debt_score(health: DataFrame) -> DataFrame:
    size = F.col("readme_bytes")
    readme = F.when(size == 0, 100).when(F.col("readme_placeholder"), 80).when(size < 1000, 40).otherwise(0)
    missing = [("has_license", 10), ("has_tests", 10), ("has_ci", 5), ("has_gitignore", 5)]
    points = [F.when(F.col(c), 0).otherwise(p) for c, p in missing]
    return health.withColumn("debt", reduce(lambda a, b: a + b, points, readme))


def debt_ranking(scored: DataFrame) -> DataFrame:
    """Fleet-wide rank by debt descending, then lower name, then name."""
    return ranked(scored, [], [F.col("debt").desc(), F.lower("repo"), F.col("repo")], "rank")


CARD_COUNTS = ("dependencies", "endpoints", "tables", "env_vars", "key_files", "manifests")


def card_items(files: DataFrame, signals: DataFrame, manifests: DataFrame, technologies: DataFrame) -> DataFrame:
    """(repo, field, value, n): everything a card counts, one row per distinct value; the long companion of the cards."""
    def field(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select("repo", F.lit(name).alias("field"), value.alias("value"))

    version = F.coalesce(F.col("version"), F.lit(""))
    parts = [
        field(language_counts(files), "languages", F.concat_ws(":", "language", F.col("n").cast("string"))),
        field(conclusive_only(technologies), "technologies", F.concat_ws(":", "tech", "provenance")),
        field(declared_dependencies(manifests), "dependencies", F.concat("name", version)),
        field(api_inventory(signals), "endpoints", F.concat_ws(" ", "method", "path")),
        field(table_inventory(signals), "tables", F.col("value")),
        field(env_inventory(signals), "env_vars", F.col("value")),
        field(important_files(files), "key_files", F.col("path")),
        field(manifests.where(~F.col("third_party")), "manifests", F.concat_ws(":", "kind", "path")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("repo", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def repo_card(repos: DataFrame, files: DataFrame, items: DataFrame) -> DataFrame:
    """One card per analysed repository from its :func:`card_items`.

    Languages and technologies come from fixed dictionaries, so their lists are bounded; all other
    fields are counts, and the items stay in the companion table.
    """
    def listed(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("field") == name, F.col("value")))).alias(name)

    counts = [F.coalesce(F.sum(F.when(F.col("field") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in CARD_COUNTS]
    lists = items.groupBy("repo").agg(listed("languages"), listed("technologies"), *counts)
    shown = repos.select(F.col("name").alias("repo"), "private", "html_url", "description", "default_branch", "pushed_at", "topics")
    return debt_score(health_facts(files)).join(lists, "repo", "left").join(shown, "repo")


def public_view(cards: DataFrame) -> DataFrame:
    """Private cards disappear entirely; their name alone would say something."""
    return cards.where(~F.col("private"))


def private_rollup(cards: DataFrame) -> DataFrame:
    """Counts over private repositories only; no row when there are none."""
    totals = cards.where(F.col("private")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("readme_bytes") == 0).alias("no_readme"),
        F.count_if("readme_placeholder").alias("placeholder"), F.count_if(~F.col("has_license")).alias("no_license"),
        F.count_if(~F.col("has_tests")).alias("no_tests"), F.count_if(~F.col("has_ci")).alias("no_ci"),
    )
    return totals.where("total > 0")


def inventory_rows(cards: DataFrame) -> DataFrame:
    """Display fields of the inventory."""
    def flag(name: str) -> Column:
        return F.when(F.col(name), "si").otherwise("-").alias(name)

    size = F.col("readme_bytes")
    kilobytes = F.format_string("%.1f KB", F.bround(size / 1024, 1))
    readme = F.when(size == 0, "vacio").when(F.col("readme_placeholder"), "marcador").otherwise(kilobytes)
    names = F.transform(F.coalesce("technologies", F.array().cast("array<string>")),
                        lambda t: F.substring_index(t, ":", 1))
    stack = F.array_join(F.array_sort(names), ", ")
    shown = F.concat("repo", F.when(F.col("private"), " (privado)").otherwise(""))
    return cards.select(
        "repo", shown.alias("shown"), "debt", readme.alias("readme"), flag("has_tests"), flag("has_ci"),
        flag("has_license"), F.when(stack == "", "-").otherwise(stack).alias("stack"),
    )


RUN = "[A-Za-z0-9_]+"
GAP = "[^A-Za-z0-9_]+"
EDGE = 64  # code points of a gap that are kept beside a window; longer edges of a name are compared up to there


def _windows(text: Column, counts: list[int], lengths: list[int]) -> Column:
    """array<struct<window, before, after, first, last>> of one text in lower case.

    A window is as many word runs as some name has, with the gaps between them; ``before`` and ``after``
    are the gaps beside it. For names without a word character the windows are cut from the gaps.
    """
    lowered = F.lower(text)
    # One struct binds the split text, so that it is not split anew for each window.
    split = F.struct(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0)).alias("runs"), F.split(lowered, RUN, -1).alias("gaps"))

    def window(s: Column, i: Column, n: int) -> Column:
        inner = F.concat_ws("", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array(
            F.get(s["runs"], i + k), F.when(k < n - 1, F.get(s["gaps"], i + k + 1)).otherwise("")))))
        before, after = F.get(s["gaps"], i), F.get(s["gaps"], i + n)
        return F.struct(
            inner.alias("window"), F.right(before, F.lit(EDGE + 1)).alias("before"), F.left(after, F.lit(EDGE + 1)).alias("after"),
            (i == 0).alias("first"), (i + n == F.size(s["runs"])).alias("last"))

    def of_runs(s: Column, n: int) -> Column:
        last = F.size(s["runs"]) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: window(s, i, n))).otherwise(F.array())

    def of_gaps(s: Column, n: int) -> Column:
        def inside(gap: Column, i: Column) -> Column:
            """What no word run touches: the character next to a run is left out."""
            start = F.when(i == 0, 1).otherwise(2)
            length = F.length(gap) - F.when(i == 0, 0).otherwise(1) - F.when(i == F.size(s["gaps"]) - 1, 0).otherwise(1)
            return F.substr(gap, start, F.greatest(length, F.lit(0)))

        def cut(free: Column) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.length(free) - n + 1, F.lit(1)))
            return F.when(F.length(free) >= n, F.transform(places, lambda k: F.struct(
                F.substr(free, k, F.lit(n)).alias("window"), F.lit("").alias("before"), F.lit("").alias("after"),
                F.lit(True).alias("first"), F.lit(True).alias("last")))).otherwise(F.array())

        return F.flatten(F.transform(F.transform(s["gaps"], inside), cut))

    kinds = [lambda s, n=n: of_runs(s, n) for n in counts] + [lambda s, n=n: of_gaps(s, n) for n in lengths]
    return F.flatten(F.transform(F.array(split), lambda s: F.array_distinct(F.concat(*[k(s) for k in kinds]))))


def leak_check(published: DataFrame, cards: DataFrame) -> DataFrame:
    """(problem, repo): private names in the published text, and private cards published.

    ``published`` has a ``text`` column (the JSON of a card) and ``private``. A whole-word occurrence of
    a name covers complete word runs, so the text is cut once into windows of as many runs as names
    have, and joined on equality. A window carries the gaps beside it, and what a name has beyond
    its word runs is compared with those: no text and no pair of text and name is shuffled. The
    driver sees the distinct run counts of names, and the lengths of names without word characters.
    """
    name = F.lower("repo")
    parts = cards.where("private").select("repo", F.regexp_extract(name, rf"\A((?:{GAP})?)", 1).alias("pre"), name.alias("name")).distinct()
    core = F.regexp_replace("name", rf"\A{GAP}|{GAP}\z", "")
    private = parts.select(
        "repo", F.when(core == "", F.col("name")).otherwise(core).alias("window"), F.when(core == "", "").otherwise(F.col("pre")).alias("pre"),
        F.when(core == "", "").otherwise(F.regexp_extract("name", rf"((?:{GAP})?)\z", 1)).alias("post"),
        F.when(core == "", 0).otherwise(F.size(F.split(core, GAP, -1))).alias("runs"))
    shapes = private.where("window <> ''").groupBy("runs", F.when(F.col("runs") == 0, F.length("window")).alias("n")).count().collect()
    counts, lengths = sorted({r["runs"] for r in shapes if r["runs"]}), sorted(r["n"] for r in shapes if not r["runs"])
    flagged = published.where("private").select(F.lit("private card published").alias("problem"), "repo")
    if not shapes:
        return flagged.distinct()
    texts = published.select(F.inline(_windows(F.col("text"), counts, lengths)))
    pre, post = F.right("pre", F.lit(EDGE)), F.left("post", F.lit(EDGE))
    left = F.endswith("before", pre) & ((pre == "") | F.col("first") | (F.length("before") > F.length(pre)))
    right = F.startswith("after", post) & ((post == "") | F.col("last") | (F.length("after") > F.length(post)))
    hits = texts.join(private, "window").where(left & right)
    return hits.select(F.lit("private name published").alias("problem"), "repo").unionByName(flagged).distinct()


# --- selection and audit ----------------------------------------------------

def latest_pulls(pulls: DataFrame, bot_branch: str, n: int = 10) -> DataFrame:
    """The n latest closed pull requests of the bot's branch per repository."""
    closed = pulls.where((F.col("state") == "closed") & (F.col("branch") == bot_branch))
    return top_n(closed, ["repo"], [F.col("closed_at").desc(), F.col("number").desc()], n)


def prior_rejection(pulls: DataFrame, bot_branch: str) -> DataFrame:
    """Repositories with an unmerged one among the bot's latest closed pull requests; what people closed does not count."""
    return latest_pulls(pulls, bot_branch).where(F.col("merged_at").isNull()).select("repo").distinct()


def sweep_candidates(
    repos: DataFrame, hooks: DataFrame, readmes: DataFrame, pulls: DataFrame, bot_branch: str, prefix: str,
    include_rejected: bool = False,
) -> DataFrame:
    """(repo, has_hook, readme_bytes, placeholder, pushed_at, rejected) per active repository in scope."""
    text = F.col("text")
    readme = readmes.select(
        "repo", F.length(text).alias("readme_bytes"),
        placeholder_readme(text, F.col("repo"), "selection").alias("placeholder"))
    hooked = hooks.where(text.isNotNull()).select("repo", F.lit(True).alias("hook")).distinct()
    rejected = prior_rejection(pulls, bot_branch).withColumn("rejected", F.lit(not include_rejected))
    base = repos.where(in_scope(F.col("name"), prefix)).select(F.col("name").alias("repo"), "pushed_at")
    joined = base.join(hooked, "repo", "left").join(readme, "repo", "left").join(rejected, "repo", "left")
    return joined.select(
        "repo", F.coalesce("hook", F.lit(False)).alias("has_hook"),
        F.coalesce("readme_bytes", F.lit(0)).alias("readme_bytes"),
        F.coalesce("placeholder", F.lit(True)).alias("placeholder"), "pushed_at",
        F.coalesce("rejected", F.lit(False)).alias("rejected"),
    )


def sweep_selection(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Every repository with its list: selected (ranked), no_hook, rejected or both.

    Placeholders first, then fewest README bytes, then the oldest push. With a
    limit only that many are selected; the other eligible ones are listed as waiting.
    """
    eligible = F.col("has_hook") & ~F.col("rejected")
    order = [
        F.when(F.col("placeholder"), 0).otherwise(1), F.col("readme_bytes"),
        F.coalesce("pushed_at", F.lit("")), F.col("repo"),
    ]
    chosen = ranked(candidates.where(eligible), [], order, "rank")
    state = F.lit("selected") if limit is None else F.when(F.col("rank") <= limit, "selected").otherwise("waiting")
    rest = candidates.where(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    why = (
        F.when(~F.col("has_hook") & F.col("rejected"), "no_hook,rejected")
        .when(~F.col("has_hook"), "no_hook").otherwise("rejected")
    )
    return chosen.withColumn("list", state).unionByName(rest.withColumn("list", why))


def residual_prs(audit: DataFrame, open_pulls: DataFrame, prefix: str, bot_branch: str) -> DataFrame:
    """(repo, url): open pull requests of the bot where the hook is installed but the repository is out of scope."""
    outside = audit.where(F.col("has_hook") & ~F.startswith(F.lower("repo"), F.lit(prefix))).select("repo")
    return open_pulls.where((F.col("state") == "open") & (F.col("branch") == bot_branch)).join(outside, "repo").select("repo", "url")


def ref_type_counts(audit: DataFrame) -> DataFrame:
    hooked = audit.where("has_hook")
    kind = F.coalesce("ref_type", F.lit("no reconocida"))
    return hooked.groupBy(kind.alias("ref_type")).agg(F.count(F.lit(1)).alias("n"))


def fleet_audit_summary(audit: DataFrame, prefix: str) -> DataFrame:
    """One row of totals over the audit."""
    inside = F.startswith(F.lower("repo"), F.lit(prefix))
    hook = F.col("has_hook")
    return audit.agg(
        F.count(F.lit(1)).alias("repos"), F.count_if(inside).alias("in_scope"),
        F.count_if(inside & hook).alias("in_scope_hook"), F.count_if(inside & ~hook).alias("in_scope_no_hook"),
        F.count_if(~inside).alias("out_of_scope"), F.count_if(~inside & hook).alias("out_of_scope_hook"),
        F.count_if(F.coalesce("inherits_secrets", F.lit(False))).alias("inherit_secrets"),
        F.count_if(hook & ~F.coalesce("coherent", F.lit(False))).alias("incoherent"),
        F.count_if(hook & (F.col("ref_type") == "SHA fijado")).alias("pinned_sha"),
    )
