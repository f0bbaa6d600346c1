"""One query per operator over the given tables (and tables derived from them)."""

from __future__ import annotations

import uuid
from functools import cached_property
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import paths
from fleetlens.functions import text as T
from fleetlens.operators import (
    claims, cleanup, contract, evidence, extract, fingerprint, fleet, manifests, pii, provenance, publish, ranking,
)
from fleetlens.plans import derived as d
from fleetlens.session import checkpoint_dir
from fleetlens.sources import corpus, mentions, sinks, store
from fleetlens.sources.buckets import BucketTable
from fleetlens.streaming import gate

SCOPE = "repo_"


class Inputs:
    """Lazily built inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return d.table(self.spark, self.sf_dir, name)

    def derived(self, source: str, columns: dict[str, str]) -> DataFrame:
        return d.select(self.table(source), columns)

    @cached_property
    def tracked(self) -> DataFrame:
        return d.tracked(self.spark, self.sf_dir)

    @cached_property
    def files(self) -> DataFrame:
        return corpus.scan_corpus(self.tracked)

    @cached_property
    def signals(self) -> DataFrame:
        return extract.signals(self.files)

    def only(self, *names: str) -> DataFrame:
        return extract.signals(self.files, *names)

    @cached_property
    def manifests(self) -> DataFrame:
        return manifests.discover_manifests(self.files)

    @cached_property
    def dependencies(self) -> DataFrame:
        return manifests.declared_dependencies(self.manifests)

    @cached_property
    def evidence_rows(self) -> DataFrame:
        return provenance.technology_evidence(corpus.spread(self.files))

    @cached_property
    def technologies(self) -> DataFrame:
        return provenance.provenance_rank(self.evidence_rows)

    @cached_property
    def capabilities(self) -> DataFrame:
        return provenance.capabilities(self.files, self.technologies, self.dependencies)

    @cached_property
    def api(self) -> DataFrame:
        return evidence.api_inventory(self.only("py_routes", "js_api_calls"))

    @cached_property
    def tables(self) -> DataFrame:
        return evidence.table_inventory(self.only("sql_tables"))

    @cached_property
    def env(self) -> DataFrame:
        return evidence.env_inventory(self.only("py_env_vars", "js_env_vars"))

    @cached_property
    def repos(self) -> DataFrame:
        return self.derived("customer", d.REPOS).withColumn("topics", F.array().cast("array<string>"))

    @cached_property
    def hooks(self) -> DataFrame:
        return self.derived("customer", d.HOOKS)

    @cached_property
    def audit(self) -> DataFrame:
        return contract.hook_audit(self.hooks, d.WORKFLOW)

    @cached_property
    def pulls(self) -> DataFrame:
        return self.derived("orders", d.PULLS)

    @cached_property
    def contract_readmes(self) -> DataFrame:
        return self.derived("documents", d.README)

    @cached_property
    def documents(self) -> DataFrame:
        return self.derived("documents", d.DOCUMENT)

    @cached_property
    def guides(self) -> DataFrame:
        """The Markdown files of the corpus as texts whose claims are audited."""
        return self.files.where(F.col("ext") == ".md").select("repo", F.col("content").alias("text"))

    @cached_property
    def root_readmes(self) -> DataFrame:
        return evidence.existing_readme(self.files)

    @cached_property
    def candidates(self) -> DataFrame:
        return cleanup.deletion_candidates(self.tracked, self.files, self.only("py_imports", "js_imports"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        parts = fingerprint.fingerprint_parts(self.files, self.signals, self.manifests, self.technologies)
        return fingerprint.fingerprint(parts)

    @cached_property
    def cards(self) -> DataFrame:
        return fleet.repo_card(self.repos, self.files, self.items)

    @cached_property
    def items(self) -> DataFrame:
        return fleet.card_items(self.files, self.signals, self.manifests, self.technologies)

    @cached_property
    def commands(self) -> DataFrame:
        return claims.known_commands(manifests.npm_scripts(self.manifests), self.manifests)

    @cached_property
    def known(self) -> DataFrame:
        return claims.known_evidence(self.env, self.api, self.technologies, self.tables, self.commands)

    @cached_property
    def sections(self) -> DataFrame:
        """Derived documents cut out of responses, each under the corpus repository it talks about."""
        return extract.split_sections(self.derived("customer", d.RESPONSES)).select("repo", "corpus_repo", "document", "text")

    def scratch(self, name: str) -> str:
        return f"{checkpoint_dir(self.spark)}/fleetlens/{name}-{uuid.uuid4().hex}"


_STORES: dict[tuple[str, str], dict[tuple[str, ...], store.EvidenceStore]] = {}
_MENTIONS: dict[tuple[str, str], mentions.MentionIndex] = {}


class StoredInputs(Inputs):
    """Inputs of the queries that start from extracted evidence: landed once per session, the kinds that are read."""

    def __init__(self, spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = store.PARTS):
        super().__init__(spark, sf_dir)
        self.parts = parts

    @cached_property
    def evidence(self) -> store.EvidenceStore:
        """A store that holds at least the ``parts``; one landed for another query serves as well."""
        held = _STORES.setdefault((self.spark.sparkContext.applicationId, self.sf_dir), {})
        serving = [parts for parts in held if store.serves(parts, self.parts)]
        if not serving:
            held[self.parts] = store.land(self.files, self.scratch("store"), self.parts)
        return held[serving[0] if serving else self.parts]

    @cached_property
    def signals(self) -> DataFrame:
        return self.evidence.signals()

    def only(self, *names: str) -> DataFrame:
        return self.evidence.signals(*names)

    @cached_property
    def manifests(self) -> DataFrame:
        return self.evidence.manifests()

    @cached_property
    def mentions(self) -> mentions.MentionIndex:
        landed = (self.spark.sparkContext.applicationId, self.sf_dir)
        if landed not in _MENTIONS:
            _MENTIONS[landed] = mentions.land_mentions(self.files, self.scratch("mentions"))
        return _MENTIONS[landed]

    @cached_property
    def suspects(self) -> DataFrame:
        return cleanup.orphan_suspects(self.evidence.scan(), self.only("py_imports", "js_imports"))

    @cached_property
    def candidates(self) -> DataFrame:
        return cleanup.deletion_candidates(self.tracked, self.evidence.scan(), self.only("py_imports", "js_imports"), self.mentions)

    @cached_property
    def evidence_rows(self) -> DataFrame:
        return self.evidence.technology_evidence()

    @cached_property
    def capabilities(self) -> DataFrame:
        support = provenance.capability_corroboration(self.technologies, self.dependencies)
        return provenance.capability_signals(self.evidence.capability_hits(), support)


# Queries over extracted evidence; all others start from file contents.
FROM_STORE = {
    "evidence_sink", "card_sink", "conclusive_only", "normalize_token", "tech_for", "tech_mentioned_only",
    "capability_corroboration", "orphan_by_import", "orphan_by_mention", "verdict_join", "cleanup_summary", "fingerprint", "fingerprint_updated", "repo_card",
    "private_rollup", "run_inventory", "weak_signals", "validation_summary", "context_digest", "candidate_order",
    "manifest_order", "deletion_candidates", "claims_minus_evidence", "claims_env", "claims_endpoints",
    "claims_technologies", "claims_tables", "claims_commands", "known_commands", "env_example_rows", "api_doc_rows",
    "public_view", "inventory_rows", "card_items", "ranked_evidence", "capability_signals",
}

# The kinds of evidence that a query reads; one not named here reads all of them.
KNOWN_PARTS = ("signals", "manifest", "technologies")
PARTS_OF = (
    dict.fromkeys(("api_doc_rows", "env_example_rows", "orphan_by_import"), ("signals",))
    | dict.fromkeys(("normalize_token", "tech_for", "known_commands", "manifest_order"), ("manifest",))
    | dict.fromkeys(("ranked_evidence", "conclusive_only", "tech_mentioned_only"), ("technologies",))
    | {"orphan_by_mention": ("imports", "entry"), "run_inventory": ("signals", "manifest"), "capability_corroboration": ("manifest", "technologies")}
    | dict.fromkeys((
        "repo_card", "private_rollup", "public_view", "inventory_rows", "card_items", "card_sink", "validation_summary", "claims_minus_evidence",
        "claims_env", "claims_endpoints", "claims_technologies", "claims_tables", "claims_commands"), KNOWN_PARTS)
)

Query = Callable[[Inputs], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        REGISTRY[name] = build
        return build

    return add


def put(name: str, build: Query) -> None:
    REGISTRY[name] = build


def joined(name: str, separator: str = "|") -> Column:
    return F.array_join(F.col(name), separator).alias(name)


def path_flag(column: Callable[[], Column], name: str) -> Query:
    return lambda i: i.tracked.select("repo", "path", column().alias(name))


# --- primitives -------------------------------------------------------------

def _match_all(i: Inputs) -> DataFrame:
    python = i.files.where(F.col("language") == "Python").select("repo", "path", "content")
    return T.match_all(python, "content", extract.PY_ROUTE, {"verb": 2, "route": 3})


def _first_match(i: Inputs) -> DataFrame:
    hit = T.first_match(F.col("content"), T.rx(r"\b(react|flask|leaflet)\b", "i"))
    return i.files.select("repo", "path", hit["line"].alias("line"), hit["value"].alias("value")).where("line is not null")


put("match_all", _match_all)
put("first_match", _first_match)
put("find_line", lambda i: i.table("documents").select(
    "doc_id", T.find_line(F.col("text"), F.lit("an")).alias("line")))
put("text_lines", lambda i: T.text_lines(i.table("documents").select("doc_id", "text"), "text"))
put("normalize_text", lambda i: i.table("documents").select(
    "doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("sha")))
put("text_sha12", lambda i: i.table("documents").select("doc_id", T.text_sha12(F.col("text")).alias("sha12")))
put("normalize_newlines", lambda i: i.table("documents").select(
    "doc_id", F.sha2(T.normalize_newlines(F.concat(F.col("text"), F.lit("\r\n \n"))), 256).alias("sha")))
put("dedupe_first", lambda i: ranking.first_per_key(
    i.only("sql_tables").select("repo", "value", "file", "line"), ["repo", "value"], ["file", "line"]))

# --- sources and sinks ------------------------------------------------------

put("scan_corpus", lambda i: i.files.drop("content"))
put("read_content", lambda i: corpus.read_content(i.table("documents").select(
    "doc_id", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("0D0A")), F.unhex(F.lit("FF")),
                       F.unhex(F.lit("410D42"))).alias("bytes"))).select(
    "doc_id", F.sha2("content", 256).alias("sha")))
put("file_sha256", lambda i: corpus.file_sha256(i.tracked, "content"))
put("collect_incremental", lambda i: corpus.collect_incremental(
    i.repos, i.files.select("repo").distinct()).select("name"))


@query("evidence_sink")
def _evidence_sink(i: Inputs) -> DataFrame:
    folder = i.scratch("evidence")
    records = sinks.evidence_records(i.files, i.signals, i.manifests, i.technologies, i.capabilities, i.root_readmes)
    sinks.evidence_sink(records, folder)
    return i.spark.read.schema(records.schema).parquet(folder)


def _earlier(files: DataFrame) -> DataFrame:
    """The corpus as an earlier run may have seen it: some files missing, some different, some repositories that are gone by now."""
    repo, path = F.crc32("repo"), F.crc32("path")
    older = files.where((repo % 3 != 0) | (path % 4 != 0)).withColumn(
        "content", F.when((repo % 3 == 0) & (path % 4 == 1), F.concat(F.col("content"), F.lit("\nimport older\n"))).otherwise(F.col("content")))
    return older.unionByName(files.where((repo % 5 == 0) & (path % 4 == 2)).withColumn("repo", F.concat(F.lit("gone_"), F.col("repo"))))


@query("store_replaced")
def _store_replaced(i: Inputs) -> DataFrame:
    """Signals of a store landed from an earlier corpus and brought up to date bucket by bucket."""
    folder = i.scratch("replaced")
    store.land_changed(_earlier(i.files), folder, 32)
    return store.land_changed(i.files, folder, 32)[0].signals()


@query("evidence_replaced")
def _evidence_replaced(i: Inputs) -> DataFrame:
    """Evidence records written from an earlier corpus and brought up to date bucket by bucket."""
    folder, landed = i.scratch("records"), [None]

    def records(files: DataFrame) -> DataFrame:
        part = store.land_again(files, i.scratch("part"), landed[-1])
        landed.append(part)
        found, techs = part.manifests(), provenance.provenance_rank(part.technology_evidence())
        support = provenance.capability_corroboration(techs, manifests.declared_dependencies(found))
        caps = provenance.capability_signals(part.capability_hits(), support)
        return sinks.evidence_records(part.scan(), part.signals(), found, techs, caps, evidence.existing_readme(files))

    sinks.evidence_replace(_earlier(i.files), records, folder, 32)
    sinks.evidence_replace(i.files, records, folder, 32)
    schema = "repo string, section string, name string, detail string, file string, line bigint"
    return BucketTable(i.spark, folder, 32).read(schema)


@query("card_sink")
def _card_sink(i: Inputs) -> DataFrame:
    folder = i.scratch("cards")
    leaked = sinks.card_sink(i.cards, i.items, folder).select("repo").distinct().withColumn("named", F.lit(True))
    stored = i.spark.read.schema(i.cards.schema).json(f"{folder}/cards")
    return stored.join(leaked, "repo", "left").select(
        "repo", "private", "description", "debt", *[f"n_{n}" for n in fleet.CARD_COUNTS], joined("languages"), joined("technologies"),
        F.coalesce("named", F.lit(False)).alias("named"))


# --- projections and filters ------------------------------------------------

put("path_excluded", path_flag(lambda: paths.path_excluded(F.col("path"), F.array(F.lit("docs"), F.lit("LICENSE"))), "excluded"))
put("path_third_party", path_flag(lambda: paths.path_third_party(F.col("path")), "third_party"))
put("language_of", path_flag(lambda: paths.language_of(F.lower(paths.suffix_of(F.col("path")))), "language"))
put("is_text_file", path_flag(lambda: paths.is_text_file(
    F.lower(paths.suffix_of(F.col("path"))), paths.name_of(F.col("path"))), "text"))
put("analysis_scope", lambda i: corpus.analysis_scope(i.files).select("repo", "path", "size"))
put("in_scope_repo", lambda i: i.hooks.select("repo", paths.in_scope(F.col("repo"), SCOPE).alias("in_scope")))
put("active_repo", lambda i: corpus.active_repo(i.repos, ("repo_1", "repo_2")).select("name"))
put("size_gate", lambda i: corpus.size_gate(i.repos).select("name", "size", "omitted_reason"))
put("test_path", path_flag(lambda: paths.test_path(F.col("path")), "test"))
put("protected_path", path_flag(lambda: paths.protected_path(F.col("path")), "protected"))
put("entry_point", lambda i: i.files.select("repo", "path", paths.entry_point(F.col("content")).alias("entry")))
put("conclusive_only", lambda i: provenance.conclusive_only(i.technologies).select(
    "repo", "tech", "provenance", "confidence"))
put("deployment_files", lambda i: evidence.deployment_files(i.files))
put("gitignore_anchored", lambda i: i.tracked.join(pii.gitignore_patterns(i.files), "repo", "left").select(
    "repo", "path", paths.gitignore_anchored(F.col("path"), F.col("patterns")).alias("ignored")))

# --- extraction -------------------------------------------------------------

for _name in extract.EXTRACTORS:
    put(_name, lambda i, n=_name: i.only(n).drop("third_party"))
put("sql_operation_counts", lambda i: extract.sql_operation_counts(i.files))


@query("html_assets")
def _html_assets(i: Inputs) -> DataFrame:
    """Corpus pages with the default tags, and the crawled pages with anchors as well."""
    crawled = i.table("pages").select(
        F.lit("pages").alias("repo"), F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.lit("HTML").alias("language"), F.lit(False).alias("third_party"), F.col("html").alias("content"))
    needles = (("the", "The"), ("example", "Example"))
    wide = extract.html_assets(crawled, needles, "script|link|a")
    return extract.html_assets(i.files).unionByName(wide)


put("tech_mentions", lambda i: provenance.tech_mentions(i.files))
put("citation_extract", lambda i: extract.citation_extract(i.sections))
put("split_sections", lambda i: extract.split_sections(i.derived("customer", d.RESPONSES)).drop("corpus_repo"))
put("parse_verdict", lambda i: extract.parse_verdict(i.derived("customer", d.REPLIES)))
put("strip_fence", lambda i: i.table("documents").select("doc_id", F.sha2(T.strip_fence(
    F.concat(F.lit("  ```markdown\n"), F.col("text"), F.lit("\n```\n"))), 256).alias("sha")))

# --- manifests --------------------------------------------------------------

put("discover_manifests", lambda i: i.manifests.select(
    "repo", "path", "kind", "third_party", "depth", "project_name", F.size("dependencies").alias("n_dependencies"),
    F.size("scripts").alias("n_scripts")))
put("npm_dependencies", lambda i: manifests.npm_dependencies(i.files))
put("npm_scripts", lambda i: manifests.npm_scripts(i.manifests))
put("requirements_dependencies", lambda i: manifests.requirements_dependencies(i.files))
put("pyproject_dependencies", lambda i: manifests.pyproject_dependencies(i.files))
put("docker_images", lambda i: manifests.docker_images(i.files))
put("compose_images", lambda i: manifests.compose_images(i.files))
put("declared_dependencies", lambda i: i.dependencies)
put("root_dependencies", lambda i: manifests.root_dependencies(i.files))

# --- joins ------------------------------------------------------------------

put("normalize_token", lambda i: i.dependencies.select(
    "repo", "file", "line", "name", provenance.normalize_token(F.col("name")).alias("token")))
put("tech_for", lambda i: i.dependencies.select(
    "repo", "file", "line", "name", provenance.tech_for(F.col("name")).alias("tech")))
put("tech_declared", lambda i: provenance.tech_declared(i.files).select("repo", "tech", "file", "line", "detail"))
put("tech_imported", lambda i: provenance.tech_imported(i.files).select("repo", "tech", "file", "line", "detail"))
put("tech_mentioned_only", lambda i: provenance.tech_mentioned_only(i.technologies))
put("capability_corroboration", lambda i: provenance.capability_corroboration(i.technologies, i.dependencies))
put("pii_ignore_status", lambda i: pii.pii_ignore_status(
    pii.pii_scan(i.files), pii.gitignore_patterns(i.files)).select("repo", "path", "mark", "ignored_anchored"))
put("orphan_by_import", lambda i: cleanup.orphan_by_import(
    i.files, i.only("py_imports", "js_imports")).select("repo", "path", "stem"))
put("orphan_by_mention", lambda i: i.mentions.unmentioned(i.suspects).select("repo", "path", "stem"))
put("variant_of", lambda i: cleanup.variant_of(i.files))


@query("verdict_join")
def _verdict_join(i: Inputs) -> DataFrame:
    verdicts = i.tracked.where(F.col("path").endswith("_old.py")).select(
        "repo", "path", F.when(F.col("path").contains("7"), "borrar").otherwise("revisar").alias("verdict"),
        F.lit("leido").alias("reason"))
    invented = i.repos.select(
        F.col("name").alias("repo"), F.lit("no/existe.py").alias("path"), F.lit("borrar").alias("verdict"),
        F.lit("x").alias("reason"))
    return cleanup.verdict_join(i.candidates, verdicts.unionByName(invented))


put("citation_check", lambda i: publish.citation_check(i.sections, i.files))
put("manifest_seal", lambda i: publish.manifest_seal(
    i.sections.where("document = 'MANIFIESTO.yaml'"), corpus.file_sha256(i.files, "content")))


@query("leak_check")
def _leak_check(i: Inputs) -> DataFrame:
    described = i.repos.select(F.col("name").alias("repo"), "private", "description")
    leaked = fleet.public_view(described).unionByName(
        described.where(F.col("private") & (F.col("repo").endswith("13"))))
    return fleet.leak_check(sinks.card_json(leaked), described)


put("prior_rejection", lambda i: fleet.prior_rejection(i.pulls, d.BOT_BRANCH))
put("residual_prs", lambda i: fleet.residual_prs(i.audit, i.derived("orders", d.OPEN_PULLS), SCOPE, d.BOT_BRANCH))

# --- aggregations -----------------------------------------------------------

put("provenance_rank", lambda i: i.technologies.select(
    "repo", "tech", "provenance", "confidence", "n_evidence", "file", "line", "detail"))
put("ranked_evidence", lambda i: provenance.ranked_evidence(i.evidence_rows).drop("depth"))
put("capability_signals", lambda i: i.capabilities)
put("env_inventory", lambda i: i.env)
put("api_inventory", lambda i: i.api)
put("table_inventory", lambda i: i.tables)
put("structure_counts", lambda i: evidence.structure_counts(i.files))
put("language_counts", lambda i: evidence.language_counts(i.files))


@query("pii_scan")
def _pii_scan(i: Inputs) -> DataFrame:
    """The corpus and the given documents as text files of their source."""
    texts = i.table("documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("doc/d"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.length("text").cast("bigint").alias("size"), F.col("text").alias("content"))
    found = pii.pii_scan(i.files.unionByName(corpus.scan_corpus(texts)))
    return found.select(
        "repo", "path", "sha256", "reason", "counts.*", "in_test_path", joined("special_category"), "mark")


put("personal_emails", lambda i: pii.personal_emails(i.documents))
put("cleanup_summary", lambda i: cleanup.cleanup_summary(i.candidates, i.files))
put("fingerprint", lambda i: i.fingerprints)


@query("fingerprint_updated")
def _fingerprint_updated(i: Inputs) -> DataFrame:
    """Prints held from an earlier corpus, updated from the files that changed, came or went since."""
    now = fingerprint.file_parts(i.evidence.scan(), i.signals, i.manifests, i.evidence_rows)
    path = F.crc32("path")
    came, changed, went = path % 5 == 0, path % 3 == 0, path % 7 == 0
    then = now.where(~came).withColumn("entry", F.when(changed, F.concat("entry", F.lit("~"))).otherwise(F.col("entry")))
    older = now.where(went).withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    held = fingerprint.repo_prints(fingerprint.file_prints(then.unionByName(older)))
    before = fingerprint.file_prints(then.where(changed).unionByName(older))
    after = fingerprint.file_prints(now.where(came | changed))
    return fingerprint.print_sha(fingerprint.updated_prints(held, before, after))


put("health_facts", lambda i: fleet.health_facts(i.files))
put("repo_card", lambda i: i.cards.select(
    "repo", "private", "debt", *[f"n_{n}" for n in fleet.CARD_COUNTS], joined("languages"), joined("technologies")))
put("card_items", lambda i: i.items)
put("private_rollup", lambda i: fleet.private_rollup(i.cards))
put("ref_type_counts", lambda i: fleet.ref_type_counts(i.audit))
put("fleet_audit_summary", lambda i: fleet.fleet_audit_summary(i.audit, SCOPE))
put("run_inventory", lambda i: evidence.run_inventory(i.files, i.manifests, i.api, i.tables, i.env))
put("weak_signals", lambda i: provenance.weak_signals(i.capabilities).select("repo", joined("weak")))
put("validation_summary", lambda i: claims.validation_summary(
    i.guides.select("repo").distinct(), claims.claims(i.guides),
    claims.claims_minus_evidence(claims.claims(i.guides), i.known).unionByName(claims.claims_structure(i.guides))))
put("publish_gate", lambda i: publish.publish_gate(i.sections, i.files).withColumn("missing", joined("missing")))
put("context_digest", lambda i: evidence.context_digest(evidence.digest_lines(
    i.files, i.signals, i.manifests, i.technologies, i.capabilities, i.root_readmes,
    contract.config_resolve(i.derived("customer", d.CONFIG)).select("repo", "declared").join(
        i.files.select("repo").distinct(), "repo", "left_semi"))))

# --- windows ----------------------------------------------------------------

put("evidence_top_n", lambda i: provenance.evidence_top_n(provenance.technology_evidence(i.files), 5).select(
    "repo", "tech", "rank", "n", "file", "line", "detail"))
put("carry_path", lambda i: publish.carry_path(i.sections).drop("corpus_repo"))
put("block_pairing", lambda i: contract.block_pairing(i.contract_readmes))
put("latest_pulls", lambda i: fleet.latest_pulls(i.pulls, d.BOT_BRANCH).select("repo", "rank", "number", "closed_at", "merged_at"))
put("summary_lines", lambda i: evidence.summary_lines(i.contract_readmes))

# --- sorts and top-k --------------------------------------------------------

put("important_files", lambda i: evidence.important_files(i.files))
put("debt_score", lambda i: fleet.debt_score(fleet.health_facts(i.files)).select("repo", "debt"))
put("debt_ranking", lambda i: fleet.debt_ranking(fleet.debt_score(fleet.health_facts(i.files))).select("repo", "debt", "rank"))


@query("sweep_selection")
def _sweep_selection(i: Inputs) -> DataFrame:
    active = corpus.active_repo(i.repos)
    return fleet.sweep_selection(fleet.sweep_candidates(active, i.hooks, i.root_readmes, i.pulls, d.BOT_BRANCH, "repo_1"))


put("candidate_order", lambda i: cleanup.candidate_order(i.candidates))
put("pii_order", lambda i: pii.pii_order(pii.pii_scan(i.files)).select("repo", "path", "rank"))
put("manifest_order", lambda i: manifests.manifest_order(i.manifests).select("repo", "path", "rank"))

# --- sets -------------------------------------------------------------------

put("deletion_candidates", lambda i: i.candidates)
put("claims_minus_evidence", lambda i: claims.claims_minus_evidence(claims.claims(i.guides), i.known))
put("config_unknown_keys", lambda i: i.derived("customer", d.CONFIG).select(
    "repo", F.array_join(contract.config_unknown_keys(F.from_json("raw", "map<string,string>")), "|").alias("unknown")))
put("missing_documents", lambda i: publish.missing_documents(i.sections).select("repo", joined("missing")))
put("union_signals", lambda i: i.signals)

# --- claims -----------------------------------------------------------------


def audited(*kinds: str) -> Query:
    return lambda i: claims.claims_minus_evidence(claims.claims(i.guides, *kinds), i.known)


put("claims_env", audited("env"))
put("claims_endpoints", audited("endpoint"))
put("claims_technologies", audited("technology"))
put("claims_tables", audited("table"))
put("claims_commands", audited("command"))
put("known_commands", lambda i: i.commands)
put("normalize_command", lambda i: i.guides.select(
    "repo", F.explode(T.lines_of(F.col("text"))).alias("line")).select(
    "repo", T.normalize_command(F.col("line")).alias("command")).distinct())
put("claims_structure", lambda i: claims.claims_structure(i.documents.select(
    F.concat("repo", F.lit("/"), "document").alias("repo"), "text")))

# --- decisions --------------------------------------------------------------

put("placeholder_readme", lambda i: i.contract_readmes.select(
    "repo", contract.placeholder_readme(F.col("text"), F.col("repo")).alias("contract"),
    contract.placeholder_readme(F.col("text"), F.col("repo"), "selection").alias("selection")))
put("merge_action", lambda i: i.contract_readmes.select(
    "repo", contract.merge_action(F.col("text"), F.col("repo")).alias("action")))
put("managed_blocks", lambda i: contract.managed_blocks(i.contract_readmes).drop("content"))
put("merge_blocks", lambda i: contract.merge_blocks(
    i.contract_readmes.withColumn("generated", F.concat(F.lit("# nuevo "), F.col("repo"), F.lit("  \n\n")))).select(
    "repo", "action", F.sha2("content", 256).alias("sha"), joined("conflicts")))
put("fingerprint_read", lambda i: i.contract_readmes.select(
    "repo", contract.fingerprint_read(F.col("text")).alias("sealed")))
put("fingerprint_seal", lambda i: i.contract_readmes.select("repo", F.sha2(contract.fingerprint_seal(
    F.col("text"), F.sha2("repo", 256)), 256).alias("sha")))


def _gate_inputs(i: Inputs) -> DataFrame:
    """Current fingerprints of the readme scope: some equal to the seal."""
    number = F.substring_index("repo", "_", -1).cast("bigint")
    return i.contract_readmes.select(
        "repo", F.when(number % 2 == 0, d.SEAL).otherwise(F.sha2("repo", 256)).alias("sha"))


put("change_gate", lambda i: contract.change_gate(i.contract_readmes, _gate_inputs(i)))


@query("plan_actions")
def _plan_actions(i: Inputs) -> DataFrame:
    number = F.substring_index("repo", "_", -1).cast("bigint")
    config = i.contract_readmes.select("repo", (number % 5 != 0).alias("enabled"))
    counts = i.contract_readmes.where(number % 3 == 0).select("repo", (number % 4).alias("candidates"))
    return contract.plan_actions(config, i.contract_readmes, _gate_inputs(i), counts)


put("config_resolve", lambda i: contract.config_resolve(i.derived("customer", d.CONFIG)).withColumn(
    "ignore_paths", joined("ignore_paths")).withColumn("warnings", joined("warnings")))
put("human_inputs_guard", lambda i: publish.human_inputs_guard(i.sections))
put("env_example_rows", lambda i: evidence.env_example_rows(i.env))
put("api_doc_rows", lambda i: evidence.api_doc_rows(i.api))
put("public_view", lambda i: fleet.public_view(i.cards).select(
    "repo", "description", "html_url", "debt", *[f"n_{n}" for n in fleet.CARD_COUNTS], joined("languages"), joined("technologies")))
put("inventory_rows", lambda i: fleet.inventory_rows(i.cards))
put("hook_audit", lambda i: i.audit)
put("ref_class", lambda i: i.audit.where("ref is not null").select("repo", contract.ref_class(F.col("ref")).alias("kind")))
put("hook_drift", lambda i: contract.hook_drift(
    i.repos.select(F.col("name").alias("repo")), i.hooks, d.DESIRED_HOOK))

# --- streaming --------------------------------------------------------------


@query("stream_change_gate")
def _stream_change_gate(i: Inputs) -> DataFrame:
    """The events arrive in four parts; the stream is started anew for each and goes on from its state."""
    folder, events = i.scratch("gate"), i.table("events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg(F.percentile_approx(micros, [0.25, 0.5, 0.75], 1000)).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges, edges[1:]):
        part = events if low is None else events.where(micros >= low)
        (part if high is None else part.where(micros < high)).write.mode("append").parquet(f"{folder}/in")
        arriving = i.spark.readStream.schema(events.schema).parquet(f"{folder}/in").select(
            F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("sha"),
            gate.sequence(F.col("ts").cast("timestamp"), F.col("event_id")).alias("seq"))
        gate.stream_change_gate(arriving, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return gate.read_changes(i.spark, f"{folder}/out").select("repo", "sha", F.col("tie").alias("event_id"))


def _streamed(i: Inputs, kind: str, like: DataFrame) -> DataFrame:
    folder = i.scratch("stream")
    orders = i.spark.readStream.schema(i.table("orders").schema).option("pathGlobFilter", "orders.parquet").parquet(i.sf_dir)
    arriving = d.select(orders, d.CORPUS).selectExpr("repo", "path", "cast(length(content) as bigint) AS size", "content")
    gate.stream_evidence(arriving, f"{folder}/out", f"{folder}/checkpoint", kind).awaitTermination()
    return i.spark.read.schema(like.schema).parquet(f"{folder}/out")


put("stream_evidence", lambda i: _streamed(i, "signals", i.signals))
put("stream_pii", lambda i: _streamed(i, "pii", pii.pii_scan(i.files)).select(
    "repo", "path", "sha256", "reason", "counts.*", "in_test_path", joined("special_category"), "mark"))


def _widen(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines report one type."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint")
        else F.col(f.name)
        for f in df.schema.fields
    ])


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = REGISTRY[name]
    if name in FROM_STORE:
        return lambda spark, sf_dir: _widen(build(StoredInputs(spark, sf_dir, PARTS_OF.get(name, store.PARTS))))
    return lambda spark, sf_dir: _widen(build(Inputs(spark, sf_dir)))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(name) for name in REGISTRY}
