"""Operators on small literal fixtures and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import paths
from fleetlens.operators import (
    claims, cleanup, contract, evidence, extract, fingerprint, fleet, manifests, pii, provenance, publish, ranking,
)
from fleetlens.sources import sinks
from fleetlens.streaming import gate


def listed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_python_signals(corpus_of):
    files = corpus_of({"a.py": "import os, sys as s\nfrom . import x\nfrom .m import y\nasync def f():\n  os.environ['A_B']\n"})
    assert listed(extract.signals(files), "kind", "value", "line") == [
        ("env_var", "A_B", 5), ("function", "f", 4), ("import", "m", 3), ("import", "os", 1), ("import", "sys", 1)]


def test_npm_sections_and_lines(corpus_of):
    files = corpus_of({"w/package.json": '{"name": "x",\n"dependencies": {"react": "^1"},\n"devDependencies": {"vite": "5"}, "scripts": {"b": "vite build"}}'})
    found = manifests.discover_manifests(files)
    assert listed(manifests.declared_dependencies(found), "name", "version", "section", "line") == [
        ("react", "^1", "dependencies", 2), ("vite", "5", "devDependencies", 3)]
    assert listed(manifests.npm_scripts(found), "name", "command", "line") == [("b", "vite build", 3)]
    assert corpus_of({"package.json": "{not json"}).transform(manifests.discover_manifests).first()["dependencies"] == []


def test_word_lists_conclude_nothing(corpus_of):
    """A detector that lists technology names must not find them in itself."""
    text = "WORDS = ['react', 'flask', 'pandas', 'leaflet', 'yolo', 'login', 'upload']\nfor node in tree: pass\n"
    files = corpus_of({"detector.py": text})
    techs = provenance.technologies(files)
    assert techs.count() > 0
    assert provenance.conclusive_only(techs).count() == 0
    deps = manifests.declared_dependencies(manifests.discover_manifests(files))
    assert provenance.capabilities(files, techs, deps).count() == 0


def test_strongest_provenance_wins(corpus_of):
    files = corpus_of({
        "package.json": '{"dependencies": {"react": "1"}}', "a.jsx": 'import R from "react"', "i.html": '<script src="x/react.js">',
        "m.html": '<link href="leaflet.css">', "n.md": "docker"})
    assert listed(provenance.technologies(files), "tech", "provenance", "confidence") == [
        ("Docker", "mentioned", "low"), ("Leaflet", "vendored", "medium"), ("Node.js", "declared", "high"),
        ("React", "declared", "high")]


def test_pii_reports_counts_only(corpus_of):
    files = corpus_of({
        "a.txt": "12.345.678-5 y 11111111-1, ana@gob.cl rut", "form.html": "<label>rut telefono</label>",
        "tests/fixtures/x.json": "1.234.567-k", "d.csv": "a", "s.md": "diagnostico 1234567-8"})
    found = {r["path"]: r for r in pii.pii_scan(files).collect()}
    assert set(found) == {"a.txt", "tests/fixtures/x.json", "d.csv", "s.md"}
    assert tuple(found["a.txt"]["counts"]) == (2, 1, 0, 1) and found["a.txt"]["mark"] == "[PENDIENTE]"
    assert found["tests/fixtures/x.json"]["mark"] == "[VERIFICAR]" and found["s.md"]["mark"] == "[VERIFICAR]"
    assert "12.345.678-5" not in str(found) and "ana@gob.cl" not in str(found)


def candidates(corpus_of, contents):
    tracked, files = corpus_of(contents, scan=False), corpus_of(contents)
    found = cleanup.deletion_candidates(tracked, files, extract.signals(files, "py_imports", "js_imports"))
    return {r["path"]: r["category"] for r in found.collect()}


def test_deletion_candidates(corpus_of):
    got = candidates(corpus_of, {
        "modulo.py": "x = 1", "modulo_old.py": "x = 0", "solo_old.py": "y", "guia.md": "# Guia", "util.py": "def f(): pass",
        "b.py": "import util", "run_me.py": "if __name__ == '__main__': pass", "a/__pycache__/m.pyc": "z",
        "README_CANDIDATE.md": "x", "plugins/t/plugin.js": "v", "tests/test_z.py": "z", "named.py": "q", "c.js": "// my_named_x"})
    assert got == {
        "modulo_old.py": "variante o respaldo", "solo_old.py": "huerfano aparente", "a/__pycache__/m.pyc": "resto de build o entorno",
        "README_CANDIDATE.md": "artefacto del generador", "modulo.py": "huerfano aparente", "b.py": "huerfano aparente"} | {
        k: v for k, v in got.items() if k == "c.js"}
    assert "named.py" not in got


def test_orphan_by_mention_like_brute_force(spark, corpus_of):
    random.seed(7)
    stems = ["ab", "abc", "my-comp", "a (1)", "foo.test", "x", "ñu", "util", "zz top", "q_1"]
    contents = {}
    for n in range(60):
        words = [random.choice(stems + ["my_utils", "xx-my-comp-y", "la a (1) b", "foo.tests", "yñus"]) for _ in range(2)]
        contents[(f"r{n % 3}", f"d{n}/{random.choice(stems)}.py")] = "\n".join(words[: random.randint(0, 2)])
    files = corpus_of(contents)
    suspects = files.select("repo", "path", paths.stem_of(F.col("path")).alias("stem"))
    rows = suspects.collect()
    texts = [(r["repo"], r["stem"], contents[(r["repo"], r["path"])]) for r in rows]
    expected = sorted(
        (r["repo"], r["path"]) for r in rows
        if not any(repo == r["repo"] and stem != r["stem"] and r["stem"] in text for repo, stem, text in texts))
    assert listed(cleanup.orphan_by_mention(suspects, files), "repo", "path") == expected
    assert 0 < len(expected) < len(rows)


def test_verdicts(spark):
    found = spark.createDataFrame([("r", "a", 1, "c", "alta"), ("r", "b", 1, "c", "alta")],
                                  "repo string, path string, size bigint, category string, confidence string")
    said = spark.createDataFrame([("r", "a", "borrar", "x"), ("r", "inventado", "borrar", "y")],
                                 "repo string, path string, verdict string, reason string")
    assert listed(cleanup.verdict_join(found, said), "path", "verdict") == [("a", "borrar"), ("b", "revisar")]


BLOCK = "<!-- AI:BEGIN id=a sha={} -->\ncuerpo\n<!-- AI:END id=a -->"


def test_readme_contract(spark):
    from hashlib import sha256

    sha = sha256(b"cuerpo").hexdigest()[:12]
    rows = [
        ("human", "x" * 300, "respetado"), ("lock", "<!-- ai-readme:lock -->\n" + BLOCK.format(sha), "bloqueado"),
        ("none", None, "creado"), ("short", "# short", "creado"), ("block", BLOCK.format(sha), "fusionado"),
        ("titled", "# Titled\n\n" + " " * 400, "creado"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "repo string, text string")
    assert listed(df.select("repo", contract.merge_action(F.col("text"), F.col("repo")).alias("a")), "repo", "a") == sorted(
        (r[0], r[2]) for r in rows)
    merged = spark.createDataFrame(
        [("ok", "t\r\n" + BLOCK.format(sha).replace("\n", "\r\n") + "\nfin", "nuevo "), ("frozen", BLOCK.format("dead"), "nuevo")],
        "repo string, text string, generated string")
    got = {r["repo"]: r for r in contract.merge_blocks(merged).collect()}
    new = sha256(b"nuevo").hexdigest()[:12]
    assert got["ok"]["content"] == f"t\r\n<!-- AI:BEGIN id=a sha={new} -->\nnuevo\n<!-- AI:END id=a -->\nfin\n"
    assert (got["frozen"]["action"], got["frozen"]["conflicts"]) == ("respetado", ["a"])


def test_seal_is_idempotent(spark):
    df = spark.createDataFrame([("# x\n",)], "text string")
    once = contract.fingerprint_seal(F.col("text"), F.lit("a" * 64))
    twice = contract.fingerprint_seal(once, F.lit("a" * 64))
    row = df.select(once.alias("o"), twice.alias("t"), contract.fingerprint_read(once).alias("r")).first()
    assert row["o"] == row["t"] and row["r"] == "a" * 64


def test_config(spark):
    raws = {"none": None, "bad": "[1", "list": "[1]", "off": '{"enabled": false}', "lang": '{"lang": "FR"}',
            "text": '{"ignore_paths": " a "}', "odd": '{"zz": 1}'}
    df = spark.createDataFrame([(k, v) for k, v in raws.items()], "repo string, raw string")
    got = {r["repo"]: r for r in contract.config_resolve(df).collect()}
    assert got["none"]["enabled"] and not got["none"]["present"] and got["none"]["warnings"] == []
    assert got["bad"]["warnings"] and got["list"]["warnings"] and got["lang"]["warnings"] and got["odd"]["warnings"]
    assert not got["off"]["enabled"] and got["lang"]["lang"] == "es" and got["text"]["ignore_paths"] == ["a"]


def prints(corpus_of, contents):
    files = corpus_of(contents)
    parts = fingerprint.fingerprint_parts(
        files, extract.signals(files), manifests.discover_manifests(files), provenance.technologies(files))
    return fingerprint.fingerprint(parts).first()


BASE = {"requirements.txt": "flask==1\npandas", "app.py": "import flask\n@app.get('/a')\ndef f(): pass"}


def test_fingerprint_moves_only_with_the_software(corpus_of):
    base = prints(corpus_of, BASE)["sha"]
    still = [BASE | {"app.py": "\n\n" + BASE["app.py"]}, BASE | {"notas.md": "habla de redis"}]
    plugin = [prints(corpus_of, BASE | {"plugins/p/requirements.txt": t})["sha"] for t in ("django", "numpy==2")]
    assert plugin[0] == plugin[1]
    moved = [BASE | {"requirements.txt": "flask==2\npandas"}, BASE | {"requirements.txt": "flask==1\npandas\nredis"},
             BASE | {"app.py": BASE["app.py"].replace("/a", "/b")}, BASE | {"q.sql": "create table t (a int)"}]
    assert all(prints(corpus_of, c)["sha"] == base for c in still)
    assert all(prints(corpus_of, c)["sha"] != base for c in moved)


def test_fingerprint_has_one_rule(corpus_of):
    """Also the 151st endpoint and table move it, and the order of files does not."""
    many = BASE | {"r.py": "\n".join(f"@app.get('/p{n}')" for n in range(160)), "t.sql": "\n".join(f"create table t{n} (a int);" for n in range(160))}
    one, again = prints(corpus_of, many), prints(corpus_of, dict(reversed(many.items())))
    assert one == again and one["buckets"] > 300
    for more in ({"r2.py": "@app.get('/p160')"}, {"z.sql": "create table t160 (a int);"}):
        assert prints(corpus_of, many | more)["sha"] != one["sha"]
    assert prints(corpus_of, {"n.md": "x"})["buckets"] == 0


def evidence_of(files):
    signals, found, evidence_rows = extract.signals(files), manifests.discover_manifests(files), provenance.technology_evidence(files)
    techs = provenance.provenance_rank(evidence_rows)
    return signals, found, techs, provenance.capabilities(files, techs, manifests.declared_dependencies(found))


def test_evidence_sink_replaces(spark, corpus_of, tmp_path):
    files = corpus_of(BASE | {"README.md": "# r\nhola", "many.py": "\n".join(f"@app.get('/p{n}')" for n in range(160))})
    signals, found, techs, caps = evidence_of(files)
    records = sinks.evidence_records(files, signals, found, techs, caps, evidence.existing_readme(files))
    for _ in range(2):
        sinks.evidence_sink(records, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == records.count()
    sections = {r["section"]: r["n"] for r in stored.groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert sections["files"] == 4 and sections["api"] == 161 and sections["readme"] == 2


def test_nothing_is_cut_by_size(corpus_of):
    big = "x" * 3_000_000
    files = corpus_of({"d.txt": big + " 12.345.678-5 ana@gob.example.cl", "a.py": "import flask\n#" + "y" * 6_000_000 + "\n@app.get('/z')\n"})
    assert listed(pii.pii_scan(files), "path") == [("d.txt",)]
    assert listed(extract.signals(files, "py_routes"), "value", "line") == [("/z", 3)]


def test_claims_know_every_endpoint(spark, corpus_of):
    files = corpus_of({"r.py": "\n".join(f"@app.get('/p{n}')" for n in range(160))})
    readmes = spark.createDataFrame([("r", "GET /p155")], "repo string, text string")
    signals, found, techs, _ = evidence_of(files)
    known = claims.known_evidence(
        evidence.env_inventory(signals), evidence.api_inventory(signals), techs, evidence.table_inventory(signals),
        claims.known_commands(manifests.npm_scripts(found), found))
    assert claims.claims_minus_evidence(claims.claims(readmes, "endpoint"), known).count() == 0


def test_mentions_in_large_files_count(corpus_of):
    got = candidates(corpus_of, {"lonely.js": "a", "notas.txt": "z" * 2_000_000 + " lonely "})
    assert "lonely.js" not in got


def test_cards_stop_at_leaks(spark, tmp_path):
    rows = [("uno", False, "sucesor de DOS", 5), ("dos", True, "x", 0)]
    cards = spark.createDataFrame(rows, "repo string, private boolean, description string, readme_bytes int")
    for flag in ("readme_placeholder", "has_license", "has_tests", "has_ci"):
        cards = cards.withColumn(flag, F.lit(False))
    items = spark.createDataFrame([("uno", "tables", "t", 1)], "repo string, field string, value string, n bigint")
    assert listed(sinks.card_sink(cards, items, str(tmp_path / "a")), "repo") == [("dos",)]
    assert not (tmp_path / "a/public").exists()
    quiet = cards.withColumn("description", F.lit("nada"))
    assert sinks.card_sink(quiet, items, str(tmp_path / "b")).isEmpty()
    assert listed(spark.read.json(str(tmp_path / "b/public/cards")), "repo") == [("uno",)]


def test_claims(spark, corpus_of):
    readmes = spark.createDataFrame([("r", "Usa Redis y `X_Y`.\nGET /a y POST /zz\nnpm run build  # c\nnpm run no\n")], "repo string, text string")
    files = corpus_of(BASE | {"package.json": '{"scripts": {"build": "x"}}'})
    signals, found = extract.signals(files), manifests.discover_manifests(files)
    known = claims.known_evidence(
        evidence.env_inventory(signals), evidence.api_inventory(signals), provenance.technologies(files),
        evidence.table_inventory(signals), claims.known_commands(manifests.npm_scripts(found), found))
    got = claims.claims_minus_evidence(claims.claims(readmes), known)
    assert listed(got, "kind", "value", "severity") == [
        ("command", "npm run no", "warning"), ("endpoint", "POST /zz", "error"), ("env", "X_Y", "warning"),
        ("technology", "Redis", "warning")]


def test_citations(spark, corpus_of):
    files = corpus_of({"frontend/package.json": "{}", ".mcp.json": "{}"})
    docs = spark.createDataFrame(
        [("r", "a.md", "[package.json] [./.mcp.json:3] [auth.py:15] [INFERIDO]"), ("r", "INFORME", "[no.py]")],
        "repo string, document string, text string")
    assert listed(publish.citation_check(docs, files), "cited", "valid") == [
        (".mcp.json", True), ("auth.py", False), ("package.json", True)]


def test_leaks_like_brute_force(spark):
    names = ["repo", "my-repo", "repo-x", "a.b", ".hid", "archivo_log", "archivo", "end-", "ñ", "--", "-..hid", "a--b"]
    texts = ["usa REPO y my-repo", "COIN_ARCHIVO_LOG", "a.b.c", "x.hid", "xrepo repos", "repo-xy end-.", "archivo", "añb ñ", "ñ", "a--b", "x -- y",
             "--", "x-..hid", " -..hid", ".-..hid.", "end-", "end-x", "end--", ""]
    cards = spark.createDataFrame([(n, True) for n in names], "repo string, private boolean")
    for text in texts:
        published = spark.createDataFrame([("pub", text, False)], "repo string, text string, private boolean")
        expected = sorted(
            n for n in names if re.search(r"(?<![A-Za-z0-9_])" + re.escape(n) + r"(?![A-Za-z0-9_])", text, re.I))
        assert [r[0] for r in listed(fleet.leak_check(published, cards), "repo")] == expected


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranked_like_brute_force(spark, keys):
    random.seed(3)
    rows = [("hot" if n % 3 else f"c{n % 5}", n) for n in random.sample(range(1000), 500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = {(r["k"], r["v"]): r["rank"] for r in ranking.ranked(df, keys, [F.col("v").desc()], "rank").collect()}
    for k, v in rows:
        assert got[(k, v)] == 1 + sum(1 for k2, v2 in rows if v2 > v and (not keys or k2 == k))


def test_changes_over_batches(spark):
    random.seed(5)
    rows = [("hot" if n % 2 else f"c{n % 7}", random.choice("ab"), n * 600, n) for n in range(400)]
    df = spark.createDataFrame(rows, "repo string, sha string, sec long, id long").select(
        "repo", "sha", gate.sequence(F.timestamp_seconds("sec"), F.col("id")).alias("seq"))
    last, expected = {}, []
    for repo, sha, _, n in rows:
        if last.get(repo) != sha:
            expected.append(n)
        last[repo] = sha
    whole = [r[0] for r in gate.changes(df).select("seq.tie").collect()]
    first, second = df.where("seq.tie < 150"), df.where("seq.tie >= 150")
    state = first.groupBy("repo").agg(F.max_by("sha", "seq").alias("sha"))
    parts = gate.changes(first).unionByName(gate.changes(second, state)).select("seq.tie").collect()
    assert sorted(whole) == expected == sorted(r[0] for r in parts)


def test_digest_sections(spark, corpus_of):
    files = corpus_of(BASE | {"README.md": "# r\n![b](x)\nhola", "Dockerfile": "FROM python"})
    signals, found, techs, caps = evidence_of(files)
    declared = spark.createDataFrame([("r", " testimonio ")], "repo string, declared string")
    args = (files, signals, found, techs, caps, evidence.existing_readme(files), declared)
    row = evidence.context_digest(evidence.digest_lines(*args)).first()
    lines = row["text"].split("\n")
    assert lines[0] == "declared by people: testimonio" and not row["truncated"] and row["cut_sections"] == ""
    for line in ("GET /a [app.py:2]", "flask==1 [requirements.txt:1]", "key file: requirements.txt", "app.py: 0 classes, 1 functions, 1 imports",
                 "deployment: Dockerfile", "hola", "technology: Flask declared requirements.txt:1"):
        assert line in lines
    cut = evidence.context_digest(evidence.digest_lines(*args), max_chars=40).first()
    assert cut["text"] == row["text"][:40] and cut["truncated"]
    short = evidence.context_digest(evidence.digest_lines(*args, limits={"python": 1})).first()
    assert short["cut_sections"] == "6"


def test_mentions_in_one_long_line(spark, corpus_of):
    """A line of a megabyte and thirty lengths: rows stay small, and the middle of the line is searched."""
    random.seed(2)
    line = "".join(random.choice("abcdefgh") for _ in range(500_000))
    inside = [line[k * 9000 : k * 9000 + 8 + k] for k in range(30)]
    missing = ["z" + s for s in inside]
    files = corpus_of({"big.js": line + line})
    suspects = spark.createDataFrame([("r", f"{s}.py", s) for s in inside + missing], "repo string, path string, stem string")
    assert [r[0] for r in listed(cleanup.orphan_by_mention(suspects, files), "stem")] == sorted(missing)


def test_only_the_bot_rejects(spark):
    rows = [("a", "feature", None), ("b", "bot/docs", None), ("c", "bot/docs", "2024"), ("c", "feature", None)]
    pulls = spark.createDataFrame(
        [(r, b, "closed", str(n), m, n) for n, (r, b, m) in enumerate(rows)], "repo string, branch string, state string, closed_at string, merged_at string, number int")
    assert listed(fleet.prior_rejection(pulls, "bot/docs"), "repo") == [("b",)]


def test_last_section_counts(spark):
    text = "===== M.yaml =====\n- ruta: a.py\n  sha256: x\n===== N.md =====\nuno\n===== M.yaml =====\n  sha256: sola\n- ruta: b.py\n  sha256: y\n"
    sections = extract.split_sections(spark.createDataFrame([("r", text)], "repo string, text string"))
    assert listed(sections, "n", "document") == [(1, "N.md"), (2, "M.yaml")]
    hashes = spark.createDataFrame([("r", "b.py", "ff"), ("r", "a.py", "00")], "repo string, path string, sha256 string")
    sealed = publish.manifest_seal(sections.where("document = 'M.yaml'"), hashes).first()["text"]
    assert sealed == 'sha256: sola\n- ruta: b.py\n  sha256: "ff"\n'


def test_gate_over_restarts(spark, tmp_path):
    random.seed(6)
    rows = [("hot" if n % 2 else f"c{n % 7}", random.choice("ab"), n * 600, n) for n in range(300)]
    last, expected = {}, []
    for repo, sha, _, n in rows:
        if last.get(repo) != sha:
            expected.append(n)
        last[repo] = sha
    for at in range(0, 300, 100):
        part = spark.createDataFrame(rows[at : at + 100], "repo string, sha string, sec long, id long")
        part.write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")).select(
            "repo", "sha", gate.sequence(F.timestamp_seconds("sec"), F.col("id")).alias("seq"))
        gate.stream_change_gate(arriving, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r[0] for r in listed(gate.read_changes(spark, str(tmp_path / "out")), "tie")] == expected
