"""Replacement by bucket, prints that add up, and files that arrive twice."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import extract, fingerprint, manifests, provenance
from fleetlens.sources import store
from fleetlens.sources.buckets import BucketTable, bucket_of
from fleetlens.streaming import gate

CORPUS = {(f"r{n}", "app.py"): f"import m{n}\n" for n in range(12)}


def parts_of(folder):
    return {d.name: sorted(f.name for f in d.glob("part-*")) for d in Path(folder, "rows").glob("bucket=*")}


def found(landed):
    return sorted(tuple(r) for r in landed.signals().select("repo", "file", "value").collect())


def test_one_changed_repository_rewrites_one_bucket(spark, corpus_of, tmp_path):
    folder = str(tmp_path / "s")
    first, done = store.land_changed(corpus_of(CORPUS), folder, 8)
    before = parts_of(folder)
    assert found(first) == sorted((f"r{n}", "app.py", f"m{n}") for n in range(12)) and len(done) == len(before)
    assert store.land_changed(corpus_of(CORPUS), folder, 8)[1] == [] and parts_of(folder) == before

    changed = CORPUS | {("r3", "app.py"): "import other\n"}
    bucket = spark.range(1).select(bucket_of(F.lit("r3"), 8)).first()[0]
    second, done = store.land_changed(corpus_of(changed), folder, 8)
    assert done == [bucket]
    assert {k for k, v in parts_of(folder).items() if v != before[k]} == {f"bucket={bucket}"}
    assert found(second) == found(store.land(corpus_of(changed), str(tmp_path / "whole")))


def lines(files):
    """Cheap rows of a file: its imports, null where it has none."""
    return files.select("repo", F.regexp_extract("content", r"import (\w+)", 1).alias("value")).where("value <> ''")


def test_gone_and_empty_buckets(spark, corpus_of, tmp_path):
    """A bucket without repositories, one whose files say nothing, and an empty corpus leave no old rows."""
    table, whole = BucketTable(spark, str(tmp_path / "s"), 64), corpus_of(CORPUS)

    def run(files):
        done = table.replace(files, lines)
        return done, sorted(tuple(r) for r in table.read("repo string, value string").collect())

    run(whole)
    fewer = {k: v for k, v in CORPUS.items() if k[0] != "r5"} | {("r6", "app.py"): "x = 1\n"}
    done, rows = run(corpus_of(fewer))
    assert 1 <= len(done) <= 2 and rows == sorted((r, v.split()[1]) for (r, _), v in fewer.items() if r != "r6")
    assert run(whole.where("false"))[1] == [] and run(whole.where("false"))[0] == []
    assert len(run(whole)[1]) == 12
    # Without a repository or a content: a bucket like any other.
    odd = whole.unionByName(whole.limit(1).withColumn("repo", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("string")))
    assert len(run(odd)[0]) == 1 and len(run(odd)[1]) == 12


def test_broken_run_is_made_good(spark, corpus_of, tmp_path):
    """A run that ends while rows are written leaves its buckets open, also for the old input."""
    table = BucketTable(spark, str(tmp_path / "s"), 8)
    table.replace(corpus_of(CORPUS), lines)
    changed = corpus_of(CORPUS | {("r3", "app.py"): "import other\n"})
    with pytest.raises(Exception, match="broken off"):
        table.replace(changed, lambda files: lines(files).withColumn("value", F.raise_error(F.lit("broken off"))))
    assert len(table.replace(corpus_of(CORPUS), lines)) == 1
    assert len(table.read("repo string, value string").collect()) == 12


def file_prints(corpus_of, contents):
    """Prints of the files, worked out once."""
    files = corpus_of(contents)
    parts = fingerprint.file_parts(files, extract.signals(files), manifests.discover_manifests(files), provenance.technology_evidence(files))
    prints = fingerprint.file_prints(parts)
    return files.sparkSession.createDataFrame(prints.collect(), prints.schema)


def sealed(prints):
    return sorted(tuple(r) for r in fingerprint.print_sha(prints).collect())


def test_print_is_updated_from_changed_files(spark, corpus_of):
    random.seed(4)
    lines = ["import flask", "@app.get('/a')\ndef f(): pass", "import os\nos.getenv('KEY')", "@app.post('/b')\ndef g(): pass", "x = 1"]
    old = {(f"r{n % 3}", f"d/f{n}.py"): "\n".join(random.choices(lines, k=4)) for n in range(20)}
    old |= {("r0", "requirements.txt"): "flask==1\npandas", ("lost", "a.py"): "import flask"}
    new = {k: v for k, v in old.items() if k not in (("r1", "d/f1.py"), ("lost", "a.py"))}
    new |= {("r0", "requirements.txt"): "flask==2", ("r2", "d/f2.py"): "import os\nos.getenv('OTHER')", ("r9", "n.md"): "hola"}
    held = fingerprint.repo_prints(file_prints(corpus_of, old))
    gone = {k: v for k, v in old.items() if new.get(k) != v}
    come = {k: v for k, v in new.items() if old.get(k) != v}
    updated = fingerprint.updated_prints(held, file_prints(corpus_of, gone), file_prints(corpus_of, come))
    assert len(gone) == 4 and len(come) == 3
    assert sealed(updated) == sealed(fingerprint.repo_prints(file_prints(corpus_of, new)))
    assert sealed(held) != sealed(updated) and ("lost",) not in {r[:1] for r in sealed(updated)}
    assert [r["entries"] for r in updated.where("repo = 'r9'").collect()] == [0]
    # Blank lines and mentions say nothing about the software; a second use of a route does.
    still = {k: "\n\n" + v if k[1].endswith(".py") else v for k, v in new.items()}
    assert sealed(fingerprint.repo_prints(file_prints(corpus_of, still))) == sealed(updated)


def test_prints_of_nothing(spark, corpus_of):
    none = file_prints(corpus_of, CORPUS).where("false")
    assert sealed(fingerprint.repo_prints(none)) == [] and sealed(fingerprint.updated_prints(fingerprint.repo_prints(none), none, none)) == []
    odd = spark.createDataFrame([("r", "p", "env", None), ("r", "p", None, "x"), (None, None, "env", "A")], "repo string, path string, part string, entry string")
    assert [tuple(r) for r in fingerprint.file_prints(odd).select("repo", "path", "entries").orderBy("entries").collect()] == [("r", "p", 0), (None, None, 1)]


def test_file_that_arrives_twice_is_reported_once(spark, tmp_path):
    """Twice in one batch, again after a restart, changed after that; for signals and for personal data."""
    text, other = "import a\nmail = 'ana.perez@empresa-real.cl'\n", "import b\nmail = 'luis.soto@empresa-real.cl'\n"
    arrivals = [[("r", "a.py", text), ("r", "a.py", text), ("s", "a.py", text), ("r", "n.py", None)], [("r", "a.py", text)], [("r", "a.py", other)]]
    for kind, columns, expected in (
        ("signals", ["repo", "file", "value"], [("r", "a.py", "a"), ("r", "a.py", "b"), ("s", "a.py", "a")]),
        ("pii", ["repo", "path"], [("r", "a.py"), ("r", "a.py"), ("s", "a.py")]),
    ):
        folder = tmp_path / kind
        for rows in arrivals:
            spark.createDataFrame([(r, p, len(c or ""), c) for r, p, c in rows], gate.CORPUS_SCHEMA).write.mode("append").parquet(str(folder / "in"))
            query = gate.stream_evidence(gate.stream_corpus(spark, str(folder / "in")), str(folder / "out"), str(folder / "state"), kind)
            query.awaitTermination()
        got = spark.read.parquet(str(folder / "out")).select(*columns).collect()
        assert sorted(tuple(r) for r in got) == expected


def test_unchanged_files_keep_their_evidence(spark, corpus_of, tmp_path):
    """Only files that changed are read again; files that come twice, without a text, or went away give the rows of a whole landing."""
    old = {("a", "app.py"): "import flask\n@app.get('/p')\ndef f(): pass", ("a", "same.js"): "import x from 'react'\nfetch('/q')", ("b", "package.json"): '{"dependencies": {"vue": "1"}}',
           ("b", "twin.py"): "import numpy", ("c", "gone.md"): "login", ("c", "moved.py"): "import os"}
    new = {k: v for k, v in old.items() if k not in (("c", "gone.md"), ("c", "moved.py"))}
    new |= {("a", "app.py"): "import django\nif __name__ == '__main__':\n  pass", ("d", "moved.py"): "import os", ("d", "new.sql"): "select * from t"}

    def odd(files):
        unread = files.where("path = 'same.js'").withColumn("content", F.lit(None).cast("string"))
        return files.unionByName(files.where("path = 'twin.py'")).unionByName(unread).unionByName(files.where("path = 'twin.py'").withColumn("content", F.lit("import pandas")))

    def rows(landed):
        parts = ("repo", "path", "language", "depth", "lang", "third_party", "size", *store.PARTS, *store.KEYS)
        return sorted(str([r[c] for c in parts]) for r in landed.rows.collect())

    before, now = odd(corpus_of(old)), odd(corpus_of(new))
    first = store.land_again(before, str(tmp_path / "first"))
    whole = rows(store.land_again(now, str(tmp_path / "whole")))
    assert rows(store.land_again(now, str(tmp_path / "again"), first)) == whole and len(whole) == now.count()
    # A mark in the earlier store shows which rows came from there.
    first.rows.withColumn("entry", F.lit(True)).write.parquet(str(tmp_path / "marked"))
    marked = store.land_again(now, str(tmp_path / "kept"), store.EvidenceStore(spark, str(tmp_path / "marked"), first.schema))
    kept = marked.rows.where("entry and path <> 'app.py'").select("repo", "path").collect()
    assert sorted(map(tuple, kept)) == [("a", "same.js"), ("a", "same.js"), ("b", "package.json"), ("b", "twin.py"), ("b", "twin.py"), ("b", "twin.py")]
    assert [r.s.value for r in marked.rows.where("path = 'app.py'").selectExpr("explode(signals) AS s").collect()] == ["django"]
    # The files of an empty run, and a run from an empty store.
    none = store.land_again(now.where("false"), str(tmp_path / "none"), first)
    assert rows(none) == [] and rows(store.land_again(now, str(tmp_path / "anew"), none)) == whole


def test_evidence_replaced_reads_unchanged_files_once(spark, tmp_path, monkeypatch):
    """The second run of the query is handed the store of the first one."""
    from fleetlens.plans import queries

    spark.range(480).selectExpr("id AS o_orderkey", "id % 70 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    earlier, land_again = [], store.land_again
    monkeypatch.setattr(store, "land_again", lambda files, folder, held=None: earlier.append(held) or land_again(files, folder, held))
    found = queries.runner("evidence_replaced")(spark, str(tmp_path))
    assert earlier[0] is None and earlier[1] is not None and len(earlier) == 2
    records = queries.runner("evidence_sink")(spark, str(tmp_path))
    columns = ["repo", "section", "name", "detail", "file", "line"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, records.select(columns).collect()))
