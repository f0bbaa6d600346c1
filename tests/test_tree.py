"""A tree listed and read by tasks, laid out by bytes."""

import os

from pyspark.sql import functions as F

from fleetlens.sources import corpus, tree


def write(root, raw):
    for name, data in raw.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


RAW = {"r1/.gitignore": b".env\n", "r1/app/__init__.py": b"", "r1/app/_x/deep/a.py": b"x\r\n", "r1/.git/HEAD": b"ref",
       "r1/sub/.git/index": b"i", "r2/.github/w.yml": "ñ".encode(), "r2/a b/c#d?.txt": b"z" * 3000, "loose.txt": b"l"}


def test_hidden_names_arrive(spark, tmp_path):
    write(tmp_path, RAW)
    (tmp_path / "empty" / "folder").mkdir(parents=True)
    kept = {tuple(n.split("/", 1)): d for n, d in RAW.items() if "/.git/" not in n and "/" in n}
    for root in (str(tmp_path), str(tmp_path) + "/", "file://" + str(tmp_path)):
        seen = tree.read_files(spark, root, part_bytes=1000).collect()
        assert len(seen) == len(kept) and {(r.repo, r.path): bytes(r.bytes) for r in seen} == kept
        assert all(r.size == len(r.bytes) for r in seen)


def test_repositories_two_levels_deep(spark, tmp_path):
    write(tmp_path, {"org/r1/a.py": b"a", "org/r2/.b/c": b"c", "other/r1/d": b"d", "org/loose": b"l"})
    repos = tree.repositories(spark, str(tmp_path), 2)
    assert sorted(r.repo for r in repos.collect()) == ["org/r1", "org/r2", "other/r1"]
    listed = tree.list_tree(repos.union(spark.createDataFrame([("gone",)], "repo string")), str(tmp_path))
    assert sorted(map(tuple, listed.collect())) == [("org/r1", "a.py", 1), ("org/r2", ".b/c", 1), ("other/r1", "d", 1)]


def test_every_spread_lists_the_same(spark, tmp_path):
    write(tmp_path, {f"r/{'d/' * n}f{n}": b"x" * n for n in range(5)})
    repos = tree.repositories(spark, str(tmp_path))
    for spread in (0, 1, 2, 7):
        listed = tree.list_tree(repos, str(tmp_path), spread=spread).collect()
        assert sorted((r.path, r.size) for r in listed) == sorted(("d/" * n + f"f{n}", n) for n in range(5))


def test_an_empty_root(spark, tmp_path):
    assert tree.read_files(spark, str(tmp_path)).collect() == []


def test_large_files_are_split_off(spark):
    rows = [("hot", f"f{n}", 100) for n in range(2_000)] + [("hot", f"big{n}", 50_000 + n) for n in range(3)]
    rows += [("r", "unknown", None), ("r", "odd", -5)]
    listed = spark.createDataFrame(rows, "repo string, path string, size bigint")
    laid = tree.by_bytes(listed, 10_000)
    parts = laid.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert sorted((r.bytes, r.n) for r in parts)[-3:] == [(50_000 + n, 1) for n in range(3)]
    assert len(parts) == 23 and max(r.bytes for r in parts if r.n > 1) < 20_000
    assert sorted(map(tuple, laid.collect()), key=str) == sorted(rows, key=str)


def test_unreadable_and_oversized_files_keep_their_rows(spark, tmp_path):
    write(tmp_path, {"r/a": b"12345", "r/b": b"123456"})
    listed = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "gone"), ("r", "")], "repo string, path string")
    seen = {r.path: (r.size, r.bytes and bytes(r.bytes)) for r in tree.read_listed(listed, str(tmp_path), most_bytes=5).collect()}
    assert seen == {"a": (5, b"12345"), "b": (6, None), "gone": (0, None), "": (0, None)}


def test_read_paths_lays_out_by_size(spark, tmp_path):
    write(tmp_path, {"r/.env": b"A=1", "r/m.py": b"m"})
    listed = spark.createDataFrame([("r", ".env", 3), ("r", "m.py", 1)], "repo string, path string, size bigint")
    assert {(r.path, r.size) for r in corpus.read_paths(listed, str(tmp_path)).collect()} == {(".env", 3), ("m.py", 1)}
    assert os.listdir(tmp_path) == ["r"]
