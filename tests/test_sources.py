"""Reading a tree of files."""

import hashlib

from fleetlens.sources import corpus


def test_tree_is_read_like_text_files(spark, tmp_path):
    raw = {"r1/app/a.py": b"x = 1\r\ny\rz\xff\n", "r1/vendor/v.js": b"v", "r2/README.md": "ñ\n".encode(),
           "r2/node_modules/m/i.js": b"m", "r2/.DS_Store": b"d"}
    for name, data in raw.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    seen = corpus.read_tree(spark, str(tmp_path))
    assert {(r["repo"], r["path"]) for r in seen.select("repo", "path").collect()} == {
        tuple(n.split("/", 1)) for n in raw if "/." not in n}
    listed = spark.createDataFrame([tuple(n.split("/", 1)) for n in raw] + [("r1", "gone.py")], "repo string, path string")
    tracked = corpus.read_paths(listed, str(tmp_path))
    assert tracked.where("bytes is null").select("path").collect() == [("gone.py",)]
    tracked = tracked.where("bytes is not null")
    hashes = {(r["repo"], r["path"]): r["sha256"] for r in corpus.file_sha256(tracked).collect()}
    assert hashes == {tuple(n.split("/", 1)): hashlib.sha256(d).hexdigest() for n, d in raw.items()}
    rows = corpus.scan_corpus(corpus.read_content(tracked)).collect()
    assert {(r["repo"], r["path"]): (r["content"], r["size"], r["language"]) for r in rows} == {
        ("r1", "app/a.py"): ("x = 1\ny\nz\n", 12, "Python"), ("r2", "README.md"): ("ñ\n", 3, "Markdown")}


def test_layout_follows_the_bytes(spark, tmp_path):
    """One language in 99% of the rows is split over many files, the others stay whole."""
    from fleetlens.sources.corpus import land_corpus

    rows = spark.range(20_000).selectExpr(
        "'r' AS repo", "concat('d/f', id, CASE WHEN id % 100 = 0 THEN '.sql' ELSE '.py' END) AS path", "500L AS size",
        "concat_ws(' ', sha2(string(id), 512), sha2(string(-id), 512), sha2(string(id * 7), 512)) AS content",
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        land_corpus(rows, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {d.name: len([*d.glob("part-*")]) for d in (tmp_path / "c").glob("language=*")}
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert files["language=Python"] >= 8 and files["language=SQL"] <= 2 and stored.count() == 20_000


def test_summary_lines_are_whole(spark):
    from fleetlens.operators.evidence import summary_lines

    text = "![badge](x)\n\n" + "\n".join(f"{n} " + "y" * 400 for n in range(60))
    rows = spark.createDataFrame([("r", text)], "repo string, text string")
    found = summary_lines(rows).orderBy("rank").collect()
    assert [r.value for r in found] == text.split("\n")[2:]
    assert [len(r.value) for r in summary_lines(rows, 35, 240).collect()] == [243] * 35


def test_repetitive_texts_are_stored_in_files_of_bounded_rows(spark, tmp_path):
    """Texts that shrink to nothing on disk do not end in one file, which a single task would have to read."""
    from fleetlens.sources.corpus import FILE_RECORDS, land_corpus

    rows = spark.range(3 * FILE_RECORDS - 1).selectExpr(
        "'r' AS repo", "concat('d/f', id, '.sql') AS path", "500L AS size", "repeat('select 1;', 50) AS content")
    land_corpus(rows, str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    held = [r["count"] for r in stored.groupBy("_metadata.file_path").count().collect()]
    assert sum(held) == 3 * FILE_RECORDS - 1 and max(held) <= FILE_RECORDS
