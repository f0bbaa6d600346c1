"""The stored index of mentions against a search of every text."""

import random

from pyspark.sql import functions as F

from fleetlens.functions import paths
from fleetlens.operators import cleanup
from fleetlens.sources.mentions import land_mentions


def check(files, contents, folder):
    suspects = files.select("repo", "path", paths.stem_of(F.col("path")).alias("stem"))
    index = land_mentions(files, str(folder))
    found = sorted((r.repo, r.path) for r in index.unmentioned(suspects).collect())
    texts = [(r.repo, r.stem, contents[r.repo, r.path]) for r in suspects.collect()]
    expected = sorted(
        (r.repo, r.path) for r in suspects.collect()
        if not any(repo == r.repo and stem != r.stem and r.stem in text for repo, stem, text in texts))
    assert found == expected and 0 < len(expected) < len(texts)
    return index, suspects


def test_index_like_brute_force(spark, corpus_of, tmp_path):
    rng = random.Random(7)
    stems = ["ab", "abc", "my-comp", "a (1)", "foo.test", "x", "ñu", "util", "zz top", "q_1", "😀😀😀", "-"]
    contents = {}
    for n in range(90):
        words = [rng.choice(stems + ["my_utils", "xx-my-comp-y", "la a (1) b", "foo.tests", "yñus", "z😀😀😀"]) for _ in range(2)]
        contents[f"r{n % 4}", f"d{n}/{rng.choice(stems)}.py"] = "\n".join(words[: rng.randint(0, 2)])
    check(corpus_of(contents), contents, tmp_path)


def test_names_in_one_long_line(spark, corpus_of, tmp_path):
    """Names of many lengths in the middle of a megabyte without a blank: pieces overlap by the longest name."""
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh") for _ in range(500_000))
    inside = [line[k * 9001 : k * 9001 + 8 + k] for k in range(30)]
    contents = {("r", f"{s}.py"): "" for s in inside + ["z" + s for s in inside]} | {("r", "big.js"): line + line}
    check(corpus_of(contents), contents, tmp_path)


def test_candidates_read_no_text(spark, corpus_of, tmp_path):
    contents = {("r", "used.py"): "x", ("r", "lonely.py"): "y", ("r", "app.js"): "import used from './used'\nused here", ("r", "main.py"): "if __name__ == '__main__':\n  pass"}
    files = corpus_of(contents)
    index = land_mentions(files, str(tmp_path))
    signals = spark.createDataFrame([], "repo string, file string, lang string, kind string, value string, method string, line int, third_party boolean")
    flagged = files.withColumn("entry", paths.entry_point(F.col("content"))).drop("content")
    with_index = cleanup.deletion_candidates(flagged, flagged, signals, index)
    plain = cleanup.deletion_candidates(files, files, signals)
    assert sorted(map(tuple, with_index.collect())) == sorted(map(tuple, plain.collect()))


def test_names_of_few_letters_cost_no_product(spark, corpus_of, tmp_path):
    """Numbered names share all their trigrams with all units; places compared grow with the names, not with their square."""
    def compared(bits):
        names = [f"tool_{n:0{bits}b}" for n in range(2 ** bits)]
        contents = {("r", f"lib/{s}.py"): f"see {names[k - 1]}x" if k % 2 else "" for k, s in enumerate(names)}
        index, suspects = check(corpus_of(contents), contents, tmp_path / str(bits))
        return index.candidates(suspects).count()

    few, many = compared(6), compared(9)
    assert many <= 10 * few


def test_files_are_spread_by_weight(spark, corpus_of):
    """Files are dealt to tasks by their characters, however well they compress; none is lost and languages stay together."""
    from fleetlens.sources.corpus import spread

    contents = {("r", f"a/m_{n}.py"): "x = 1\n" * 2000 for n in range(400)} | {("r", "b.sql"): "select 1", ("r", "c.md"): "# c"}
    files = corpus_of(contents)
    dealt = spread(files, 256 * 1024).select("path", "language", F.spark_partition_id().alias("p"))
    rows = dealt.collect()
    assert sorted(r.path for r in rows) == sorted(path for _, path in contents)
    sizes = {}
    for r in rows:
        sizes[r.p] = sizes.get(r.p, 0) + len(contents["r", r.path]) + 256
    assert len(sizes) >= 15 and max(sizes.values()) < 3 * 256 * 1024


def test_kinds_of_names_are_worked_out_once(spark, corpus_of, tmp_path):
    """The longest name of each kind is stored beside the units, whose texts are laid out before any join."""
    contents = {("r", "used.py"): "", ("r", "my-part.js"): "see used", ("s", "a b.md"): "my-part", ("s", ".py"): ""}
    index = land_mentions(corpus_of(contents), str(tmp_path))
    assert sorted(map(tuple, index.table("kinds").collect())) == [("r", "chunk", 7), ("r", "word", 4), ("s", "chunk", 3), ("s", "line", 3)]


def test_one_pattern_for_paths_means_each_of_them(spark):
    """Patterns that share the beginning of a folder or name say of every path what they say one by one."""
    import random

    from fleetlens import dims
    from fleetlens.functions.text import rx

    rng = random.Random(3)
    parts = ["vendor", "plugins", "plugin", "lib", "external", "x", "README", "README.md", "LICENSE", ".github", ".env", "tests", "a.min.js", "Dockerfile", "vite.config.ts", "setup.py", "notvendor", "platforms", "android", "DIST", "\n"]
    rows = spark.createDataFrame([("/".join(rng.choices(parts, k=rng.randint(1, 5))) + rng.choice(["", "", "/"]),) for _ in range(4000)], "path string")
    for patterns in (dims.EXCLUDED_PATH_PATTERNS, dims.THIRD_PARTY_PATTERNS, dims.PROTECTED_PATHS, (r"\.x$",), (r"(^|/)a",)):
        assert paths.any_of(patterns).count("(^|/)") <= 1
        other = F.col("path").rlike(rx("|".join(patterns), "i")) != F.col("path").rlike(rx(paths.any_of(patterns), "i"))
        assert rows.where(other).isEmpty()
