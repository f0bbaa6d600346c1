"""Text operators on texts that make a careless pattern slow or deep, and folds against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions import text as T
from fleetlens.operators import contract, extract, pii

MB = 1_000_000
LIMIT = 60
RUNS = {
    "dots": "me@" + "a." * (MB // 2), "dashes": "client_id: robot_7 " + "a-" * (MB // 2), "signs": "a@b.co" * (MB // 6), "commas": "import " + "a, " * (MB // 3) + "z",
    "imports": "import " * (MB // 7), "blanks": " " * MB, "lines": "x\n" * (MB // 2), "quotes": '"""' + '\\"' * (MB // 2), "open": "<!-- AI:BEGIN id=a -->\n" * (MB // 23),
    "digits": "1" * MB, "hex": "0123456789abcdef" * (MB // 16), "brackets": "<script " * (MB // 8), "exports": "export default " * (MB // 15), "from": "from " * (MB // 5),
}
OPERATORS = {
    "emails": lambda: F.size(pii.email_items("content")),
    "rut": lambda: F.size(pii.distinct_hits(F.col("content"), T.rx(dims.RUT))),
    "signals": lambda: F.size(F.concat(*[c for e in extract.EXTRACTORS.values() for c in e.build("content")])),
    "assets": lambda: F.size(extract.asset_items("content")),
    "citations": lambda: F.size(extract.citation_items("content")),
    "blocks": lambda: F.size(contract.block_items("content")),
    "normalize": lambda: F.length(T.normalize_text(F.col("content"))),
    "command": lambda: F.length(T.normalize_command(F.col("content"))),
    "lines": lambda: F.size(T.lines_of(F.col("content"))),
    "mentions": lambda: F.size(extract.mention_items("content", "content")),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_long_runs_take_linear_time(spark, operator):
    """Runs of 1 MB end, and soon: a pattern that tries a run from each of its characters would take hours."""
    rows = spark.createDataFrame([*RUNS.items()], "name string, content string").repartition(8)
    start = time.monotonic()
    assert len(rows.select("name", OPERATORS[operator]().alias("n")).collect()) == len(RUNS)
    assert time.monotonic() - start < LIMIT


def test_scanned_equals_a_plain_fold(spark):
    rng = random.Random(1)
    lists = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 256, 257, 1000)]
    rows = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    for row in rows.select("v", F.expr(T.scanned("v", "7", "s.last * 3 % 1000 + x", "int")).alias("out")).collect():
        want, state = [], 7
        for x in row.v:
            r = abs(state * 3) % 1000 * (1 if state >= 0 else -1)
            state = r + x
            want.append(state)
        assert row.out == want


def test_addresses_equal_the_pattern(spark):
    """The search from the sign finds what the pattern finds from left to right, whatever stands around it."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "ab", ".", "@", "-", "_", "é", " ", "%", "co", ".com", "@x.org", "😀", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").repartition(8)
    found = rows.select("i", F.expr(f"transform(filter({pii._addresses('text')}, a -> a.address <> ''), a -> struct(a.before, a.address))").alias("a")).collect()
    for row in found:
        want = [(texts[row.i][max(0, m.start() - 40) : m.start()], m[0]) for m in re.finditer(dims.EMAIL, texts[row.i])]
        assert [tuple(x) for x in row.a] == want, texts[row.i]


def test_imports_come_from_the_code(spark):
    text = (
        'import os, sys as s\nfrom a.b import (\n    c,\n    d)\n"""\nimport hidden\nfrom hidden2 import x\n"""\nx = "it\'s" # don\'t \'\'\'\nimport e, \\\n    f.g as h\n'
        "from . import rel\nfrom .pkg import y\n  import indented\ndef importx(): pass\ns = '''\nimport no'''\nimport last # import comment"
    )
    many = "import " + ", ".join(f"m{i} as n{i}" for i in range(20_000))
    rows = spark.createDataFrame([("a", text), ("b", many), ("c", None), ("d", "")], "name string, content string")
    plain, from_ = extract.EXTRACTORS["py_imports"].build("content")
    found = {r.name: ([(x.value, x.line) for x in r.p], [(x.value, x.line) for x in r.f]) for r in rows.select("name", plain.alias("p"), from_.alias("f")).collect()}
    assert found["a"] == ([("os", 1), ("sys", 1), ("e", 10), ("f.g", 10), ("indented", 14), ("last", 18)], [("a.b", 2), ("pkg", 13)])
    assert [v for v, _ in found["b"][0]] == [f"m{i}" for i in range(20_000)] and found["c"] == found["d"] == ([], [])
