"""Tables derived from the given ones, as SQL expressions both engines read alike.

The given tables hold no source code, so a corpus of files is assembled from
``orders`` row by row: 24 kinds of file, grouped in blocks of 24 orders, one
third of the blocks in ``repo_0``. Only ``concat``, ``cast``, ``%``, ``CASE``
and ``chr`` are used, so every engine builds identical bytes and the corpus
grows with the tables.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import checkpoint_dir
from fleetlens.sources.corpus import land_corpus

CORPUS_SCHEMA = "repo string, path string, size bigint, content string, name string, ext string, language string"

NL = "chr(10)"
K = "cast(o_orderkey as string)"
BLOCK = "cast(floor(o_orderkey / 24) as bigint)"
KIND = "o_orderkey % 24"


def mod(n: int, column: str = "o_orderkey") -> str:
    return f"cast({column} % {n} as string)"


def key(offset: int) -> str:
    return f"cast(o_orderkey - {offset} as string)"


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def text(*lines: str) -> str:
    """Lines (each a quoted literal or an expression) joined and ended by newlines."""
    return cat(*[x for line in lines for x in (line, NL)])


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


REPO = f"CASE WHEN {BLOCK} % 3 = 0 THEN 'repo_0' ELSE concat('repo_', cast({BLOCK} % 97 as string)) END"

# The first block of each repository carries its root files.
ROOT = (
    f"({BLOCK} = 0 OR ({BLOCK} < 97 AND {BLOCK} % 3 <> 0) "
    f"OR ({BLOCK} > 97 AND {BLOCK} < 194 AND ({BLOCK} - 97) % 3 = 0))"
)

FILES = {
    0: (cat("'app/mod_'", K, "'.py'"), text(
        "'import pandas, os as sistema'", "'from flask import Flask'", "'class Modelo:'", "'    pass'",
        "'@app.get('", cat("'  \"/o/'", mod(50, "o_custkey"), "'\")'"), cat("'async def f_'", K, "'():'"),
        cat("'    x = os.getenv(\"KEY_'", mod(30), "'\")'"), cat("'mail = \"u'", mod(40), "'@forest.example.cl\"'"))),
    1: (cat("'web/src/View'", K, "'.jsx'"), text(
        "'import {'", "'  useState'", "'} from \"react\"'", "'const L = require(\"leaflet\")'",
        cat("'export default function View'", K, "'() {'"), cat("'  fetch(\"/api/'", mod(20, "o_custkey"), "'\")'"),
        "'  axios.post(\"/save\"); upload()'", "'}'", "'export const Mapa = 1'",
        cat("'const r = { path: \"/v/'", mod(9), "'\" }'"), cat("'process.env.URL_'", mod(7), "' import.meta.env[\"VITE_K\"]'"))),
    2: (cat("'db/q_'", K, "'.sql'"), text(
        cat("'CREATE TABLE IF NOT EXISTS t_'", mod(60), "' (id int);'"), cat("'select * from u_'", mod(7, "o_custkey"), "' JOIN v_1 on 1=1;'"),
        "'insert INTO w select 1; update w set a=1; DROP table w'")),
    3: (cat("'svc_'", K, "'/package.json'"), cat(
        "'{\"name\": \"svc_'", K, "'\", \"dependencies\": {\"react\": \"^'", mod(9),
        "'\", \"@vitejs/plugin-react\": \"4\"},'", NL, "'\"devDependencies\": {\"jsonwebtoken\": \"9\"},'", NL,
        "'\"scripts\": {\"build\": \"vite build\", \"dev'", mod(3), "'\": \"node server.js\"}}'")),
    4: (cat("'plugins/p'", K, "'/requirements.txt'"), text("'# c'", cat("'flask=='", mod(5)), "'psycopg2-binary>=2'")),
    5: (cat("'static/p'", K, "'.html'"), text(
        "'<html>'", cat("'<script src=\"https://cdn/leaflet@'", mod(3), "'/l.js\"></script><link'"),
        "'  href=\"https://cdn/tailwind.css\">'", "'<a href=\"https://vue.org\">react</a>'")),
    6: (cat("'app/pkg_'", K, "'/requirements.txt'"), text(
        "'pandas[all]~=2 ; python_version > 3'", "'-r base.txt'", "'--no-binary x'", "''", "'# nota'",
        cat("'django-allauth>=0.'", mod(4)), "'PyJWT'")),
    7: (cat("'lib_'", K, "'/pyproject.toml'"), text(
        "'[project]'", "'name = \"x\"'", "'version = \"1\"'", "'[tool.poetry.dependencies]'", "'numpy = \"^1.2\"'",
        cat("'dep_'", mod(6), "' = \">=2\"'"), "'  \"openpyxl\"'")),
    8: (cat("'deploy/svc_'", K, "'/Dockerfile'"), text(
        cat("'FROM python:3.'", mod(5)), "'RUN pip install redis'", "'  from nginx:1 as web'", "'COPY . .'")),
    9: (cat("'deploy/st_'", K, "'/docker-compose.yml'"), text(
        "'services:'", "'  db:'", cat("'    image: \"postgres:1'", mod(6), "'\"'"), "'  cache:'", "'    image: redis'")),
    10: (cat("'app/mod_'", key(10), "'_old.py'"), text("'import numpy.linalg'", "'from . import nada'", "'from .mod import f'")),
    11: (cat("'app/__pycache__/mod_'", K, "'.pyc'"), q("bytes")),
    12: (cat("'tests/fixtures/data_'", K, "'.json'"), text(
        cat("'{\"rut\": \"'", mod(15), "'1.34'", mod(10), "'.678-'", mod(10), "'\", \"x\": \"12345678-K\",'"),
        cat("'\"correo\": \"ana'", mod(12), "'@gob.cl\", \"diagnostico\": \"salud\", \"telefono\": \"+56 9 1234 56'", mod(10), mod(10, "o_custkey"), "'\"}'"))),
    13: (f"CASE WHEN {ROOT} THEN '.gitignore' ELSE {cat(q('conf/c_'), K, q('.ini'))} END", text(
        "'# ignorados'", "'node_modules'", "'/tests/fixtures/'", cat("'/data/planilla_'", key(-8), "'.csv'"))),
    14: (f"CASE WHEN {ROOT} THEN 'README.md' ELSE {cat(q('docs/guide_'), K, q('.md'))} END", f"CASE WHEN {BLOCK} % 5 = 4 THEN " + cat("'# '", REPO, NL) + " ELSE " + text(
        cat("'# Guia '", K), "''", "'![insignia](x.svg)'", "'## Descripción'",
        cat("'Usa React, Flask y probablemente expressjs con `t_'", mod(60, "(o_orderkey - 12)"), "' y `tabla_x`.'"),
        cat("'La variable `KEY_'", mod(30), "' y OTRA_CLAVE se leen al inicio.'"), "'## Instalación'",
        "'npm install'", "'npm run build            # genera dist'", "'  pip install -r requirements.txt'",
        cat("'python app/mod_'", key(14), "'.py'"), "'## Rutas'",
        cat("'GET /o/'", mod(50, "o_custkey"), "' y `POST /nada`'"),
        "'<!-- AI:BEGIN id=uso sha=aaaaaaaaaaaa -->'", "'texto'", "'<!-- AI:END id=uso -->'") + " END"),
    15: (f"CASE WHEN {ROOT} AND {BLOCK} % 4 <> 1 THEN 'LICENSE' ELSE {cat(q('NOTICE_'), K, q('.txt'))} END", text("'MIT'", cat("'no-reply@github.com soporte@x.cl jefe'", mod(5), "'@fields.example.cl'"))),
    16: (f"CASE WHEN {ROOT} AND {BLOCK} % 5 <> 2 THEN '.github/workflows/ci.yml' ELSE {cat(q('web/src/util_'), K, q('.ts'))} END", text(
        "'import axios from \"axios\"'", "'export function ayuda() {}'", "'axios.get(`/otra`)'", "'route = \"/r\"'")),
    17: (f"CASE WHEN {ROOT} THEN 'package.json' ELSE {cat(q('web/lib_'), K, q('/package.json'))} END", text(
        "'{\"name\": \"web\", \"dependencies\": {\"vue\": \"3\", \"leaflet\": \"1.9\"},'",
        "' \"devDependencies\": {\"vue\": \"2\", \"recharts\": \"1\"},'", "' \"scripts\": {\"test\": \"vitest run\"}}'")),
    18: (f"CASE WHEN {ROOT} THEN 'requirements.txt' ELSE {cat(q('app/req_'), K, q('/requirements-dev.txt'))} END", text(
        "'uvicorn[standard]>=0.2'", "'sqlalchemy'", f"CASE WHEN {ROOT} THEN 'scikit-learn' ELSE '# fin' END", cat("'pytest=='", mod(8)))),
    19: (cat("'lib/tool_'", K, "'.py'"), text("'def ayuda():'", "'    return 1'")),
    20: (cat("'app/main_'", K, "'.py'"), f"CASE WHEN {BLOCK} % 2 = 0 THEN " + text(
        cat("'from lib.tool_'", key(1), "' import ayuda'"), "'if __name__ == \"__main__\":'", "'    ayuda()'") + " ELSE " + text(
        cat("'# vea my_tool_'", key(1), "'_x'"), "'#!/usr/bin/env python'", "'print(1)'") + " END"),
    21: (cat("'data/planilla_'", K, "'.csv'"), text("'rut;nombre'", "'1;2'")),
    22: (f"CASE WHEN {BLOCK} % 2 = 0 THEN {cat(q('platforms/android/x_'), K, q('.js'))} ELSE {cat(q('vendor/x_'), K, q('.js'))} END", text("'import \"vue\"'")),
    23: (cat("'app/auth_'", K, "'.ts'"), text(
        "'import jwt from \"jsonwebtoken\"'", "'export class Login {}'", "'// login con oauth'",
        cat("'fetch(\"https://usr:clave@host.cl/x'", mod(4), "'\")'"), "'const Panel = \"dashboard node\"'",
        cat("'const contacto = \"+56 9 8765 432'", mod(10), "'\"'"))),
}


def _case(index: int) -> str:
    branches = " ".join(f"WHEN {kind} THEN {pair[index]}" for kind, pair in FILES.items())
    return f"CASE {KIND} {branches} END"


CORPUS = {"repo": REPO, "path": _case(0), "content": _case(1)}

# The root readmes of a scope of their own: one per document, in the variants of the contract.
BODY = "cuerpo generado"
BODY_SHA12 = hashlib.sha256(BODY.encode()).hexdigest()[:12]
SEAL = "0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef"

README_TEXT = (
    "CASE doc_id % 7 "
    "WHEN 0 THEN text "
    f"WHEN 1 THEN {cat(q('<!-- AI-README:lock -->'), NL, 'text')} "
    f"WHEN 2 THEN {cat(q('# doc_'), 'cast(doc_id as string)', NL, q('   '), NL)} "
    f"WHEN 3 THEN {cat(q('intro'), NL, q(f'<!-- AI:BEGIN id=a sha={BODY_SHA12} -->'), NL, q(BODY + '  '), NL, q('<!-- AI:END id=a -->'), NL, 'text', NL, q('<!-- ai:begin id=b.x sha=deadbeef -->'), NL, 'text', NL, q('<!-- AI:END -->'), NL, q('cola <!-- AI:BEGIN id=suelto -->'))} "
    f"WHEN 4 THEN {cat('text', NL, NL, q('<!-- ai-readme-fingerprint: sha256:' + SEAL + ' -->'), NL)} "
    f"WHEN 5 THEN {cat(q('corto '), 'cast(doc_id as string)')} "
    f"ELSE {cat(q('<!-- AI:BEGIN id=solo -->'), 'text', q('<!-- AI:END id=otro -->'), NL)} END"
)
README = {"repo": "concat('doc_', cast(doc_id as string))", "text": README_TEXT}

DOCUMENT = {"repo": "source", "document": "concat('d_', cast(doc_id as string))", "text": "text"}

CUST = "cast(c_custkey as string)"
REPOS = {
    "name": f"concat('repo_', {CUST})",
    "default_branch": "'main'",
    "archived": "c_custkey % 11 = 10",
    "disabled": "c_custkey % 13 = 12",
    "fork": "c_custkey % 17 = 16",
    "private": "c_nationkey % 2 = 1",
    "pushed_at": "concat('2024-0', cast(1 + c_custkey % 9 as string), '-15T00:00:00Z')",
    "size": "c_custkey * 977 % 700000",
    "description": "CASE WHEN c_custkey % 6 = 0 THEN concat('sucesor de REPO_', cast(c_custkey + 1 as string), '.') ELSE c_mktsegment END",
    "html_url": f"concat('https://host/org/repo_', {CUST})",
}
WORKFLOW = "org/hub/.github/workflows/generate.yml"
HOOK_REF = "CASE c_custkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'v1.2' WHEN 2 THEN 'abcdef1234567' ELSE 'v2' END"
ENGINE_REF = "CASE WHEN c_custkey % 5 = 0 THEN 'main' ELSE " + HOOK_REF + " END"
DESIRED_HOOK = f"uses: {WORKFLOW}@v2\nengine_ref: v2\n"
HOOKS = {
    "repo": f"CASE WHEN c_custkey % 10 = 3 THEN concat('otro_', {CUST}) ELSE concat('repo_', {CUST}) END",
    "text": (
        f"CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 7 = 5 THEN 'uses: nada' ELSE "
        + cat(q(f"uses: {WORKFLOW}@"), HOOK_REF, "chr(13)", NL, "CASE WHEN c_custkey % 6 = 1 THEN '' ELSE " + cat(q("engine_ref: "), ENGINE_REF, NL) + " END",
              "CASE WHEN c_custkey % 9 = 0 THEN 'secrets: inherit' ELSE '' END") + " END"
    ),
}
BOT_BRANCH = "bot/docs"
PULLS = {
    "repo": "concat('repo_', cast(o_custkey % 997 as string))",
    "branch": f"CASE WHEN o_orderkey % 3 = 0 THEN 'feature' ELSE '{BOT_BRANCH}' END",
    "number": "o_orderkey",
    "state": "CASE WHEN o_orderkey % 5 = 0 THEN 'open' ELSE 'closed' END",
    "closed_at": "cast(o_orderdate as string)",
    "merged_at": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderdate as string) END",
}
OPEN_PULLS = {
    "repo": "concat('otro_', cast(o_custkey as string))",
    "branch": PULLS["branch"],
    "state": PULLS["state"],
    "url": f"concat('https://host/pr/', {K})",
}
CONFIG_RAW = (
    "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '[1, 2' WHEN 2 THEN '{\"enabled\": false, \"lang\": \"EN \"}' "
    "WHEN 3 THEN '{\"lang\": \"fr\", \"ignore_paths\": [\" a/b \", \"\", \"c\"]}' "
    "WHEN 4 THEN '{\"ignore_paths\": \" docs \", \"otra\": 1, \"cosa\": 2}' "
    f"WHEN 5 THEN {cat(q('{\"declared\": \"  hecho por '), CUST, q('  \", \"artifacts\": true}'))} "
    "WHEN 6 THEN '{\"cleanup\": false, \"insumos\": true}' ELSE '{}' END"
)
CONFIG = {"repo": f"concat('repo_', {CUST})", "raw": CONFIG_RAW}

CREPO = "concat('repo_', cast(c_custkey % 97 as string))"
VERDICT_REPLY = (
    "CASE c_custkey % 4 WHEN 0 THEN 'no es json' WHEN 1 THEN "
    + cat("'```json'", NL, "'{\"borrar\": [{\"ruta\": \"a'", CUST, "'.py\", \"porque\": \"vieja\"}], \"revisar\": []}'", NL, "'```'")
    + " WHEN 2 THEN " + cat("'{\"revisar\": [{\"ruta\": \"b'", CUST, "'.js\", \"porque\": \"duda\"}, {\"ruta\": \"c.js\", \"porque\": \"x\"}]}'")
    + " ELSE '{\"borrar\": null}' END"
)
REPLIES = {"repo": f"concat('repo_', {CUST})", "text": VERDICT_REPLY}

RESPONSE_TEXT = cat(
    "'preambulo'", NL, "'===== 00-PROBLEMA.md ====='", NL,
    "CASE WHEN c_custkey % 3 = 0 THEN '<!-- DERIVADO DEL CODIGO -->' ELSE '' END", NL,
    "'Usa [package.json] y [./requirements.txt:2] [INFERIDO]'", NL,
    "CASE WHEN c_custkey % 4 = 1 THEN 'Ver [auth.py:15] y [docs/no.md]' ELSE 'Ver [README.md:3]' END", NL,
    "CASE WHEN c_custkey % 5 = 2 THEN 'RUT 12.345.678-5 correo jefa@fields.example.cl' ELSE '' END", NL,
    "CASE WHEN c_custkey % 6 = 5 THEN '' ELSE " + cat("'=====  01-SOLUCION.md ====='", NL, "'derivado del codigo [.gitignore]'", NL) + " END",
    "'===== MANIFIESTO.yaml ====='", NL, "'archivos:'", NL, "'  - ruta: \"requirements.txt\"'", NL, "'    sha256: \"x\"'", NL,
    "'  - ruta: no/existe.csv'", NL, "'    nota: y'", NL, "'    sha256: PENDIENTE'", NL,
    "'  - ruta: docs/GUIA.md'", NL, "'    sha256: z'", NL,
    "CASE WHEN c_custkey % 7 = 3 THEN " + cat("'===== MANIFIESTO.yaml ====='", NL, "'    sha256: sin ruta'", NL, "'  - ruta: \"README.md\"'", NL, "'    sha256: x'", NL) + " ELSE '' END",
)
RESPONSES = {"repo": f"concat('resp_', {CUST})", "corpus_repo": CREPO, "text": RESPONSE_TEXT}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def select_sql(source: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {source}"


_LANDED: dict[tuple[str, str], str] = {}


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, size, content) of the derived corpus.

    The corpus is landed once per session as a Parquet table in the shared
    folder and read from there, as a real corpus would be: scans prune columns
    and push filters, and no query repeats the assembly.
    """
    landed = (spark.sparkContext.applicationId, sf_dir)
    if landed not in _LANDED:
        folder = f"{checkpoint_dir(spark)}/fleetlens/corpus-{uuid.uuid4().hex}"
        land_corpus(select(table(spark, sf_dir, "orders"), CORPUS).selectExpr(
            "repo", "path", "cast(length(content) as bigint) AS size", "content"), folder)
        _LANDED[landed] = folder
    return spark.read.schema(CORPUS_SCHEMA).parquet(_LANDED[landed])
