"""Evidence landed by kind: a query extracts what it reads, with the rows of the whole store."""

import pytest

from fleetlens.operators import manifests
from fleetlens.plans import queries
from fleetlens.sources import store

CORPUS = {
    ("a", "app.py"): "import flask, os\nfrom pandas import x\n@app.get('/p')\ndef f():\n  os.getenv('KEY_A')\n# uses docker and redis\n",
    ("a", "web/x.jsx"): "import React from 'react'\nfetch('/p')\nexport const Abc = 1\n",
    ("a", "package.json"): '{"name": "n", "dependencies": {"react": "1", "vite": "2"}, "scripts": {"go": "x"}}',
    ("a", "vendor/requirements.txt"): "flask==1\n",
    ("b", "requirements.txt"): "flask==2\n# no\npsycopg2\n",
    ("b", "Dockerfile"): "FROM node:1\n",
    ("b", "t.sql"): "create table t (a int); select * from t",
    ("b", "empty.py"): "",
    ("b", "notes.md"): "login with mysql",
}
READERS = {
    "signals": lambda s: s.signals(), "manifest": lambda s: manifests.declared_dependencies(s.manifests()),
    "technologies": lambda s: s.technology_evidence(), "hits": lambda s: s.capability_hits(), "entry": lambda s: s.scan(),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_parts_hold_what_the_whole_store_holds(spark, corpus_of, tmp_path):
    files = corpus_of(CORPUS)
    whole = store.land(files, str(tmp_path / "whole"))
    expected = {name: rows_of(read(whole)) for name, read in READERS.items()}
    assert all(expected.values())
    for n, parts in enumerate([*((p,) for p in store.PARTS), ("manifest", "technologies"), queries.KNOWN_PARTS]):
        landed = store.land(files, str(tmp_path / f"s{n}"), parts)
        assert set(store.PARTS) & set(landed.rows.columns) == set(parts)
        assert {p: rows_of(READERS[p](landed)) for p in parts} == {p: expected[p] for p in parts}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.range(960).selectExpr(
        "id AS o_orderkey", "id % 70 AS o_custkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus", "id * 1.5D AS o_totalprice",
        "timestamp '1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(120).selectExpr(
        "id AS c_custkey", "concat('Customer#', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "id * 2.5D AS c_acctbal",
        "'BUILDING' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_queries_land_the_parts_they_read(spark, tables):
    names = ("api_doc_rows", "ranked_evidence", "orphan_by_import", "run_inventory", "private_rollup", "normalize_token", "capability_corroboration")
    held = queries._STORES.setdefault((spark.sparkContext.applicationId, tables), {})
    narrow = {name: rows_of(queries.runner(name)(spark, tables)) for name in names}
    # run_inventory's store does not hold technologies; that of private_rollup serves the two that follow.
    assert list(held) == [("signals",), ("technologies",), ("signals", "manifest"), queries.KNOWN_PARTS]
    held.clear()
    whole = queries.StoredInputs(spark, tables)
    assert whole.evidence and list(held) == [store.PARTS]
    assert {name: rows_of(queries.runner(name)(spark, tables)) for name in names} == narrow and list(held) == [store.PARTS]
    assert all(narrow.values())
    assert set(queries.PARTS_OF) <= queries.FROM_STORE


def test_search_for_names_lands_imports_and_entries_alone(spark, corpus_of, tables, tmp_path):
    """``orphan_by_mention`` extracts no other signal, technology or keyword; the suspects are those of the whole store."""
    landed = store.land(corpus_of(CORPUS), str(tmp_path / "narrow"), ("imports", "entry"))
    whole = store.land(corpus_of(CORPUS), str(tmp_path / "whole"))
    assert set(store.PARTS) & set(landed.rows.columns) == {"signals", "entry"}
    assert rows_of(landed.signals()) == rows_of(whole.signals(*store.IMPORTS)) and rows_of(landed.scan()) == rows_of(whole.scan())

    held = queries._STORES.setdefault((spark.sparkContext.applicationId, tables), {})
    held.clear()
    narrow = rows_of(queries.runner("orphan_by_mention")(spark, tables))
    assert narrow and list(held) == [("imports", "entry")]
    held.clear()
    assert queries.StoredInputs(spark, tables).evidence and rows_of(queries.runner("orphan_by_mention")(spark, tables)) == narrow
    assert list(held) == [store.PARTS]
