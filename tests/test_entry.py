import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT, SF
from textloom.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.sql(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert names == sorted(want.columns)
    rows = duck.sql(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
    ours = [tuple(plain(x) for x in r) for r in got.select(names).collect()]
    assert sorted(map(repr, ours)) == sorted(repr(tuple(plain(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_runs(spark, name):
    """Values are compared with brute force elsewhere; here each gives rows without nulls all over."""
    out = QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
    assert all(any(r[c] is not None for r in rows) for c in out.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    """The rest works when the optional subpackage and the pipeline are gone."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_corpus' in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
