"""Every registered query against its checking SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

from toolmill.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, duck):
    problem = compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name])
    assert problem is None, f"{name}: {problem}"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 3
    assert set(QUERIES) <= driver.oracle_sql().keys() <= driver.queries().keys()  # corpus queries may lack SQL


def test_entry_without_the_corpus_folders(tmp_path):
    """A copy without those folders still has every other query and its SQL."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "toolmill", tmp_path / "toolmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES))] * 2, said.stderr
