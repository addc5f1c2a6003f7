"""The queries that SQL can express, against DuckDB; the entry point without this part."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import compare, duck
from corpus import SF

from souk.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = compare(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])
    assert got["ok"], got


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_entry_point_without_this_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "souk"), tmp_path / "souk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) >= 46 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
