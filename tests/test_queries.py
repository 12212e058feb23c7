"""Every registered query against its SQL on DuckDB; without SQL, it must run and give rows."""

from __future__ import annotations

import pytest

from duskwatch import catalog
from duskwatch.plans.registry import all_queries

from .compare import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    query = all_queries()[name]
    df = query.run(spark, SF)
    if query.sql:
        assert same(df, con, query.sql) == ""
    else:
        assert df.count() > 0


def test_catalog():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.oracle_sql()) >= 80


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    for item in ("duskwatch", "__spark_entry__.py"):
        source = f"{__file__.rpartition('/tests/')[0]}/{item}"
        (shutil.copytree if item == "duskwatch" else shutil.copy)(source, tmp_path / item)
    shutil.rmtree(tmp_path / "duskwatch/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 80 and out[1] == "False"
