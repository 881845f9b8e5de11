"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import same
from conftest import SF

from tributary.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, duck):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


def test_every_query_has_a_twin_or_a_test():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry_needs_no_session():
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
