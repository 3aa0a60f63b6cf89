"""Every query against its DuckDB oracle at the smallest scale."""

import os

import pytest

import tools_compare
from recordloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = tools_compare.compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name), SF)
    assert ": ok," in got or "no oracle" in got, got


def test_entry_imports_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['recordloom.llm'] = None; import __spark_entry__ as e; assert 'kpi_orders' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
