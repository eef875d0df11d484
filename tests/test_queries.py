"""Every query against its SQL, and the contract of the entry module."""

import os
import subprocess
import sys

import pytest

from graphloom.plans import registry
from oracle import differences, duck

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@here
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df, sql = registry.queries()[name](spark, SF), registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, duck(SF), sql)[:2] == ([], [])


def test_nothing_else_needs_the_optional_parts(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q; e.oracle_sql()"
    subprocess.run(["cp", "-r", f"{ROOT}/graphloom", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "graphloom/llm")], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
