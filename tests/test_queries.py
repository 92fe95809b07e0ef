"""Every registered query of the core against its SQL on the smallest tables."""

import os

import oracle
import pytest

from quernel.plans import catalogue

DIR = os.environ.get("QUERNEL_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    query, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql:
        assert oracle.compare(spark, con, query, sql, DIR) is None
    else:
        assert query(spark, DIR).columns


def test_entry_needs_no_session_to_import():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_core_does_without_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "quernel"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "quernel.llm" not in path.read_text() and "from .llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
