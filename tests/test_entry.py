"""The driver's contract, and that the core does not need the subpackage for texts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_core_imports_nothing_of_the_subpackage():
    code = "import sys; sys.modules['sievework.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sievework.llm" not in path.read_text(), path
