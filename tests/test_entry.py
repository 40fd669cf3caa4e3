"""The driver's entry without what only the training-data operators need."""

import subprocess
import sys
from pathlib import Path


def test_core_queries_without_a_package():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; from hypomill.plans.queries import QUERIES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
