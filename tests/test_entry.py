import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_is_imported_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, sql = map(int, done.stdout.split())
    assert queries >= sql > 0
