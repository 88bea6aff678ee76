import subprocess
import sys
from pathlib import Path


def test_the_entry_is_imported_without_a_session():
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q)"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
