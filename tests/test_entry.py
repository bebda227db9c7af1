"""The driver's contract where optional parts are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), any(n.startswith('op1') for n in names))"


@pytest.mark.parametrize("missing", ["caselog.llm", "caselog.llm.queries", "corpus_pipeline"])
def test_other_queries_stay(missing):
    """A part that cannot be imported leaves out its own queries only."""
    block = f"import sys; sys.modules['{missing}'] = None; "
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", block + COUNT], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    number, optional = done.stdout.split()
    assert int(number) >= 119 and (optional == "True") <= (missing == "corpus_pipeline")
