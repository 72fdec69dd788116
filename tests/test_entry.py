"""The entry works without the training-data operators, and without a library that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

BLOCKED = """
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {lib!r} or name == {lib!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
warnings.simplefilter("ignore")
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q)
print(len(q), sum(n.startswith("op") and n[2].isdigit() for n in q), "risk_score" in q, "pipeline" in q)
"""


@pytest.mark.parametrize("lib", ["tributary.llm", "ahocorasick", "xxhash"])
def test_base_queries_stay(lib):
    root = Path(__file__).parent.parent
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(lib=lib)], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["0", "True", "False"]
