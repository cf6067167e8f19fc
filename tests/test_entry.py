"""The driver's entry, with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_registry(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("gone", [("corpus_pipeline", "stormlake.llm"), ("public_tokenizers",), ("tiktoken",)])
def test_the_rest_stands_without_them(gone):
    code = f"GONE = {gone!r}" + """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(GONE):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and "column_products" in e.queries()
assert not any(m.startswith(GONE) for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
