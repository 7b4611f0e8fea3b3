"""The driver's entry module."""

from __future__ import annotations

import importlib
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_and_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_llm_folder():
    """With imports of the llm subpackage and the pipeline blocked, the entry still has the core queries."""
    code = "import sys; sys.modules['keyloft.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
