"""The library, its entry and its tests work without the training-data operators, with or without the pipeline's file."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) > 100 and len(sql) > 100 and "pipeline" not in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
"""


@pytest.mark.parametrize("gone", [("columnscope/llm", "tests/llm"), ("columnscope/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_them(tmp_path, gone):
    def absent(folder, names):
        inside = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(inside, n)) in gone]

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=absent)
    assert not (copy / "columnscope/llm").exists() and (copy / "corpus_pipeline.py").exists() == ("corpus_pipeline.py" not in gone)
    environment = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env=environment)
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=environment, capture_output=True, text=True)
    assert listed.returncode == 0 and "test_matches_sql[top_k]" in listed.stdout, listed.stdout[-2000:]
