"""The library without the training-data subpackage, its tests and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import __spark_entry__ as e, strandlake.plans as p, jobs.queries as j
assert set(e.queries()) == set(p.QUERIES) | set(j.queries()) and set(e.oracle_sql()) == set(p.SQL) | set(j.oracle_sql())
import importlib, pkgutil, strandlake
for m in pkgutil.walk_packages(strandlake.__path__, "strandlake."):
    importlib.import_module(m.name)
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_stands_without_llm(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
