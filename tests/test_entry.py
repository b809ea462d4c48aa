"""The entry module with and without the llm subpackage and the pipeline built on it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["planimetra/llm", "tests/llm"], ["planimetra/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone, *(Path(g).name for g in gone)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q[:2] == 'op' and q[2].isdigit() for q in e.queries()))"], cwd=copy, capture_output=True, text=True, timeout=120)
    n, *rest = done.stdout.split()
    assert int(n) > 100 and rest == ["False", "False"], done.stderr
