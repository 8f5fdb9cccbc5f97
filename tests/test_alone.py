"""The engine without the language-model operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 60 and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize("gone", [("padlake/llm", "tests/llm"), ("padlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_stands_alone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        shutil.rmtree(copy / path, ignore_errors=True)
        (copy / path).unlink(missing_ok=True) if (copy / path).is_file() else None
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout
