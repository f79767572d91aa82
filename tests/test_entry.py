"""The driver's entry with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from sieveline import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [set(line.split()) for line in done.stdout.split("\n")[:2]]


@pytest.mark.parametrize("left_out", [("sieveline/llm",), ("sieveline/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_corpus_operators(tmp_path, left_out):
    shutil.copytree(f"{ROOT}/sieveline", tmp_path / "sieveline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if file not in left_out and os.path.exists(f"{ROOT}/{file}"):
            shutil.copy(f"{ROOT}/{file}", tmp_path)
    queries, oracles = names(tmp_path)
    assert queries == set(plans.QUERIES) and oracles == set(plans.ORACLES)


def test_entry_holds_every_query():
    queries, oracles = names(ROOT)
    assert set(plans.QUERIES) <= queries and oracles <= queries
