"""The driver contract, with and without the training-data subpackage."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from metalint.plans.catalogue import ORACLES, QUERIES

_SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def _shown(folder):
    done = subprocess.run([sys.executable, "-c", _SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return map(set, json.loads(done.stdout))


@pytest.mark.parametrize("gone", [("metalint/llm", "tests/llm"), ("metalint/llm", "tests/llm", "corpus_pipeline.py")])
def test_library_stands_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in {".git", "__pycache__"} or os.path.relpath(os.path.join(folder, n), ROOT) in gone])
    queries, sql = _shown(copy)
    assert queries == set(QUERIES) and sql == set(ORACLES)


def test_all_queries_are_registered():
    queries, sql = _shown(ROOT)
    assert queries > set(QUERIES) and sql <= queries
