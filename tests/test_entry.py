"""The entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": folder}).stdout


def test_without_the_corpus_operators(tmp_path):
    for gone in (["chromaweave/llm", "tests"], ["chromaweave/llm", "tests", "corpus_pipeline.py"]):
        to = tmp_path / str(len(gone))
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for x in gone:
            (shutil.rmtree if (to / x).is_dir() else os.remove)(to / x)
        out = names(str(to))
        assert "regression_with_multiplicity" in out and "op1_" not in out and "pipeline" not in out
