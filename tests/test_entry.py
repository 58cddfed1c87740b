"""The entry points without the corpus operators, or without what they need."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(len(e.oracle_sql()))"


def names(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + NAMES], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    return done.stdout.split()


@pytest.fixture
def copy(tmp_path):
    for name in ("cellweave", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    return tmp_path


def test_core_without_the_corpus_folder(copy):
    shutil.rmtree(copy / "cellweave" / "llm", ignore_errors=True)
    found = names(copy)
    assert "cell_metrics" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_core_without_a_needed_library(copy):
    found = names(copy, "import sys; sys.modules['ahocorasick'] = None\n")
    assert "cell_metrics" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
