"""The driver's entry point, with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"], ["panelspark/llm/queries.py"]])
def test_entry_imports_without_the_training_data_folders(tmp_path, also):
    """With both folders deleted, or left empty, and with or without the pipeline's file."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or n == "llm" and Path(d).name in ("panelspark", "tests")])
    for name in also:
        path = copy / name
        if path.exists():
            path.unlink()
        else:
            path.parent.mkdir()  # an empty folder where the package was
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'composite_score' in q and set(s) <= set(q) and not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
