"""The entry module must work in copies that lack the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(sum(n.startswith(('op', 'pipeline')) for n in e.queries()), len(e.queries()) > 100)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_the_optional_folders(tmp_path, pipeline):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "obligor", tmp_path / "obligor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.split() == ["0", "True"], run.stderr
