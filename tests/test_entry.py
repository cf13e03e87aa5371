"""The registered queries without the folders that may be left out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("left", ["nothing", "bytecode", "operators only", "pipeline only", "no vocabulary"])
def test_parts_left_out(tmp_path, left):
    skip = shutil.ignore_patterns("__pycache__", "llm") if left != "operators only" else shutil.ignore_patterns("__pycache__")
    if left == "no vocabulary":
        skip = shutil.ignore_patterns("__pycache__")
    shutil.copytree(ROOT / "fleetlens", tmp_path / "fleetlens", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "bytecode":
        (tmp_path / "fleetlens/llm/__pycache__").mkdir(parents=True)
    if left in ("pipeline only", "no vocabulary") and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "no vocabulary":
        (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')\n")
    count, extra, known = names(tmp_path)
    assert int(count) > 150 and extra == "False" and known == "True"
