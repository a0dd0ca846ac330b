"""The library works with the training-data subpackage and the pipeline deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'units_by_lang' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr


def test_nothing_else_imports_it():
    for f in (ROOT / "quire").rglob("*.py"):
        if "llm" not in f.parts:
            assert "quire.llm" not in f.read_text(), f
