"""The library stands without the training-data subpackage, which nothing else imports."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for f in (ROOT / "marginalia").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), 'p2_found' in q, 'p1_found' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["True", "True", "False"], out.stderr
