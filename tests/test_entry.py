"""The entry points with parts of the repository absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("absent", [("rolecast/llm",), ("rolecast/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_training_text_operators(tmp_path, absent):
    ignore = shutil.ignore_patterns("__pycache__", ".git")
    shutil.copytree(f"{ROOT}/rolecast", tmp_path / "rolecast", ignore=lambda d, names: {
        *ignore(d, names), *(["llm"] if "rolecast/llm" in absent and d == f"{ROOT}/rolecast" else [])})
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in absent and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    queries, more = map(int, out.stdout.split())
    assert queries > 80
    if "rolecast/llm" in absent:
        assert more == 0
