"""The driver contract, also in a copy without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [(), ("lithoframe/llm", "tests/llm"), ("lithoframe/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)
    assert out.returncode == 0, out.stderr
    number, some = out.stdout.split()
    assert int(number) > 80 and (some == "True") == (os.path.isdir(copy / "lithoframe/llm"))
