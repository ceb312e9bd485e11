"""The entry without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

TOP = pathlib.Path(__file__).resolve().parent.parent
LOADS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert not [k for k in q if k == 'pipeline' or k.startswith('op')], q.keys(); print(len(q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_loads_without_llm(tmp_path, pipeline):
    """With notewright/llm and tests/llm gone, the other queries load, whether corpus_pipeline.py went with them or not."""
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    out = subprocess.run([sys.executable, "-c", LOADS], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
