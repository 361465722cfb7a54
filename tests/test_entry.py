import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr
    count, subset, has_pipeline, has_ops = got.stdout.split()
    assert int(count) >= 30 and subset == "True" and has_pipeline == has_ops == "False"
