"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_training_data(tmp_path):
    """In a copy without the subpackage the entry file gives every other query, whether or not the pipeline's file is there."""
    shutil.copytree(os.path.join(ROOT, "weftline"), tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    for _ in range(2):
        code = "import __spark_entry__ as e; from weftline import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES)"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
