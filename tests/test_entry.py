"""The driver's entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [["fluvius/llm"], ["fluvius/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    for name in ("fluvius", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{REPO}/{name}"):
            shutil.copytree(f"{REPO}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True) if os.path.isdir(tmp_path / name) else (tmp_path / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= int(said[1]) > 70 and said[2] == "0"
