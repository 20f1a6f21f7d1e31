"""The package without its llm subpackage: what is left imports and answers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert found and sql and set(sql) <= set(found)
assert not [n for n in found if n.startswith("op") or n == "pipeline"]
print(len(found))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_llm(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    if not pipeline and (copy / "corpus_pipeline.py").exists():
        os.remove(copy / "corpus_pipeline.py")
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(copy))], cwd=copy, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 80
