"""The registry on a copy of the repository without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("marlstone/llm", "tests/llm"), ("marlstone/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_registry_without_the_optional_parts(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "artifacts"))
    for x in gone:
        if (at / x).exists():
            shutil.rmtree(at / x) if (at / x).is_dir() else (at / x).unlink()
    code = "import __spark_entry__ as r; q, s = r.queries(), r.oracle_sql(); print(len(q), 'pipeline' in q, set(s) <= set(q))"
    env = {**os.environ, "PYTHONPATH": str(at)}
    said = subprocess.run([sys.executable, "-c", code], cwd=at, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, pipeline, known = said.stdout.split()
    assert int(n) > 50 and pipeline == "False" and known == "True"
