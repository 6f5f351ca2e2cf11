"""The driver's entry, with and without the subpackage that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["scope_id", "checksum", "members"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_alone(tmp_path):
    shutil.copytree(REPO, tmp_path / "copy", ignore=lambda d, names: {n for n in names if n in (".git", "corpus_pipeline.py") or n == "llm"})
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)
    rest = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_operators.py", "-k", "limits or cursors"]  # those that need no session
    subprocess.run(rest, cwd=tmp_path / "copy", check=True, timeout=120)
