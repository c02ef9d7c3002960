"""The driver's entry: names, schemas, and a library that stands without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).orderBy("id").collect()
    assert rows and [r["id"] for r in rows] == list(range(len(rows))) and rows[0]["n"] >= rows[-1]["n"] >= 20


def test_without_the_llm_subpackage(tmp_path):
    for name in ("lumenlex", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lumenlex/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 40, done.stderr
