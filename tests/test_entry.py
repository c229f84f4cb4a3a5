"""The driver's contract, and that the library stands without the training-data subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert sql.keys() <= q.keys() and all(isinstance(x, str) for x in sql.values())
    df = e.entry(spark)
    assert df.columns == ["s", "p", "o"] and df.count() > 0


def test_stands_without_the_subpackage(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT / "tripleloom", to / "tripleloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=120)


def test_nothing_outside_the_subpackage_imports_it():
    for p in (ROOT / "tripleloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", p.read_text()), p
