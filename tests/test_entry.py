"""The entry module with and without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_training_data_folder():
    code = (
        "import sys; sys.modules['tidemill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and not any(n.startswith('op1') for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_folder():
    for p in (ROOT / "tidemill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
