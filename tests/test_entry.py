"""The driver contract, with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def test_entry_and_names(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if sf_dir.endswith("sf0.001"):
        assert e.entry(spark).columns == ["o_custkey", "season", "games", "price_total", "price_per_game"]


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['tallyforge.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in Path(ROOT, "tallyforge").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
