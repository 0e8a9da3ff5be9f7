"""The core stands without the subpackage for training data."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_core_does_not_import_the_llm_subpackage():
    for path in (ROOT / "recallframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"recallframe\.llm|from recallframe import llm", path.read_text()), path


def test_every_query_can_be_listed():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "hybrid_blend" in names and not set(entry.oracle_sql()) - set(names)
