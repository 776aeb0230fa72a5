import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_text_subpackage():
    for f in (ROOT / "docspark").rglob("*.py"):
        if (ROOT / "docspark" / "llm") not in f.parents:
            assert not re.search(r"^\s*(from|import)\s+docspark\.llm", f.read_text(), re.M), f


def test_no_lineage_is_cut_without_a_copy_and_no_process_memory_is_cached():
    for f in (ROOT / "docspark").rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
