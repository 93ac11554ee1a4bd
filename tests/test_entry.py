import importlib
import re
from pathlib import Path

import pytest

entry = importlib.import_module("__spark_entry__")
ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (ROOT / "quadrant").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.MULTILINE), path


LLM = [n for n in entry.queries() if n not in entry.catalogue.QUERIES]


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in LLM))
def test_core_queries_run(spark, small, name):
    assert len(entry.queries()[name](spark, small).columns) > 0
    entry.queries()[name](spark, small).limit(5).collect()
