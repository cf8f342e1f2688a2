"""The driver's contract, and that nothing outside the subpackage needs it."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_oracle_has_its_query():
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_only_the_entry_module_imports_the_subpackage():
    for path in (ROOT / "pagewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"pagewright(\.| import )llm|corpus_pipeline", path.read_text()), path
