"""Every query with a SQL counterpart gives the same rows in both engines."""

import pytest

from papyrine.plans import registry
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, data, duck):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "papyrine.llm" not in f.read_text(), f
