"""Queries of this subpackage that SQL can express, over the whole small tables."""

import pytest
from conftest import same_rows

from fathom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
