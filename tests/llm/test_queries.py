"""Queries against their check SQL, and those without SQL for their rows."""

import pytest

import __spark_entry__ as entry
from tests.llm.conftest import SMALL
from tonearm.check import compare, duck
from tonearm.llm import queries


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_all_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    status, _, _, _, note = compare(spark, con, SMALL, name, queries.QUERIES[name], queries.ORACLE.get(name))
    assert status in ("ok", "rows"), f"{status} {note}"
