"""Every registered query against its SQL counterpart in DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from planlens.plans.oracle_sql import oracle_sql  # noqa: E402
from planlens.plans.queries import registered  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, FOLDER).toArrow()
    assert differences(result, duck.sql(ORACLE[name]).to_arrow_table()) == []


def test_every_query_has_a_counterpart():
    assert sorted(ORACLE) == sorted(registered())
    assert entry_points.queries().keys() >= registered().keys()
    assert entry_points.oracle_sql().items() >= ORACLE.items()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 73
