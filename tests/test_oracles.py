"""Every registered query against an independent SQL engine on the same files."""

from __future__ import annotations

import math

import numpy as np
import pytest

import __spark_entry__ as registered
from tests.conftest import SMALL

QUERIES = registered.queries()
SQL = registered.oracle_sql()
# Beyond SQL: a search that depends on its own earlier rounds, searches too large for it (test_tuning.py), and text operators that tests/llm compares with plain code.
NO_SQL = {"tune_forest_guided", "search_forest", "search_forest_guided", "search_forest_hot"}
if registered.text_queries:
    NO_SQL |= {"pipeline", *(set(registered.text_queries.QUERIES) - set(registered.text_queries.SQL))}


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    got = rows_of(result.collect(), result.columns)
    assert got
    assert (name in SQL) != (name in NO_SQL)
    if name in NO_SQL:
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    want = rows_of(cursor.fetchall(), columns)
    assert len(got) == len(want)
    assert [repr(r) for r in got] == [repr(r) for r in want]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() == 200
