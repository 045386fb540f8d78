"""Every query against its SQL on the smallest tables, and the shape of the catalog."""

import inspect
import re

import pytest

import __spark_entry__ as entry_module
from check_oracles import connect, differences
from obligor.catalog import queries as catalog

FOLDER = entry_module.SMOKE_DIR
SQL = entry_module.oracle_sql()
# Survey sections and how many operators each has.
INVENTORY = {"s": 7, "p": 12, "f": 14, "e": 11, "t": 4, "m": 14, "g": 18, "x": 5, "d": 6}


def test_every_inventory_line_has_a_query():
    names = set(entry_module.queries())
    for letter, count in INVENTORY.items():
        for number in range(1, count + 1):
            assert any(re.match(f"{letter}{number}_", n) for n in names), f"{letter}{number}"


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(entry_module.queries())


def test_queries_read_whole_tables():
    source = inspect.getsource(catalog)
    assert ".sample(" not in source and ".limit(" not in source and ".head(" not in source


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = entry_module.queries()[name](spark, FOLDER).toPandas()
    # A database per statement: one that breaks down takes no other with it.
    with connect(FOLDER) as connection:
        want = connection.sql(SQL[name]).df()
    assert len(want) > 0
    assert differences(got, want) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
