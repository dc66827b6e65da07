"""Every registered query against its DuckDB check on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module
import check

CHECKED = sorted(entry_module.oracle_sql())


def test_every_check_belongs_to_a_query():
    assert set(CHECKED) <= set(entry_module.queries())


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_check(spark, db, sf_dir, name):
    assert check.compare(spark, db, sf_dir, name).startswith("ok rows=")


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(CHECKED)))
def test_query_without_a_check_gives_rows(spark, sf_dir, name):
    assert entry_module.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
