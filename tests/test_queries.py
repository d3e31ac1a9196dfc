"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from checks.compare import connect, differences, unequal
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]

pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, FOLDERS)), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return {folder: connect(folder) for folder in FOLDERS}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name, folder):
    assert differences(spark, db[folder], folder, name) is None


def test_comparison_is_strict():
    assert unequal(None, "") and unequal(2**53, 2**53 + 1) and unequal(1, 1.0) and unequal("1", 1) and unequal(1.0, 1.0001)
    assert not unequal(None, None) and not unequal(0.1 + 0.2, 0.3) and not unequal(2**53, 2**53) and not unequal(True, True)
