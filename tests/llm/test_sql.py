"""Every training-text query that has SQL next to it, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from checks import compare
from venuematch.llm.queries import ORACLES, QUERIES

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]

pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, FOLDERS)), reason="test tables are not here")


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, monkeypatch, name, folder):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    db = compare.connect(folder)
    assert compare.differences(spark, db, folder, name) is None
    assert db.sql(ORACLES[name]).limit(1).fetchall()
