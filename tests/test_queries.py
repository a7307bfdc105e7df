"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from shelfmark.plans import catalogue
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLES:
        expected = oracle.connect(FOLDER).execute(catalogue.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert oracle.rows(found) == oracle.rows(expected)
