"""Every registered query against its SQL twin."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, normal
from tests.conftest import ROOT


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
