"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import pytest

from tests.conftest import SF
from tidewell.plans.queries import ORACLES, QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted([plain(row[names.index(c)]) for c in columns] for row in found.fetchall())
    got = sorted([plain(row[c]) for c in columns] for row in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
