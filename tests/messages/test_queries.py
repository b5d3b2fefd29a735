"""Every registered message query against DuckDB on the same tables."""

import math

import pytest

from loomline.plans import catalog
from tests.conftest import SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    mine = catalog.queries()[name](spark, SMALL)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    ours = sorted([tuple(map(_norm, r)) for r in mine.select(*cols).collect()], key=str)
    want = sorted([tuple(map(_norm, r)) for r in theirs.fetchall_by(cols)] if hasattr(theirs, "fetchall_by") else [tuple(map(_norm, r)) for r in theirs.select(*[f'"{c}"' for c in cols]).fetchall()], key=str)
    assert ours == want
