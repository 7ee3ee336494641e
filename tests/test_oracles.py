"""Every plan outside the corpus operators against its DuckDB twin, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from revmine.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if hasattr(v, "tzinfo") and v is not None:
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in catalog.ORACLES:
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
