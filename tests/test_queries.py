"""Every registered plan with an oracle gives DuckDB's rows at the smallest scale; those without are tested elsewhere."""

import math
import os
from decimal import Decimal

import pytest

import cityloom.plans as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Plans that find nothing in so few rows; larger tables show them.
SPARSE = {"pruned_graph", "segment_crossings", "t_junctions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    expected = rows(want.columns, want.fetchall())
    assert expected or name in SPARSE, "an oracle without rows shows nothing"
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected
