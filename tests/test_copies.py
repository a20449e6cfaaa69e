"""Copies among members: all footprints as they are."""

import os

import duckdb
import pytest

from cityloom.plans import QUERIES
from cityloom.plans.registry import VIEWS

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_members_are_the_footprints_themselves(spark):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
        members = c.execute(f"SELECT id, x0, y0, x1, y1 FROM ({VIEWS['v_box']})").fetchall()
    size = lambda m: (m[3] - m[1]) * (m[4] - m[2])
    kept = []
    for m in sorted(members, key=lambda m: (size(m), m[0])):
        for k in kept:
            w, h = min(m[3], k[3]) - max(m[1], k[1]), min(m[4], k[4]) - max(m[2], k[2])
            if m[1:] == k[1:] or (w > 0 and h > 0 and w * h >= 0.95 * max(size(m), size(k))):
                break
        else:
            kept.append(m)
    assert {r["id"] for r in QUERIES["dedupe_members"](spark, SF).collect()} == {k[0] for k in kept}
