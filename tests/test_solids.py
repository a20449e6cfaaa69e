"""Solids: a small file's rows go over all partitions before the work, and each face is met once."""

from pyspark.sql import functions as F

from cityloom import jts, plans
from cityloom.functions import geometry as G
from cityloom.operators.solids import faces, measured

SMALL = "/root/testdata/sf0.001"


def test_open_edges_of_torn_solids(spark):
    jts.register(spark)
    v = spark.createDataFrame([(1, 4.0), (2, 7.0), (3, 5.0)], "id long, x1 double").withColumn("ring", G.box_ring(F.lit(0.0), F.lit(0.0), F.col("x1"), F.lit(3.0)))
    f = faces(v, "id", "ring", lambda x, y: F.lit(0.0), lambda x, y: F.lit(2.0))
    # the second stands without its top, the third has one face too many
    torn = f.filter("id <> 2 OR kind <> 'top'")
    torn = torn.union(f.filter("id = 3 AND kind = 'top'").limit(1))
    got = {r["id"]: (r["faces"], r["edges"]) for r in measured(torn, "id").collect()}
    assert got == {1: (12, 0), 2: (10, 4), 3: (13, 3)}
    assert abs(measured(f, "id").filter("id = 1").first()["volume"] - 24) < 1e-9


def test_solids_are_spread_before_the_work(spark):
    for query in ("building_solids", "compound_models"):
        plan = plans.QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "Join" not in plan
    # footprints go by their own key, so that nothing is shuffled after
    assert plans.QUERIES["building_solids"](spark, SMALL)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
