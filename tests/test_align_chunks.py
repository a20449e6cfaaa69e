"""Groups aligned in one call come out as they do alone, and the work isn't gathered in a task."""


def test_groups_of_a_tile_are_aligned_as_alone(spark):
    from cityloom.operators.alignment import aligned

    head = "k long, id long, x double, y double, cx double, cy double, half_x double, half_y double, ax double, ay double"
    field = spark.createDataFrame([(0, r, c, 0.2 + (r * 7 + c * 3) % 5 / 8) for r in range(30) for c in range(30) if (r + 2 * c) % 3], "k long, row long, col long, f double")
    edges = spark.createDataFrame([(0, 0.0, 60.0)], "k long, left double, top double")
    box = lambda i, x, y: [(0, i, x + u * 4.0, y + v * 3.0, x, y, 4.0, 3.0, 1.0, 0.0) for u in (-1, 0, 1) for v in (-1, 1)]
    groups = {i: box(i, 15.0 + 4 * i, 20.0 + 3 * i) for i in range(1, 6)}
    run = lambda rows: aligned(spark.createDataFrame(rows, head), field, edges, "k", "id")
    every = run([r for g in groups.values() for r in g])
    assert "REPARTITION_BY_NUM" in every._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: tuple(r) for r in every.collect()}
    assert set(got) == set(groups) and all(r[2] for r in got.values())
    for i in (1, 4):
        assert [tuple(r) for r in run(groups[i]).collect()] == [got[i]]
