"""Heights of a graph against numpy's least squares, in a task and across tasks."""

import numpy as np
import pytest

from cityloom.operators import graph_heights as gh


def network(seed, n=40, more=25):
    r = np.random.default_rng(seed)
    edges = {(int(r.integers(0, i)), i) for i in range(1, n)} | {tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(more)}
    true = np.cumsum(r.normal(0, 2, n))
    samples = []
    for k, (a, b) in enumerate(sorted(edges)):
        for t in r.uniform(0, 1, 1 if k % 9 == 0 else 5):
            samples.append((a, b, float(t), float((1 - t) * true[a] + t * true[b] + r.normal(0, 0.3))))
    return sorted(edges), samples


def by_numpy(samples):
    nodes = sorted({x for s in samples for x in s[:2]})
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(samples), len(nodes)))
    for i, (a, b, t, _) in enumerate(samples):
        m[i, at[a]] += 1 - t
        m[i, at[b]] += t
    return dict(zip(nodes, np.linalg.lstsq(m, np.array([s[3] for s in samples]), rcond=1e-10)[0]))


@pytest.mark.parametrize("small", [10**9, 0])
def test_least_norm_solution_in_a_task_and_across(spark, small):
    samples = [s for base in (0, 1000) for s in [(a + base, b + base, t, z) for a, b, t, z in network(base + 1, 25, 15)[1]]] + [(5000, 5001, 0.25, 8.0)]
    df = spark.createDataFrame([((a // 1000), *s) for s in samples for a in s[:1]], "component long, a long, b long, t double, z double").repartition(4)
    got = {r["node"]: r["z"] for r in gh.least_squares(df, small).collect()}
    want = by_numpy(samples)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_rejection_steep_edges_and_spread(spark):
    # a path 0..5 with an outlier, an edge of outliers only, a steep edge to a leaf, a component of a steep edge, one without samples
    flat = [(i, i + 1, t, 10.0 + i + t) for i in range(5) for t in (0.1, 0.5, 0.9)]
    samples = flat + [(2, 3, 0.5, 40.0), (2, 3, 0.5, -15.0)]
    samples += [(0, 20, 0.5, 60.0), (0, 20, 0.5, -60.0)] + [(5, 6, t, 15.0 + 90 * t) for t in (0.2, 0.8)] + [(6, 7, 0.5, 105.0), (6, 7, 0.4, 105.0), (6, 7, 0.9, 105.0)]
    samples += [(30, 31, 0.0, 1.0), (30, 31, 1.0, 99.0)]
    pairs = sorted({s[:2] for s in samples} | {(40, 41)})
    edges = spark.createDataFrame([(a, b, 10.0, (a, b) == (50, 51)) for a, b in pairs], "a long, b long, length double, exempt boolean")
    heights, states = gh.fitted(edges, spark.createDataFrame(samples, "a long, b long, t double, z double"))
    state = {(r["a"], r["b"]): r["state"] for r in states.collect()}
    assert state[0, 20] == "unreliable" and state[5, 6] == "steep" and state[30, 31] == "dropped" and state[40, 41] == "unseen"
    assert all(state[i, i + 1] == "kept" for i in range(5)) and state[6, 7] == "kept"
    z = {r["node"]: (r["z"], r["level"]) for r in heights.collect()}
    assert set(z) == {0, 1, 2, 3, 4, 5, 6, 7} and all(abs(z[i][0] - 10 - i) < 1e-6 and z[i][1] == 0 for i in range(6))


def test_a_large_component_is_solved_across_tasks(spark):
    n = 100_000
    side = 316
    grid = spark.range(side * side).selectExpr("id", "id div {0} AS i".format(side), "id % {0} AS j".format(side))
    h = "(10 + sin({0} / 30.0) * 5 + {1} / 50.0)"
    right = grid.filter(f"j < {side - 1}").selectExpr("id AS a", "id + 1 AS b", h.format("i", "j") + " AS za", h.format("i", "(j + 1)") + " AS zb")
    down = grid.filter(f"i < {side - 1}").selectExpr("id AS a", f"id + {side} AS b", h.format("i", "j") + " AS za", h.format("(i + 1)", "j") + " AS zb")
    edges = right.union(down)
    samples = edges.selectExpr("0L AS component", "a", "b", "za", "zb", "explode(array(0.1D, 0.4D, 0.9D)) AS t").selectExpr("component", "a", "b", "t", "(1 - t) * za + t * zb AS z")
    got = gh.least_squares(samples)
    assert got.count() == side * side and side * side > n - 200
    worst = got.join(grid, got["node"] == grid["id"]).selectExpr("max(abs(z - " + h.format("i", "j") + ")) AS e").first()["e"]
    assert worst < 1e-6
