"""Warping distances under a radius against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.operators import kernels as kn
from axonlake.operators import warping as wp


def plain(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return cost[-1, -1]


def traces(seed):
    """Groups of like traces at several levels, of several lengths, some of one sample, repeated, empty, with gaps."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(60):
        n = int(rng.choice([1, 2, 12, 13]))
        level = float(rng.choice([0, 40, -300]))
        out.append((i, f"g{i % 2}", [level + float(v) for v in rng.normal(0, 1, n)]))
    out += [(100, "g0", out[0][2]), (101, "g0", []), (102, "g0", None), (103, "g0", [0.0, None, 1.0]), (104, None, [1.0]), (105, None, [1.0])]
    return out


@pytest.mark.parametrize("seed,eps", [(0, 3.0), (1, 12.0), (2, 0.0), (3, 90.0)])
def test_near_pairs_equal_all_pairs(spark, seed, eps):
    rows = traces(seed)
    df = spark.createDataFrame([(*r, 1.0, "f") for r in rows], "trial long, g string, dff array<double>, dist double, f string")
    whole = [r for r in rows if r[2] and None not in r[2]]
    want = {}
    for n, (i, g, a) in enumerate(whole):
        for j, h, b in whole[n + 1 :]:
            if g == h and g is not None and (d := plain(a, b)) <= eps:
                want[g, i, j] = d
    got = {(r["g"], r["i"], r["j"]): r["dist"] for r in wp.near_pairs(df, ["g"], eps).collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert wp.near_pairs(df.limit(0), ["g"], eps).collect() == []


def test_few_tables_are_computed(spark):
    """Traces of other levels are told apart by their ends and extremes alone."""
    df = spark.createDataFrame([(i, "g", [float(v) for v in 1000 * (i // 4) + np.random.default_rng(i).normal(0, 0.1, 20)]) for i in range(400)], "trial long, g string, dff array<double>")
    assert wp.candidate_pairs(df, ["g"], 12.0).count() == 400 * 3 // 2  # of 79,800 pairs
    plan = wp.near_pairs(df, ["g"], 12.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables_are_given_up():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 30)), rng.normal(size=(200, 25))
    y[:50] = x[:50, :25] + 0.01
    every = wp.dtw_many(x, y)
    assert np.allclose(every, [plain(a, b) for a, b in zip(x, y, strict=True)])
    for radius in (0.0, 3.0, float(np.median(every)), 1e9):
        got = wp.dtw_many(x, y, radius)
        assert np.array_equal(got[every <= radius], every[every <= radius]) and (got[every > radius] > radius).all()


def test_clean_and_removed(spark):
    df = spark.createDataFrame([(i, "n", "s", [float(v)] * 5) for i, v in enumerate([0, 0.1, 0.2, 50, 90, 90.1])], "trial long, neuron string, stimulus string, dff array<double>")
    keys = ["neuron", "stimulus"]
    labels = kn.cluster_trials(wp.near_pairs(df, keys, 12.0), df.select(*keys, F.col("trial").alias("item")), keys)
    assert {r["item"]: r["label"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: 1, 5: 1}
    clean, removed = wp.noise_split(df, labels, keys)
    assert sorted(r["trial"] for r in clean.collect()) == [0, 1, 2, 4, 5] and [r["trial"] for r in removed.collect()] == [3]
    assert clean.columns == df.columns or set(clean.columns) == set(df.columns)
