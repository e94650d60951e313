"""Pairs by blocks against all pairs; what travels and what comes back grows with the traces, not with their pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonlake.operators import kernels as kn
from axonlake.operators import pairs as pr
from axonlake.operators import warping as wp
from axonlake.plans import views

SCHEMA = "trial long, g string, dff array<double>"


def traces(seed):
    """Two groups of three lengths, with copies, gaps, values that aren't finite, missing and empty traces, a missing group and a missing item."""
    rng = np.random.default_rng(seed)
    out = [(i, f"g{i % 2}", [float(v) for v in rng.normal(0, 1, int(rng.choice([4, 4, 4, 5])))]) for i in range(40)]
    out += [(50, "g0", out[0][2]), (51, "g0", []), (52, "g0", []), (53, "g0", None), (54, "g0", [0.0, None, 1.0, 2.0]), (55, None, [1.0] * 4), (None, "g0", [1.0] * 4)]
    return out + [(56, "g1", [float("nan"), 0.0, 0.0, 0.0]), (57, "g1", [float("inf"), 0.0, 0.0, 0.0])]


def plain(df):
    """Edges of all pairs by a join and array functions."""
    p = wp.trial_pairs(df, ["g"], "trial", "dff")
    return p.select("g", "i", "j", F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v).alias("dist"))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("block", [4, 1024])
def test_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK", block)
    df = spark.createDataFrame(traces(block), SCHEMA)
    edges, items = plain(df).persist(), df.select("g", F.col("trial").alias("item"))
    assert edges.where("dist IS NULL").count() and edges.where("isnan(dist)").count()
    assert same(pr.l1_distances(df, ["g"]), edges)
    for k in (1, 2, 50):
        assert same(kn.ranked_distances(pr.l1_nearest(df, ["g"], k), ["g"]), kn.k_distance(edges, ["g"], k))
    for eps, m in ((2.0, 1), (2.0, 2), (2.5, 3), (3.0, 6)):
        near = pr.l1_neighbours(df, ["g"], eps, kn.most_of_sparse(m))
        assert same(kn.noise_of_neighbours(near, items, ["g"], m), kn.density_noise(edges, items, ["g"], eps, m))
    assert pr.l1_distances(df.limit(0), ["g"]).collect() == []


@pytest.mark.parametrize("block", [4, 1024])
def test_warping_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK", block)
    df = spark.createDataFrame([(i, g, x) for i, g, x in traces(7) if x and None not in x and i is not None and i < 56], SCHEMA)
    found = {(r["i"], r["j"]): r["dist"] for r in wp.dtw_distances(df, ["g"]).collect()}
    one = {r["trial"]: r for r in df.where("g IS NOT NULL").collect()}
    want = {(i, j): wp.dtw_many(np.array([one[i]["dff"]]), np.array([one[j]["dff"]]))[0] for i in one for j in one if i < j and one[i]["g"] == one[j]["g"]}
    assert found == want
    near = {(r["i"], r["j"]): r["dist"] for r in wp.near_pairs(df, ["g"], 1.5).collect()}
    assert near == {k: v for k, v in want.items() if v <= 1.5} and near


def test_arrays_travel_with_blocks(spark, monkeypatch):
    """A join of pairs carries 2 arrays for each of 780 pairs; three blocks of 40 traces carry each a few times."""
    monkeypatch.setattr(pr, "BLOCK", 16)
    df = spark.createDataFrame([(i, "g", [float(i), 0.0]) for i in range(40)], SCHEMA)

    def found(met):
        assert len(met.items) < 40
        yield {"n": pa.array([len(met.items)])}

    assert sum(r["n"] for r in pr.met_blocks(df, ["g"], "trial", "dff", found, "n long").collect()) == 40 * 3
    for q in (pr.l1_distances(df, ["g"]), wp.dtw_distances(df, ["g"]), wp.near_pairs(df, ["g"], 3.0)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "") and "NestedLoop" not in plan


def test_rows_go_with_items(spark):
    """Of dense groups, density and k-distance return a row or two an item from the blocks, not their pairs."""
    df = spark.createDataFrame([(i, "g", [float(i % 7), 0.0]) for i in range(300)], SCHEMA)
    near = pr.l1_neighbours(df, ["g"], 100.0, kn.most_of_sparse(3)).collect()
    assert len(near) == 300 and all(r["n"] == 299 and r["near"] is None for r in near)
    assert {tuple(r["near"]) for r in pr.l1_nearest(df, ["g"], 2).collect()} == {(1.0, 1.0)}


def test_single_precision_never_loses_a_pair():
    """Near the radius, far from zero, and with few samples: what is within the radius comes back as without one."""
    rng = np.random.default_rng(1)
    for level, spread in ((0, 1), (1e6, 1), (1e12, 1), (-3e4, 1e-3), (1e31, 1e30)):
        x, y = level + spread * rng.normal(size=(700, 20)), level + spread * rng.normal(size=(700, 18))
        every = wp.dtw_many(x, y)
        for radius in (*np.quantile(every, [0.01, 0.5]), 0.0):
            got = wp.dtw_many(x, y, radius)
            assert np.array_equal(got[every <= radius], every[every <= radius]) and (got[every > radius] > radius).all()


@pytest.mark.parametrize("block", [8, 1024])
def test_few_pairs_connect_what_all_do(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK", block)
    monkeypatch.setattr(wp, "TURN", 64)
    rng = np.random.default_rng(2)
    rows = [(i, f"g{i % 2}", [float(v) for v in 3.0 * rng.integers(0, 5) + rng.normal(0, 0.2, int(rng.choice([1, 4, 5])))]) for i in range(120)] + [(500, "g0", []), (501, "g0", [9e9] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    items = df.select("g", F.col("trial").alias("item"))
    near, few = wp.near_pairs(df, ["g"], 1.5).persist(), wp.linking_pairs(df, ["g"], 1.5).persist()
    assert few.count() < near.count() and few.exceptAll(near).count() == 0
    for m in (1, 2, 4):
        want = kn.cluster_trials(near, items, ["g"], 1.5, m).persist()
        assert same(kn.warped_clusters(df, ["g"], 1.5, m), want) and want.select("label").distinct().count() > 2


def test_dense_groups_are_linked_once(spark, monkeypatch):
    """Blocks that are connected by themselves look for one link where they meet, not one for each trace again."""
    monkeypatch.setattr(pr, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = [(i, "g0", [float(v) for v in rng.normal(0, 0.1, 6)]) for i in range(400)] + [(900, "g0", [3.0] * 6), (901, "g0", [3.1] * 6), (902, "g0", [9.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    few = wp.linking_pairs(df, ["g"], 2.0)
    assert few.count() < 500 and few.exceptAll(wp.near_pairs(df, ["g"], 2.0)).count() == 0
    labels = {r["item"]: r["label"] for r in kn.warped_clusters(df, ["g"], 2.0).collect()}
    assert labels == {**dict.fromkeys(range(400), 0), 900: 1, 901: 1, 902: -1}


def test_noise_is_told_across_blocks(spark, monkeypatch):
    """A trial that is alone in its own block, and near one of another, isn't taken out; what is near none is, in groups of one block too."""
    monkeypatch.setattr(pr, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, "g0", [float(v) for v in 10.0 * (i % 30) + rng.normal(0, 0.05, 5)]) for i in range(60)] + [(100 + i, "g0", [-50.0 * (i + 1)] * 5) for i in range(9)]
    rows += [(200, "g1", [0.0] * 5), (201, "g1", [0.1] * 5), (202, "g1", [5.0] * 5), (300, "g2", [0.0] * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    clean, removed = wp.noise_split(df, kn.warped_clusters(df, ["g"], 1.5), ["g"])
    assert sorted(r["trial"] for r in removed.collect()) == [*range(100, 109), 202, 300]
    assert sorted(r["trial"] for r in clean.collect()) == [*range(60), 200, 201]


def test_slow_pairs_of_one_group_are_dealt_out(spark):
    """All warping distances of one group go to several tasks, none of which holds all its traces; other pairs need not."""
    df = spark.createDataFrame([(i, "g", [float(i % 9), 0.0]) for i in range(600)], SCHEMA)
    got = wp.dtw_distances(df, ["g"]).select("i", "j", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == 600 * 599 // 2 and len(got) > 1 and max(r["n"] for r in got) < 0.8 * 600 * 599 // 2


def test_tables_serve_again(monkeypatch):
    """Tables that pairs before were measured in, the last ones fewer; no cell of theirs is taken over."""
    monkeypatch.setattr(wp, "TABLES", 7)
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (1, 6), (6, 1), (5, 9), (9, 5), (40, 33)):
        x, y = rng.normal(size=(25, n)), rng.normal(size=(25, m))
        x[3, 0], y[9, -1] = np.nan, np.inf
        one = [wp.dtw_many(a[None], b[None])[0] for a, b in zip(x, y, strict=True)]
        assert np.array_equal(wp.dtw_many(x, y), one, equal_nan=True) and np.isnan(one[3]) and np.isinf(one[9])


def block(x, seed=0):
    n = len(x)
    return pr.Met(pa.table({"_item": np.random.default_rng(seed).permutation(n), "_x": pa.array(list(x)), "_same": [True] * n, "_side": [False] * n}))


def test_likely_pairs_are_looked_at_first(monkeypatch):
    """Of traces that are near few others, connecting looks at a small part of the pairs, and connects what all near pairs do."""
    rng = np.random.default_rng(8)
    x = 0.1 * rng.permutation(400)[:, None] + 0.02 * rng.normal(size=(400, 8))
    x[x[:, 0] > 30] += 5.0
    looked, apart = [], wp._apart
    monkeypatch.setattr(wp, "_apart", lambda a, b, each=False: looked.append(len(a)) or apart(a, b, each))
    i, j = np.triu_indices(400, 1)
    every = wp.dtw_many(x[i], x[j])
    root, want = np.arange(400), np.arange(400)
    a, b, dist = wp._links(block(x), 1.2, root)
    for u, v in zip(i[every <= 1.2], j[every <= 1.2], strict=True):
        want[want == max(want[u], want[v])] = min(want[u], want[v])
    assert len(set(want)) > 1 and np.array_equal(root, want) and len(a) == 400 - len(set(want)) and (dist <= 1.2).all()
    assert np.array_equal(dist, wp.dtw_many(x[a], x[b]))
    assert sum(looked) < 0.5 * len(i)


def test_items_that_come_twice_are_no_pair():
    x = np.zeros((2, 3))
    met = pr.Met(pa.table({"_item": [7, 7], "_x": pa.array(list(x)), "_same": [True] * 2, "_side": [False] * 2}))
    assert len(wp._links(met, 1.0, np.arange(2))[0]) == 0


def test_copies_are_measured_once(monkeypatch):
    """Parts that are far from each other meet by one of their equal traces; distances of copies are those of the first."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 300)]
    looked, measured = [], wp._measured
    monkeypatch.setattr(wp, "_measured", lambda x, y, i, *more: looked.append(len(i)) or measured(x, y, i, *more))
    root = np.arange(300)
    a, b, dist = wp._links(block(x), 1e-3, root)
    assert len(a) == 294 and len(set(root)) == 6 and not dist.any() and (x[a] == x[b]).all() and sum(looked) <= 2 * 15
    looked.clear()
    on = rng.random((300, 300)) < 0.5
    got = wp._warped(x, x, on)
    assert sum(looked) <= 36 and np.isinf(got[~on]).all() and np.array_equal(got[on], measured(x, x, *np.nonzero(on)))


def test_equal_traces_meet_others_together(spark, monkeypatch):
    """Where pairs are slow to measure, a few equal traces are in one block, and measured once for each block that they meet; many are in several blocks."""
    monkeypatch.setattr(pr, "SMALL", 48)
    rows = [(i, "g", [float(i % 40), 1.0]) for i in range(240)] + [(1000 + i, "g", [-1.0, -1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)

    def found(met):
        if met.same:
            own = {tuple(v) for v in met.x.to_pylist()}
            yield {"n": pa.array([len(met.items)]), "own": pa.array([len(own - {(-1.0, -1.0)})]), "many": pa.array([sum(v[0] < 0 for v in met.x.to_pylist())])}

    blocks = pr.met_blocks(df, ["g"], "trial", "dff", found, "n long, own long, many long", slow=True).collect()
    assert sum(r["n"] for r in blocks) == 640 and sum(r["own"] for r in blocks) == 40
    assert len(blocks) > 5 and max(r["many"] for r in blocks) < 200
    x = {i: v for i, _, v in rows}
    got = wp.dtw_distances(df, ["g"]).collect()
    assert len({(r["i"], r["j"]) for r in got}) == len(got) == 640 * 639 // 2 and all(r["i"] < r["j"] for r in got)
    i, j = (np.array([x[r[c]] for r in got]) for c in ("i", "j"))
    assert np.array_equal([r["dist"] for r in got], wp.dtw_many(i, j))


def test_tables_begin_with_a_line_of_the_cache():
    for n, m, w in ((64, 64, 512), (5, 9, 512), (7, 3, 31)):
        t = wp._Tables(n, m, w, float)
        assert all(v.ctypes.data % wp.LINE == 0 and v.flags.c_contiguous for v in (t.x, t.y, t.rows, t.steps[0][2]))
        assert (t.x.shape, t.y.shape) == ((n, w), (m, w))


def test_pairs_are_rounded_as_other_columns(spark):
    rng = np.random.default_rng(10)
    values = [*rng.normal(size=2000), *(rng.integers(-(10**7), 10**7, 2000) / 2e6), *(rng.integers(0, 10**9, 500) * 1e-7), *(rng.normal(size=200) * 1e9)]
    values += [0.0, -0.0, -1e-9, 5e-7, 4.9999999e-7, 999999.9999995, 1e6, -1e6, 1e300, float("inf"), -float("inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = df.select(views.r6(F.col("v"), "a"), views.r6_pairs(F.col("v"), "b")).collect()
    assert [repr(r["a"]) for r in got] == [repr(r["b"]) for r in got]
