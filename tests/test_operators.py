"""Worked examples and properties of the recording operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from axonlake.functions import names as nm
from axonlake.functions import registry as rg
from axonlake.operators import boxes as bx
from axonlake.operators import intervals as iv
from axonlake.operators import kernels as kn
from axonlake.operators import responses as rs
from axonlake.operators import series as sr
from axonlake.operators import trials as tr
from axonlake.sources import tables as st


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def array(*v):
    return F.array(*[F.lit(float(x)) for x in v])


# ---------------------------------------------------------------- intervals


def test_keep_last_then_runs_then_volumes(spark):
    log = spark.createDataFrame(
        [("w1", 0, 1, "All Off"), ("w1", 1, 2, "Buffer"), ("w1", 2, 2, "All Off"), ("w1", 3, 3, "Buffer"), ("w1", 4, 5, "Odor1"), ("w1", 5, 6, "Odor1"), ("w1", 6, 2, "Buffer")], "worm string, row_ord long, counter long, state string"
    )
    last = iv.keep_last(log, ["worm", "counter"], ["row_ord"])
    found = iv.runs(last, ["worm"])
    assert rows(found.select("state", "start", "end")) == [("All Off", 1, 1), ("Buffer", 2, 3), ("Odor1", 5, 6)]
    assert rows(iv.to_volumes(found, 2).select("state", "start", "end")) == [("Buffer", 1, 1), ("Odor1", 2, 3)]
    assert rows(iv.to_volumes(found, 2, last_end=F.lit(10)).select("state", "start", "end")) == [("Buffer", 1, 1), ("Odor1", 2, 5)]


def test_coalesce_across_files(spark):
    r = spark.createDataFrame([("w1", 0, 0, "A", 1, 3), ("w1", 1, 0, "A", 4, 6), ("w1", 1, 1, "B", 7, 9), ("w1", 2, 0, "B", 12, 13)], "worm string, file int, seq int, state string, start long, end long")
    assert rows(iv.coalesced(r, ["worm"], ["file", "seq"]).select("state", "start", "end")) == [("A", 1, 6), ("B", 12, 13), ("B", 7, 9)]


def test_merge_recordings(spark):
    s = spark.createDataFrame([("w1", 0, 0, 10), ("w1", 1, 10, 25), ("w1_1", 0, 0, 5), ("w1_1", 1, 5, 9), ("w1_2", 0, 0, 4), ("W1", 0, 0, 9)], "sheet string, seq int, start long, end long").withColumn("state", F.lit("x"))
    assert rows(iv.merged_recordings(s).select("start", "end")) == [(0, 10), (10, 25), (25, 30), (30, 34), (34, 38)]


def test_names_and_intervals_exclude_differently(spark):
    s = spark.createDataFrame([("w", 0, "Buffer", 0, 5), ("w", 1, "Odor1", 5, 9), ("w", 2, "Buffer2", 9, 12), ("w", 3, "Odor1", 12, 12)], "worm string, seq int, state string, start long, end long")
    assert rows(iv.stimulus_list(s, ["Buffer"]).select("state")) == [("Buffer2",), ("Odor1",)]
    assert rows(iv.stimulus_or_buffer(s, []).where("kind = 'stimulus'").select("state")) == [("Odor1",)]


def test_interval_join(spark):
    s = spark.createDataFrame([("w", t) for t in (4, 5, 9, 4)], "worm string, t long")
    i = spark.createDataFrame([("w", 0, "A", 0, 5), ("w", 1, "B", 5, 9), ("w", 2, "C", 0, 9), ("w", 3, "D", 3, 3)], "worm string, seq int, state string, start long, end long")
    for bucket in (1, 3, 256):
        assert {(r["t"], r["state"]) for r in iv.interval_join(s, i, bucket).collect()} == {(4, "A"), (5, "B"), (9, "Unknown")}
    # repeated samples each come back, as do those without a recording or a time
    odd = s.unionByName(spark.createDataFrame([(None, 4), ("w", None), ("w", 4)], "worm string, t long"))
    got = [tuple(r) for r in iv.interval_join(odd, i).collect()]
    assert len(got) == 7 and got.count(("w", 4, "A")) == 3 and (None, 4, "Unknown") in got and ("w", None, "Unknown") in got
    nameless = spark.createDataFrame([("w", 0, None, 0, 9)], i.schema)
    assert {r["state"] for r in iv.interval_join(s, nameless).collect()} == {"Unknown"}
    assert iv.interval_join(s.limit(0), i).count() == 0 and iv.interval_join(s, i.limit(0)).count() == 4


def test_missing_states_are_runs(spark):
    log = spark.createDataFrame([("w", i, x) for i, x in enumerate(["A", None, None, "B", None], 1)], "worm string, counter long, state string")
    found = iv.runs(log, ["worm"])
    assert [(r["state"], r["start"], r["end"]) for r in found.orderBy("seq").collect()] == [("A", 1, 1), (None, 2, 3), ("B", 4, 4), (None, 5, 5)]
    first = iv.runs(log.where("counter between 2 and 3"), ["worm"])
    assert [(r["seq"], r["state"], r["start"], r["end"]) for r in first.collect()] == [(1, None, 2, 3)]
    parts = spark.createDataFrame([("w", 0, 1, None, 1, 3), ("w", 1, 1, None, 4, 6), ("w", 1, 2, "B", 7, 9)], "worm string, file int, seq int, state string, start long, end long")
    assert rows(iv.coalesced(parts, ["worm"], ["file", "seq"]).select("state", "start", "end")) == [("B", 7, 9), (None, 1, 6)] or rows(iv.coalesced(parts, ["worm"], ["file", "seq"]).select("state", "start", "end")) == [(None, 1, 6), ("B", 7, 9)]


@settings(max_examples=10, deadline=None)
@given(hs.lists(hs.sampled_from("abc"), min_size=1, max_size=30))
def test_runs_round_trip(spark, states):
    df = spark.createDataFrame([("w", i, s) for i, s in enumerate(states)], "worm string, counter long, state string")
    got = sorted((r["start"], r["end"], r["state"]) for r in iv.runs(df, ["worm"]).collect())
    assert "".join(s * (e - a + 1) for a, e, s in got) == "".join(states)


def test_sub_recordings_and_rebase(spark):
    n = spark.createDataFrame([("w", ["3", "x", "-1", "4"])], "worm string, n_seg array<string>")
    parts = iv.sub_recordings(n)
    assert rows(parts) == [("w", 0, 0, 3), ("w", 1, 3, 7)]
    i = spark.createDataFrame([("w", 0, "A", 2, 5)], "worm string, seq int, state string, start long, end long")
    assert rows(iv.overlap_rebased(i, parts).select("part", "start", "end")) == [(0, 2, 3), (1, 0, 2)]


def test_densify(spark):
    ids = spark.createDataFrame([("w", 0, "AWAL"), ("w", 2, None)], "worm string, digital int, biological string")
    assert rows(iv.densified(ids, "digital", "biological").select("digital", "biological")) == [(0, "AWAL"), (1, "1"), (2, "2")]


def test_permuted_timeline(spark):
    s = spark.createDataFrame([("w", t, float(t)) for t in range(6)], "worm string, t long, v double")
    i = spark.createDataFrame([("w", 0, 4, 6), ("w", 1, 0, 2)], "worm string, ord int, start long, end long")
    assert [r["v"] for r in iv.permuted_timeline(s, i).orderBy("t").collect()] == [4, 5, 0, 1]


# ---------------------------------------------------------------- series


def series(spark, values):
    return spark.createDataFrame([("w", i, v) for i, v in enumerate(values)], "worm string, t long, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_interpolation(spark):
    s = series(spark, [None, 1.0, None, None, 4.0, None])
    assert column(sr.interpolated(s, ["worm"]), "filled") == [1, 1, 2, 3, 4, 4]
    empty = series(spark, [None, None])
    assert column(sr.matrix_filled(empty, ["worm"]), "filled") == [0, 0]
    both = s.where("t < 2").unionByName(empty.withColumn("worm", F.lit("x")))
    assert {r["filled"] for r in sr.matrix_filled(both, ["worm"], compat_frame=True).collect()} == {0}


def test_spikes(spark):
    assert column(sr.spikes_repaired(series(spark, [1.0, 50.0, 3.0, None]), ["worm"]), "repaired") == [1, 2, 3, 3]
    assert column(sr.spikes_repaired(series(spark, [1.0, None]), ["worm"]), "repaired") == [1, None]


def test_isolated(spark):
    s = series(spark, [None, 3.0, None, 4.0, 5.0]).withColumn("alone", sr.isolated(None, ["worm"]))
    assert rows(s.where("alone").select("v")) == [(3.0,)]


def test_delta_f(spark):
    s = spark.createDataFrame([("w", 0, 200.0, 150.0), ("w", 1, 210.0, 150.0)], "worm string, t long, f double, f0 double")
    assert np.allclose(column(sr.delta_f(s, ["worm"], background=102.0), "dff"), [50 / 48, 60 / 48])
    s = s.withColumn("f0", F.lit(102.0))
    assert np.allclose(column(sr.delta_f(s, ["worm"], background=102.0), "dff"), [98e6, 108e6])


def test_mad(spark):
    assert rows(sr.mad_kept(series(spark, [1.0, 2.0, 3.0, 100.0]), ["worm"]).select("v")) == [(1.0,), (2.0,), (3.0,)]
    assert sr.mad_kept(series(spark, [1.0, 1.0, 1.0, 9.0]), ["worm"]).count() == 4


def test_nearest(spark):
    m = spark.createDataFrame([("w", 5), ("w", 0), ("x", 1)], "worm string, t long")
    k = spark.createDataFrame([("w", 3), ("w", 7), ("w", 9)], "worm string, t long")
    assert rows(sr.nearest_in_time(m, k, ["worm"])) == [("w", 0, 3), ("w", 5, 3), ("x", 1, None)]


def test_long_series_take_time_in_proportion(spark):
    """200,000 samples in one series: seconds, as the look-ups carry on from row to row."""
    import time

    n = 200_000
    s = spark.range(n).select(F.lit("w").alias("worm"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    began = time.perf_counter()
    assert sr.interpolated(s, ["worm"]).where("filled = t OR t > 199000").count() == n
    assert sr.nearest_in_time(s.where("v is null"), s.where("v is not null"), ["worm"]).where("abs(nearest_t - t) > 1000").count() == 0
    assert time.perf_counter() - began < 60


def test_weighted_average_draws(spark):
    s = series(spark, [1.0, 1.0, 0.0, 0.0, 0.0, 5.0, 5.0])
    plain = column(sr.region_weighted_average(s, ["worm"], 2, 5, 2, noise=0.0), "repaired")
    assert plain == [1.0, 1.0, 1.0, 3.0, 5.0, 5.0, 5.0]
    drawn = column(sr.region_weighted_average(s, ["worm"], 2, 5, 2, seed=3), "repaired")
    assert drawn == column(sr.region_weighted_average(s.repartition(3), ["worm"], 2, 5, 2, seed=3), "repaired") != plain
    assert all(abs(a - b) < 0.4 * 6 for a, b in zip(drawn, plain, strict=True)) and drawn[:2] == plain[:2]


def test_region_draws_are_seeded(spark):
    s = series(spark, [float(i % 3) for i in range(30)])
    a, b, c = (column(sr.region_normal(s.repartition(k), ["worm"], 10, 15, 5, seed=k % 2), "repaired") for k in (1, 3, 2))
    assert a == b and a != c and a[:10] == c[:10]


# ---------------------------------------------------------------- trials


def test_downsampling(spark):
    x = array(*range(1, 16))
    r = one(spark, a=tr.block_means(x, 5), b=tr.ends_preserved(x, 5), c=tr.ends_weighted(x, 5), d=tr.block_means(array(1, 2), 5))
    assert (r["a"], r["b"], r["c"], r["d"]) == ([3, 8, 13], [1, 8, 15], [1, 8, 15], [1, 2])
    with pytest.raises(ValueError):
        tr.pieces_downsampled(x, x, x, 5, "other")
    p = one(spark, p=tr.pieces_downsampled(array().cast("array<double>"), x, x, 5))["p"]
    assert (p["onset"], p["last"], len(p["dff"])) == (0, 2, 6)


def test_peaks(spark):
    z = [0.0] * 40
    tie, early = list(z), list(z)
    tie[30], tie[35], early[29] = 2, -2, 2
    r = one(spark, tie=tr.signed_peak(array(*tie)), early=tr.signed_peak(array(*early)), short=tr.signed_peak(array(1, 2)))
    assert (r["tie"], r["early"], r["short"]) == (-2, 0, 0)


def test_baseline_correction(spark):
    b = one(spark, b=tr.baseline_corrected(array(*range(1, 9)), F.lit(5)))["b"]
    assert b["factor"] == 3 and b["corrected"] == [float(v) for v in range(-2, 6)]
    assert one(spark, b=tr.baseline_corrected(array(1, 2), F.lit(0)))["b"]["factor"] == 0


def test_segments_clamp(spark):
    s = one(spark, s=tr.segment(array(*range(20)), F.lit(2), F.lit(14)))["s"]
    assert s["dff"] == [float(v) for v in [0, 1, *range(2, 12), *range(14, 20)]] and (s["onset"], s["offset"]) == (2, 12)


@pytest.mark.parametrize("group", [None, 2])
def test_zscores(spark, group):
    t = spark.createDataFrame([("w", "n", 0, [1.0, 2.0, 3.0]), ("w", "n", 1, [4.0, 5.0, 6.0]), ("w", "c", 0, [2.0, 2.0])], "worm string, neuron string, segment_index int, dff array<double>")
    got = {(r["neuron"], r["segment_index"]): r for r in tr.zscored(t, group).collect()}
    assert got["n", 0]["mu"] == 3.5 and abs(got["n", 0]["sd"] - 3.5**0.5) < 1e-9 and got["c", 0]["sd"] == 1 and got["c", 0]["z"] == [0, 0]
    z = np.array(got["n", 0]["z"] + got["n", 1]["z"])
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=1) - 1) < 1e-12


# ---------------------------------------------------------------- responses


def test_sides(spark):
    m = spark.createDataFrame([("AWAL", 2.0), ("AWAR", 4.0), ("ASHL", 6.0), ("AVA", 1.0)], "neuron string, v double").withColumn("stimulus", F.lit("s"))
    assert rows(rs.sides_averaged(m, ["stimulus"]).select("neuron", "v")) == [("ASHL", 6.0), ("AVA", 1.0), ("AWA", 3.0)]


def trial_rows(spark, data):
    return spark.createDataFrame([(n, s, "w1", "d", i, i, v) for i, (n, s, v) in enumerate(data)], "neuron string, stimulus string, worm string, date string, segment_index int, trial long, dff array<double>")


def test_sides_merge(spark):
    t = trial_rows(spark, [("AWAL", "a", [1.0, 2.0, 3.0]), ("AWAL", "a", [9.0]), ("AWAR", "a", [3.0, 4.0]), ("AWAL", "b", [5.0]), ("ASEL", "a", [7.0]), ("ASER", "a", [8.0])])
    got = rows(rs.sides_merged(t).select("neuron", "stimulus", "dff"))
    assert got == [("ASEL", "a", [7.0]), ("ASER", "a", [8.0]), ("AWA", "a", [2.0, 3.0]), ("AWA", "b", [5.0])]
    assert not [r for r in rows(rs.sides_merged(t, compat=True)) if r[0].startswith("ASE")]


def test_mirror(spark):
    m = spark.createDataFrame([("AWAL", "a", None), ("AWAR", "a", 2.0), ("AVA", "a", None), ("ASHL", "a", 0.0), ("ASHR", "a", 5.0)], "neuron string, stimulus string, v double")
    got = {r["neuron"]: r["filled"] for r in rs.mirror_filled(m).collect()}
    assert got == {"AWAL": 2, "AWAR": 2, "AVA": 0, "ASHL": 0, "ASHR": 5}
    assert {r["neuron"]: r["filled"] for r in rs.mirror_filled(m, zero_is_missing=True).collect()}["ASHL"] == 5


def test_cross_correlation_sign(spark):
    x = [0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    long = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)] + [("b", t, x[t - 2]) for t in range(8)], "unit string, t long, v double")
    got = {(r["a"], r["b"]): r["lag"] for r in rs.cross_correlation_peaks(long, "unit", [], 5).collect()}
    assert got["a", "a"] == 0 and abs(got["a", "b"]) == 2


# ---------------------------------------------------------------- kernels


def dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_dtw(spark):
    assert kn.dtw_many(np.array([[1.0, 3, 4, 9]]), np.array([[1.0, 4, 5]]))[0] == 5
    rng = np.random.default_rng(0)
    data = [("n", i, rng.normal(size=rng.integers(3, 9)).tolist()) for i in range(6)]
    t = spark.createDataFrame(data, "neuron string, trial long, dff array<double>")
    for r in kn.dtw_distances(t, ["neuron"]).collect():
        assert abs(r["dist"] - dtw(data[r["i"]][2], data[r["j"]][2])) < 1e-9
    assert one(spark, d=kn.dtw_in_sql(array(1, 3, 4, 9), array(1, 4, 5)))["d"] == 5


def test_density(spark):
    items = spark.createDataFrame([("n", i) for i in range(3)], "neuron string, item long")
    edges = spark.createDataFrame([("n", 0, 1, 0.5), ("n", 0, 2, 10.0), ("n", 1, 2, 9.5)], "neuron string, i long, j long, dist double")
    assert rows(kn.cluster_trials(edges, items, ["neuron"], 1.0, 2).select("item", "label")) == [(0, 0), (1, 0), (2, -1)]
    assert rows(kn.density_noise(edges, items, ["neuron"], 1.0, 2).where("is_noise").select("item")) == [(2,)]
    assert rows(kn.k_distance(edges, ["neuron"], 5).select("i", "k_dist")) == [(0, 10.0), (1, 9.5), (2, 10.0)]


def test_linkage_and_order():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    d = np.abs(x - x.T)
    z = kn.linkage(d, "average")
    assert np.allclose(z[:2, 2], [0.1, 0.2]) and z[-1, 3] == 5
    assert list(kn.cut(z, 5, 1.0)) == [0, 0, 1, 1, 2]
    order = kn.optimal_order(z, d)
    cost = sum(d[a, b] for a, b in zip(order, order[1:], strict=False))
    assert order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0]) and abs(cost - 9) < 1e-9
    w = kn.linkage(d, "ward")
    assert np.isclose(w[0, 2], 0.1) and np.isclose(w[1, 2], 0.2)


@pytest.mark.parametrize("n", [3, 5, 7])
def test_leaf_order_by_trial(n):
    """The best of all orders that flips of the tree allow."""
    rng = np.random.default_rng(n)
    for _ in range(8):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        z = kn.linkage(d, "average")

        def orders(node, z=z):
            if node < n:
                return [[node]]
            a, b = z[node - n, :2].astype(int)
            return [p + q for u in orders(a) for v in orders(b) for p, q in ((u, v), (v, u))]

        def cost(o, d=d):
            return sum(d[a, b] for a, b in zip(o, o[1:], strict=False))

        got = kn.optimal_order(z, d)
        assert got in orders(2 * n - 2) and np.isclose(cost(got), min(map(cost, orders(2 * n - 2))))


def test_rows_without_spread_come_last(spark):
    x = np.array([[1.0, 2, 3], [5, 5, 5], [1, 2, 4], [3, 2, 1], [0, 0, 0]])
    for method in ("average", "ward"):
        got = kn.row_order(x, method)
        assert got[3:] == [1, 4] and sorted(got[:3]) == [0, 2, 3] and abs(got.index(0) - got.index(2)) == 1
    many = np.random.default_rng(1).normal(size=(160, 40))
    assert sorted(kn.row_order(many)) == list(range(160))
    m = spark.createDataFrame([("s", n, t, v, n == "B") for n, row in zip("ABCDE", x, strict=True) for t, v in enumerate(row.tolist())], "stimulus string, neuron string, t int, v double, gone boolean")
    names = [r["neuron"] for r in kn.ordered_rows(m, "neuron", "t", "v", ["stimulus"], "ward", "gone").orderBy("place").collect()]
    assert names[3:] == ["E", "B"]


def test_recordings_to_trials(spark):
    """A known baseline in two parts, with a response after each stimulus: the fits find the one and leave the other."""
    from axonlake.operators import recordings as rc

    n, cut = 200, 120

    def f0(t):
        return 300 + 80 * np.exp(-0.01 * t) if t < cut else 250 + 0.2 * (t - cut)

    starts = [40, 80, 150]
    data = [("w", "AVA", t, float(f0(t)) + (60.0 if any(a <= t < a + 10 for a in starts) else 0.0)) for t in range(n)]
    samples = spark.createDataFrame(data, "worm string, neuron string, t long, v double")
    stimuli = spark.createDataFrame([("w", i, "odor", a, a + 10) for i, a in enumerate(starts)], "worm string, seq long, state string, start long, end long")
    parts = iv.sub_recordings(spark.createDataFrame([("w", [str(cut), str(n - cut)])], "worm string, n_seg array<string>"))
    placed = rc.baseline_samples(samples, stimuli, parts)
    used = {r["t"] for r in placed.where("used").collect()}
    assert used == {*range(20, 37), *range(75, 79), *range(100, 120), *range(130, 147), *range(180, 200)}
    change, fits = rc.relative_change(placed, background=100.0)
    assert all(abs(r["f0"] - f0(r["t"])) < 2 for r in change.collect()) and fits.count() == 2
    assert kn.fit_quality(fits, ("part",)).where("mean_r2 > 0.9").count() == 2
    got = rc.recording_trials(samples, stimuli, parts, background=100.0).orderBy("segment_index").collect()
    assert [r["start"] for r in got] == starts and all(r["onset"] == 5 and r["offset"] == 15 and len(r["dff"]) == 45 for r in got)
    for r in got:
        top = r["dff"][5:15]
        assert min(top) > 0.15 and max(abs(v) for v in r["dff"][:5] + r["dff"][16:25]) < 0.05
    assert rc.recording_trials(samples, stimuli.limit(0), parts).count() == 0


@pytest.mark.parametrize("model", ["exp", "linear"])
def test_baseline_fit(model):
    t = np.arange(200.0)
    true = 50 * np.exp(-0.02 * t) + 100 if model == "exp" else 3 * t + 20
    y = true + np.random.default_rng(1).normal(0, 0.2, 200)
    y[::37] += 60
    f0, name, r2, _ = kn.fit_f0(t, y, t)
    assert np.abs(f0 - true).max() < 1.5 and r2 > 0.95
    assert name in ((model, "double_exp") if model == "exp" else kn.MODELS)
    assert kn.fit_f0(t[:1], y[:1], t[:3])[1] == "constant" and kn.fit_f0(t[:0], y[:0], t[:3])[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("case", [15, 37])
def test_baseline_fit_runs_to_its_end(case):
    rng, t = np.random.default_rng(3), np.arange(400.0)
    for n in [64] * 60 + [400] * (case + 1):
        x = np.arange(float(n))
        y = rng.uniform(0.2, 3) * np.exp(-rng.uniform(0.005, 0.05) * x) + rng.uniform(0.2, 3) * np.exp(-rng.uniform(0.0002, 0.004) * x) + rng.uniform(0, 2) + rng.normal(0, 0.03, n)
    assert kn.fit_f0(t, y, t)[1] == "double_exp"


def test_principal_components(spark):
    x = np.random.default_rng(3).normal(size=(40, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "trial long, dff array<double>")
    scores, share, v = kn.principal_components(df, 5, 4, ["trial"])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(share, (s**2 / (s**2).sum())[:4])
    got = {(r["trial"], r["component"]): r["score"] for r in scores.collect()}
    assert all(abs(abs(got[i, c]) - abs(u[i, c] * s[c])) < 1e-8 for i in range(40) for c in range(4))


def test_demixing_rebuilds_marginals():
    rng = np.random.default_rng(4)
    t, s = rng.normal(size=(1, 1, 20)), rng.normal(size=(1, 6, 1))
    x = rng.normal(size=(9, 1, 1)) * t + rng.normal(size=(9, 1, 1)) * s
    x = x - x.mean(axis=(1, 2), keepdims=True)
    mt = np.broadcast_to(x.mean(axis=1, keepdims=True), x.shape).reshape(9, -1)
    dec, enc = kn.demixed_components(mt, x.reshape(9, -1), 1)
    assert np.abs(mt - enc @ (dec.T @ x.reshape(9, -1))).max() < 1e-3


def test_spline():
    x, y = np.array([0.0, 1, 2, 5]), np.array([1.0, 3, 2, 4])
    assert np.allclose(kn.natural_spline(x, y, x), y) and np.allclose(kn.natural_spline(x, 2 * x + 1, np.array([3.0])), 7)


def test_imputation(spark):
    b = spark.createDataFrame([(0, n, float(n), 0.0, 0.0) for n in range(4)] + [(1, 0, None, None, None), (1, 1, 2.0, 1.0, 0.0), (1, 2, 3.0, 1.0, 0.0), (1, 3, None, None, None), (1, 9, None, None, None)], "t long, neuron long, x double, y double, z double")
    got = {r["neuron"]: (r["x"], r["y"], r["n"]) for r in kn.imputed_positions(b, 0).collect()}
    assert got == {0: (1.0, 1.0, 2), 3: (4.0, 1.0, 2), 9: (None, None, 0)}


# ---------------------------------------------------------------- names, registry, sources


def test_concentrations(spark):
    for text, want, group in (("NaCl 100mM", (2, 100.0), "NaCl"), ("EGCG 1uM", (1, 1.0), "EGCG"), ("Diacetyl E6", (3, -6.0), "Diacetyl"), ("X 5%", (0, 5.0), "X"), ("plain", None, "plain"), ("", None, "")):
        r = one(spark, c=nm.concentration(F.lit(text)), s=nm.split_name(F.lit(text)))
        assert (tuple(r["c"]) if r["c"] else None) == want == rg.concentration(text)
        assert r["s"]["group"] == group == rg.split_name(text)[0] and r["s"]["variant"] == rg.split_name(text)[1]


def test_units_and_bits(spark):
    r = one(spark, a=nm.dilution_to_um(F.lit(180.16), F.lit(100.0), F.lit(1000.0)), b=nm.mass_ratio_to_um(F.lit(342.3), F.lit(50.0), F.lit(1000.0)), c=nm.bits(F.lit(6), 4), d=nm.hue_colour(F.lit(0.0)), e=nm.key_number(F.lit("a")))
    assert abs(r["a"] - 555.06) < 0.01 and abs(r["b"] - 146.07) < 0.01 and r["c"] == [0, 1, 1, 0] and r["d"] == "#ea6969" and r["e"] == 10


def test_registry():
    known = {"c1_0": "NaCl 1mM", "c1_2": "NaCl 3mM", "d4_0": "Other 1uM"}
    got, names = rg.assign_ids({"3": "NaCl 2mM", "4": "NaCl 1mM", "5": "New E3", "6": "Third 1%"}, known, {"6": "D"})
    assert got == {"3": "c1_1", "4": "c1_0", "5": "c2_0", "6": "d5_0"} and list(names)[:3] == ["c1_0", "c1_1", "c1_2"]
    with pytest.raises(rg.ConfigError):
        rg.assign_ids({"1": "x"}, {"bad": "y"})


def test_state_map(spark):
    config = rg.generate_config({"1": "control", "2": "Buffer", "3": "NaCl 1mM", "4": "Diacetyl E3 d"}, {})
    assert config["stimuli"] == {"3": "c1_0", "4": "d1_0"}
    m = config["state_mapping"]
    assert m["[0, 1, 1, 1, 0, 0, 0, 0]"] == "c1_0" and m["[0, 1, 1, 0, 1, 0, 0, 0]"] == "d1_0" and m["[1, 1, 1, 1, 0, 0, 0, 0]"] == "Buffer" and m["[0, 0, 0, 0, 0, 0, 0, 0]"] == "All Off"
    names = spark.createDataFrame([("10", "c1_0"), ("01", "d1_0")], "pattern string, name string")
    assert {r["state"]: r["name"] for r in rg.state_map_frame(spark, 2, names).collect()} == m
    with pytest.raises(rg.ConfigError):
        rg.state_map({"99": "x"}, {"99": "c1_0"}, five_bit=False)


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("w1", 0, [1.0]), ("w2", 0, [2.0])], "worm string, neuron_idx int, f array<double>")
    path = str(tmp_path / "traces")
    st.write_by_worm(t, path)
    assert rows(st.read_intensity(spark, path, ("w1",)).select("worm")) == [("w2",)]
    st.replace_partitions(t.where("worm = 'w2'").withColumn("f", F.array(F.lit(9.0))), path)
    assert rows(spark.read.parquet(path).select("worm", "f")) == [("w1", [1.0]), ("w2", [9.0])]
    assert rows(st.read_single_trial(spark, path).select("id")) == [("0",), ("0",)]
    st.write_by_worm(t.limit(0), str(tmp_path / "none"))
    (tmp_path / "m.csv").write_text("frame_number,x\n17,a\n18,b\n")
    assert st.first_frame(spark, str(tmp_path / "m.csv")) == 17
    (tmp_path / "c.json").write_text('{\n "state_mapping": {"[0, 1]": "Odor", "[1, 1]": "Buffer"}, "slice_number": 20}')
    assert rows(st.read_config(spark, str(tmp_path / "c.json"))) == [("0,1", "Odor"), ("1,1", "Buffer")]
    log = spark.createDataFrame([("w1", None, 0, 1, [0, 1]), ("w1", None, 1, 2, [0, 0])], st.LOG)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    named = st.unknown_filled(st.read_log(spark, str(tmp_path / "log")), st.read_config(spark, str(tmp_path / "c.json")))
    assert rows(named.select("counter", "state_name")) == [(1, "Odor"), (2, "Unknown")]


def test_manifests(spark):
    f = spark.createDataFrame([("w1_a", n) for n in range(39)], "folder string, frame_no long")
    assert rows(st.complete_volumes(f, ["folder"])) == [("w1_a", 0)]
    assert [r["frame_no"] for r in st.frame_paths(spark.createDataFrame([(1,)], "volume long"), 20, 0, 2, True).orderBy("place").collect()] == [22, 21, 20]
    folders = spark.createDataFrame([("w1_x",), ("W1_y",), ("z",)], "folder string")
    assert rows(st.classified_folders(folders).select("worm", "kind")) == [("w1", "ex"), ("w1", "ref")]
    v = spark.createDataFrame([("w1_x", 0), ("w1_x", 1), ("W1_y", 3), ("W1_y", 4)], "folder string, volume long")
    assert rows(st.conversion_manifest(folders, v).select("folder", "volume")) == [("W1_y", 3), ("w1_x", 0), ("w1_x", 1)]
    assert rows(st.trial_records(spark.createDataFrame([("n", "s", [[1.0], [2.0]])], "neuron string, stimulus string, trials array<array<double>>"), date=F.lit("20250101")).select("segment_index", "dff", "worm")) == [(0, [1.0], "w1"), (1, [2.0], "w1")]


def test_voxels(spark):
    b = spark.createDataFrame([(0, 1, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (0, 2, 1.5, 1.0, 1.0, 1.0, 2.0, 2.0), (0, 3, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "t long, neuron long, x double, y double, z double, w double, h double, d double")
    got = {(r["x"], r["y"], r["z"]): r["label"] for r in bx.voxels(bx.bounds(b, (4, 4, 4))).collect()}
    assert got[0, 0, 0] == 1 and got[1, 1, 1] == 2 and len(got) == 8
    assert bx.bounds(b, (1, 1, 1), depth_correction=2).select("z_hi").distinct().first()[0] == 3


def test_live_runs(spark, tmp_path):
    from axonlake.streaming.runs import live_runs

    schema = "worm string, counter long, state string"
    source = tmp_path / "in"
    for k, part in enumerate([[(1, "A"), (2, "A")], [(3, "A"), (4, "B"), (2, "late")], [(5, "C")]]):
        spark.createDataFrame([("w", c, s) for c, s in part], schema).coalesce(1).write.mode("append").parquet(str(source))
        q = live_runs(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("state", "start", "end")) == [("A", 1, 3), ("B", 4, 4)]


def test_arrays(spark, tmp_path):
    import io

    np.save(tmp_path / "f_7.npy", np.arange(6, dtype="uint16").reshape(2, 3))
    files = st.images(spark, str(tmp_path), "*.npy")
    assert files.select("frame_no").first()[0] == 7
    r = st.array_summaries(files).first()
    assert (r["shape"], r["lowest"], r["highest"], r["mean"]) == ([2, 3], 0, 5, 2.5)
    got = np.load(io.BytesIO(st.thresholded_arrays(files, 3).first()["content"]))["image"]
    assert got.tolist() == [[0, 0, 0], [3, 4, 5]] and got.dtype == np.uint16
