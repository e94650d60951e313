"""Blocked products of pairs of units against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.operators import gram


def table(spark, seed, units=9, times=60):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        x = np.cumsum(rng.normal(size=times)) + 5 * u
        if u == 3:
            x[:] = 2.0  # no spread
        for t in range(times):
            if rng.uniform() < 0.8 and not (u == 5 and t > 9) and not (u == 6 and t < 40):
                rows.append((f"u{u}", t - 20, None if rng.uniform() < 0.05 else float(x[t]), f"g{t % 2}"))
    rows += [("one", 100, 1.0, "g0"), (None, 1, 2.0, "g0"), ("u0", None, 3.0, "g0")]
    return rows, spark.createDataFrame(rows, "unit string, t long, v double, a string")


@pytest.mark.parametrize("units,slab", [(64, 4096), (2, 7), (3, 1)])
def test_covariances(spark, units, slab):
    rows, df = table(spark, units)
    got = {(r["a"], r["b"]): (r["cov"], r["corr"]) for r in gram.covariances(df.withColumnRenamed("a", "g"), "unit", ["g", "t"], units=units, slab=slab).collect()}
    x = {}
    for u, t, v, g in rows:
        if u is not None and t is not None and v is not None:
            x.setdefault(u, {})[g, t] = v
    seen = 0
    for a in x:
        for b in x:
            both = sorted(set(x[a]) & set(x[b]))
            if not both:
                assert (a, b) not in got
                continue
            p, q = np.array([x[a][k] for k in both]), np.array([x[b][k] for k in both])
            cov, corr = got[a, b]
            seen += 1
            if len(both) == 1:
                assert cov is None
                continue
            assert cov == pytest.approx(np.cov(p, q)[0, 1], abs=1e-9)
            assert corr is None if p.std() < 1e-9 or q.std() < 1e-9 else corr == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-9)
    assert seen == len(got) >= 80 and ("u5", "u6") not in got
    assert gram.covariances(df.limit(0), "unit", ["t"]).collect() == []


@pytest.mark.parametrize("units,slab,lag", [(64, 4096, 3), (2, 7, 5), (3, 4, 4), (64, 1, 0)])
def test_cross_correlation(spark, units, slab, lag):
    rows, df = table(spark, lag)
    got = {(r["a"], r["unit_a"], r["b"]): (r["corr"], r["lag"]) for r in gram.cross_correlation_peaks(df.withColumnRenamed("a", "g"), "unit", ["g"], lag, units=units, slab=slab).withColumnRenamed("a", "unit_a").withColumnRenamed("g", "a").collect()}
    x = {}
    for u, t, v, g in rows:
        if u is not None and t is not None and v is not None:
            x.setdefault((g, u), {})[t] = v
    z = {}
    for k, s in x.items():
        m = np.mean(list(s.values()))
        z[k] = {t: (v - m) / max(m, 1) for t, v in s.items()}
    want = {}
    for g, a in z:
        for h, b in z:
            if g == h and a <= b:
                sums = [(d, [z[g, a][t] * z[g, b][t - d] for t in z[g, a] if t - d in z[g, b]]) for d in range(-lag, lag + 1)]
                sums = [(-round(abs(sum(c)), 9), d, sum(c)) for d, c in sums if c]
                if sums:
                    want[g, a, b] = min(sums)[2], min(sums)[1]
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-8) and got[k][1] == want[k][1] for k in want)
    assert gram.cross_correlation_peaks(df.limit(0), "unit", [], lag).collect() == []


def test_rows_don_t_grow_with_lags(spark, monkeypatch):
    """Each sample is dealt out once for each block and side, whatever the lags; slabs' borders alone add some."""
    df = spark.range(40 * 100).select((F.col("id") % 40).alias("unit"), (F.col("id") / 40).cast("long").alias("t"), F.rand(1).alias("v"))
    dealt = []
    sides = gram._sides

    def counted(*a):
        out = sides(*a)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(gram, "_sides", counted)
    for lag in (1, 20):
        assert gram.cross_correlation_peaks(df, "unit", [], lag, units=10).count() == 40 * 41 // 2
    assert dealt[0] <= 4000 * 5 + 4000 and dealt[1] <= 1.3 * dealt[0]  # all pairs, times and lags are 3.4 million
