"""Batched robust fits against a plain damped least squares of one series, with its steps counted out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.operators import fits as ft


def _exp(t, p):
    e = np.exp(-p[1] * t)
    return p[0] * e + p[2], np.stack([e, -p[0] * t * e, np.ones_like(t)], axis=1)


def _line(t, p):
    return p[0] * t + p[1], np.stack([t, np.ones_like(t)], axis=1)


def _double(t, p):
    e, f = np.exp(-p[1] * t), np.exp(-p[3] * t)
    return p[0] * e + p[2] * f + p[4], np.stack([e, -p[0] * t * e, f, -p[2] * t * f, np.ones_like(t)], axis=1)


#: Model, start from (smallest, largest, mean) value, rates that stay positive.
_SHAPES = {
    "exp": (_exp, lambda lo, hi, mean: [hi, 0.001, lo], (1,)),
    "linear": (_line, lambda lo, hi, mean: [0.0, mean], ()),
    "double_exp": (_double, lambda lo, hi, mean: [hi * 0.5, 0.01, hi * 0.5, 0.001, lo], (1, 3)),
}
LEAST_RATE = 1e-9


def robust_fit(t: np.ndarray, y: np.ndarray, model: str, steps: int = 10_000) -> np.ndarray | None:
    """Levenberg-Marquardt for the soft L1 loss 2 (sqrt(1 + r^2) - 1), rates kept positive by projection; None if it diverges."""
    f, start, rates = _SHAPES[model]
    p = np.array(start(y.min(), y.max(), y.mean()), float)

    def loss(q):
        with np.errstate(over="ignore", invalid="ignore"):
            r = f(t, q)[0] - y
            return (2 * (np.sqrt(1 + r * r) - 1)).sum()

    now, damp = loss(p), 1e-3
    if not np.isfinite(now):
        return None
    for _ in range(steps):
        v, jac = f(t, p)
        r = v - y
        w = 1 / np.sqrt(1 + r * r)
        g, h = jac.T @ (w * r), (jac * w[:, None]).T @ jac
        scale = np.maximum(np.diag(h), 1e-12)
        moved = False
        while damp < 1e12:
            try:
                q = p - np.linalg.solve(h + damp * np.diag(scale), g)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            for k in rates:
                q[k] = min(max(q[k], LEAST_RATE), ft.MOST_RATE)
            new = loss(q)
            if np.isfinite(new) and new < now:
                moved, gain = True, now - new
                p, now, damp = q, new, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not moved or gain <= 1e-15 * max(now, 1e-10):
            break
    return p


def loss(t, y, f0):
    return (2 * (np.sqrt(1 + (f0 - y) ** 2) - 1)).sum()


def series(rng, kind):
    n = int(rng.integers(8, 250))
    x = np.arange(float(n)) + rng.integers(0, 50)
    if kind == "exp":
        y = 50 * np.exp(-0.02 * x) + 100 + rng.normal(0, 0.2, n)
    elif kind == "linear":
        y = 3 * x + 20 + rng.normal(0, 0.5, n)
    elif kind == "double":
        y = 40 * np.exp(-0.1 * x) + 80 * np.exp(-0.008 * x) + 50 + rng.normal(0, 0.1, n)
    else:
        y = rng.exponential(40, n)
    y[::37] += 30
    return x, y


@pytest.mark.parametrize("kind", ["exp", "linear", "double", "noise"])
def test_no_worse_than_a_fit_of_its_own(kind):
    """For each model the loss is that of a converged fit or less; where that fit is well determined, R squared agrees to six decimals."""
    rng = np.random.default_rng(len(kind))
    for _ in range(6):
        x, y = series(rng, kind)
        tau, span = (x - x[0])[None] / np.ptp(x), np.ptp(x)
        for name in ft.MODELS:
            p = robust_fit(x, y, name, 2000)
            logs = np.log(np.array(ft.STARTS[name])[None] * span) if ft.STARTS[name] else np.zeros((1, 0))
            logs, beta = ft._fit(tau, y[None], np.ones((1, len(x))), logs, np.log([ft.MOST_RATE * len(x)]), np.log([ft.LEAST_RATE * span]))
            f0 = (ft.basis(tau, logs) @ beta[:, :, None])[0, :, 0]
            slow = _SHAPES[name][0](x, p)[0]
            assert loss(x, y, f0) <= loss(x, y, slow) * (1 + 1e-8) + 1e-9
            if name == kind:
                assert abs(ft.r_squared(y, f0) - ft.r_squared(y, slow)) < 1e-6
            # the parameters give the same curve, where they don't cancel
            params = ft._parameters(name, np.exp(logs[0]), beta[0], x[0], span)
            if max(map(abs, params)) < 1e6:
                assert np.allclose(_SHAPES[name][0](x, params)[0], f0, atol=1e-5)


def test_batches_change_nothing():
    rng = np.random.default_rng(5)
    many = [(x, y, x) for kind in ("exp", "linear", "double", "noise") * 6 for x, y in [series(rng, kind)]]
    many += [(np.arange(3.0), np.array([1.0, np.nan, 3.0]), np.arange(5.0)), (np.arange(0.0), np.arange(0.0), np.arange(2.0)), (np.arange(4.0), np.full(4, 7.0), np.arange(4.0)), (np.full(5, 2.0), np.arange(5.0), np.arange(3.0))]
    together, alone = ft.fit_many(many), [ft.fit_f0(*s) for s in many]
    for (f, name, r2, _), (g, other, s2, _) in zip(together, alone, strict=True):
        assert name == other and np.allclose(f, g, rtol=1e-3, atol=1e-3) and r2 == pytest.approx(s2, abs=1e-6)  # a flat valley has no single end
        assert np.isfinite(f).all()


def test_a_thousand_series_in_seconds():
    import time

    rng = np.random.default_rng(6)
    many = [(x, y, x) for _ in range(250) for kind in ("exp", "linear", "double", "noise") for x, y in [series(rng, kind)]]
    at = time.perf_counter()
    got = ft.fit_many(many)
    assert time.perf_counter() - at < 90
    names = [g[1] for g in got]
    assert {"exp", "linear", "double_exp"} <= set(names)


def test_table_of_odd_rows(spark):
    rows = [("a", 1, i, float(i), True) for i in range(20)] + [("a", 2, i, None, True) for i in range(3)] + [("b", 1, 0, 5.0, True), ("b", 2, 4, 1.0, None), ("b", 2, 2, 2.0, False), (None, 1, 1, 3.0, True), (None, 1, 1, 3.0, True)]
    df = spark.createDataFrame(rows, "model string, part int, t int, v double, used boolean")
    got = {(r["key"], r["part"]): r for r in ft.fitted_baselines(df.withColumnRenamed("model", "key"), ["key", "part"], used="used").collect()}
    assert got["a", 1]["model"] == "linear" and got["a", 1]["r2"] == pytest.approx(1) and np.allclose(got["a", 1]["f0"], range(20), atol=1e-6)
    assert (got["a", 2]["model"], got["a", 2]["f0"]) == ("constant", [0.0] * 3) and got["b", 1]["f0"] == [5.0]
    assert got["b", 2]["t"] == [2, 4] and got["b", 2]["f0"] == [0.0, 0.0] and len(got) == 5
    assert ft.fitted_baselines(df.limit(0), ["part"]).collect() == []


def test_series_are_dealt_out_under_a_constant_key(spark):
    """Few bytes, a constant among the keys: the fits still go to all tasks alike, not to the one that their bytes would fill."""
    df = spark.range(40 * 12).select((F.col("id") % 40).alias("worm"), F.lit("n").alias("neuron"), F.floor(F.col("id") / 40).alias("t"), F.rand(1).alias("v"))
    got = ft.fitted_baselines(df, ["worm", "neuron"]).select("worm", F.spark_partition_id().alias("task")).collect()
    assert len({r["worm"] for r in got}) == len(got) == 40 and len({r["task"] for r in got}) > 2


def test_slopes_are_those_of_the_basis():
    """What a rate doesn't move is left out, and the rest is what differences of whole bases give, bit for bit; rates near zero, near each other and apart."""
    rng = np.random.default_rng(7)
    tau = np.sort(rng.random((60, 30)), axis=1)
    for m in (1, 2):
        logs = rng.uniform(-12, 3, (60, m))
        logs[20:40] = logs[20:40, :1] + 1e-5 * rng.normal(size=(20, m))
        phi, beta, d = ft.basis(tau, logs), rng.normal(size=(60, m + 1)), 1e-4
        want = [(((ft.basis(tau, logs + e) - ft.basis(tau, logs - e)) / (2 * d)) @ beta[:, :, None])[:, :, 0] for e in d * np.eye(m)]
        assert np.array_equal(ft._slopes(tau, logs, phi, beta, d), np.stack(want, axis=2))
