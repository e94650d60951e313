"""Demixed components against the same decomposition of a numpy tensor."""

import numpy as np

from axonlake.operators import demixing as dm
from axonlake.operators import responses as rs


def plain(x, k):
    """x (neurons, stimuli, times), by pseudo-inverse and singular vectors: decoders, projections, explained shares."""
    x = x - x.mean(axis=(1, 2), keepdims=True)
    t, s = x.mean(axis=1, keepdims=True), x.mean(axis=2, keepdims=True)
    flat, out = x.reshape(len(x), -1), {}
    for name, m in (("m_t", np.broadcast_to(t, x.shape)), ("m_s", np.broadcast_to(s, x.shape)), ("m_st", x - t - s)):
        c = m.reshape(len(x), -1) @ np.linalg.pinv(flat)
        u = np.linalg.svd(c @ flat)[0][:, :k]
        d = c.T @ u
        z = d.T @ flat
        out[name] = d, z.reshape(k, *x.shape[1:]), (z**2).sum(axis=1) / (flat**2).sum()
    return out


def table(spark, x, extra=()):
    rows = [(f"n{n}", f"s{s}", t, float(v)) for (n, s, t), v in np.ndenumerate(x)]
    return spark.createDataFrame([*rows, *extra], "neuron string, stimulus string, t int, v double")


def test_components_and_projections(spark):
    rng = np.random.default_rng(0)
    time, stimulus = np.sin(np.arange(25) / 4), rng.normal(size=6)
    x = rng.normal(size=(9, 1, 1)) * time * 3 + rng.normal(size=(9, 1, 1)) * stimulus[None, :, None] * 2 + rng.normal(size=(9, 6, 25)) * 0.5 + 4
    found = dm.demixed(rs.marginals(table(spark, x)), 3)
    want = plain(x, 3)
    z = {m: np.zeros((3, 6, 25)) for m in dm.MARGINALS}
    for r in found.projections.collect():
        z[r["marginal"]][r["component"], int(r["stimulus"][1:]), r["t"]] = r["z"]
    for m in dm.MARGINALS:
        d, p, share = want[m]
        sign = np.sign((found.decoders[m] * d).sum(axis=0))
        assert np.allclose(found.decoders[m], d * sign, atol=1e-5) and np.allclose(z[m], p * sign[:, None, None], atol=1e-5)
        assert np.allclose(found.explained[m], share, atol=1e-7)
    assert found.neurons == [f"n{i}" for i in range(9)]
    assert found.explained["m_t"][0] > 0.3 > found.explained["m_st"][0]


def test_few_neurons_flat_and_empty(spark):
    x = np.random.default_rng(1).normal(size=(2, 3, 4))
    found = dm.demixed(rs.marginals(table(spark, x)), 10)  # more components than neurons
    assert found.decoders["m_t"].shape == (2, 2) and found.projections.count() == 3 * 2 * 12
    flat = dm.demixed(rs.marginals(table(spark, np.ones((3, 2, 2)))), 2)
    assert all(abs(v) < 1e-12 for m in dm.MARGINALS for v in flat.explained[m]) and flat.projections.where("abs(z) > 1e-12").count() == 0
    none = dm.demixed(rs.marginals(table(spark, x).limit(0)), 2)
    assert none.neurons == [] and none.projections.collect() == []
    odd = dm.demixed(rs.marginals(table(spark, x)).unionByName(rs.marginals(table(spark, x)).selectExpr("CAST(NULL AS string) AS neuron", "stimulus", "t", "m_t", "m_s", "m_st")), 1)
    assert odd.neurons == ["n0", "n1"]
