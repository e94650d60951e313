"""Linkage by chains against the plain agglomeration; runs of labels against voxels."""

import random
import time

import numpy as np
import pytest

from axonlake.operators import boxes as bx
from axonlake.operators import kernels as kn


def plain_linkage(d, method):
    """Heights and clusters, by the smallest distance of all at each step."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    groups, out = [{i} for i in range(n)], []
    while len(groups) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        h, si, sj, s = d[i, j], len(groups[i]), len(groups[j]), np.array([len(g) for g in groups])
        row = (si * d[i] + sj * d[j]) / (si + sj) if method == "average" else np.sqrt(np.maximum(((si + s) * d[i] ** 2 + (sj + s) * d[j] ** 2 - s * h**2) / (si + sj + s), 0))
        groups[i] = groups[i] | groups[j]
        out.append((h, frozenset(groups[i])))
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d = np.delete(np.delete(d, j, 0), j, 1)
        del groups[j]
    return out


@pytest.mark.parametrize("method", ["average", "ward"])
@pytest.mark.parametrize("seed", range(4))
def test_linkage(method, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(int(rng.integers(2, 40)), 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    z, want = kn.linkage(d, method), plain_linkage(d, method)
    assert np.allclose(z[:, 2], [h for h, _ in want])
    assert [frozenset(m) for m in kn.members(z, len(x))[len(x) :]] == [g for _, g in want] and z[:, 3].tolist() == [len(g) for _, g in want]


def test_linkage_of_ties_few_and_many():
    z = kn.linkage(np.ones((5, 5)), "average")
    assert np.allclose(z[:, 2], 1) and sorted(kn.members(z, 5)[-1]) == list(range(5))
    assert kn.linkage(np.zeros((1, 1)), "ward").shape == (0, 4) and kn.linkage(np.zeros((3, 3)), "ward")[-1, 3] == 3
    x = np.random.default_rng(0).normal(size=(2000, 8))
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    at = time.perf_counter()
    z = kn.linkage(d, "ward")
    assert time.perf_counter() - at < 15 and z[-1, 3] == 2000 and (np.diff(z[:, 2]) >= 0).all()


def test_runs_equal_voxels(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        lo = [rnd.randrange(12) for _ in range(3)]
        hi = [a + rnd.randrange(-1, 7) for a in lo]
        rows.append((rnd.randrange(3), i % 25, *[v for p in zip(lo, hi, strict=True) for v in p]))
    rows += [rows[5], (0, 99, 0, 100_000, 3, 4, 3, 4), (0, 98, 500, 600, 3, 4, 3, 4)]
    df = spark.createDataFrame(rows, "t long, neuron long, x_lo long, x_hi long, y_lo long, y_hi long, z_lo long, z_hi long")
    runs = bx.label_runs(df)
    got = sorted(map(tuple, bx.runs_expanded(runs).select("t", "x", "y", "z", "label").collect()))
    assert got == sorted(map(tuple, bx.voxels(df).select("t", "x", "y", "z", "label").collect()))
    lines = {}
    for r in sorted(map(tuple, runs.select("t", "z", "y", "x_from", "x_to", "label").collect())):
        before = lines.get(r[:3])
        assert before is None or before[1] < r[3] or (before[1] == r[3] and before[2] != r[5])  # no two runs could be one
        lines[r[:3]] = r[3:]
    assert runs.where("t = 0 AND z = 3 AND y = 3").count() < 60  # a box of 100,000 voxels is a run
    assert bx.label_runs(df.limit(0)).collect() == []
