"""Neighbours and missing objects against brute force."""

import numpy as np
import pytest

from axonlake.operators import objects as ob

SCHEMA = "t long, neuron long, x double, y double, z double, w double, q string, rank int"


def brute_nearest(points, k):
    """points: {item: place}."""
    out = []
    for i, p in points.items():
        far = sorted((float(np.sqrt(((p - q) ** 2).sum())), j) for j, q in points.items() if j != i)[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(far)]
    return out


def clouds(rng):
    """Even, clustered, flat, on a line, at one place, with ties on a lattice, one object, and one far away."""
    far = rng.normal(size=(40, 3))
    far[0] = 1e5
    return [
        rng.uniform(0, 50, (60, 3)), np.concatenate([rng.normal(0, 0.01, (50, 3)), rng.uniform(-100, 100, (10, 3))]), rng.uniform(0, 9, (40, 3)) * [1, 1, 0], rng.uniform(0, 9, (40, 3)) * [0, 1, 0],
        np.zeros((12, 3)), np.stack(np.meshgrid(*[range(4)] * 3), -1).reshape(-1, 3).astype(float), np.ones((1, 3)), far,
    ]


@pytest.mark.parametrize("k", [1, 7, 100])
def test_nearest(spark, k):
    frames = clouds(np.random.default_rng(k))
    rows = [(t, i, *map(float, p), 0.0, "", 0) for t, x in enumerate(frames) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["t"], r["neuron"], r["near"], r["rank"]) for r in ob.k_nearest(df, df, ["t"], "neuron", k).collect())
    assert got == sorted((t, *r) for t, x in enumerate(frames) for r in brute_nearest(dict(enumerate(x)), k))
    assert ob.k_nearest(df.limit(0), df.limit(0), ["t"], "neuron", k).collect() == []


def test_nearest_forms_few_pairs(spark):
    """Pairs of all levels together grow with the objects, not with their square; no join is without an equality."""
    n, k = 4_000, 8
    x = np.random.default_rng(0).uniform(0, 100, (n, 3))
    df = spark.createDataFrame([(0, i, *map(float, p), 0.0, "", 0) for i, p in enumerate(x)], SCHEMA)
    pairs = []
    plain = ob._candidates

    def counted(*a):
        out = plain(*a)
        pairs.append(out.count())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        return out

    ob._candidates = counted
    try:
        found = ob.k_nearest(df, df, ["t"], "neuron", k).count()
    finally:
        ob._candidates = plain
    assert found == n * k and sum(pairs) < 250 * n  # all pairs are 4,000 * n


def brute_imputed(boxes, k=5, step=5, most=20):
    seen, every = {}, set()
    for t, i, p, w in boxes:
        every.add((i, t))
        if all(v is not None and np.isfinite(v) for v in p):
            seen[t, i] = min(seen.get((t, i), (*p, w)), (*p, w))
    out = []
    for i, t in every - {(i, t) for t, i in seen}:
        times = sorted((abs(u - t), u) for u, j in seen if j == i)
        row = (i, t, times[0][1] if times else None, None, None, None, 0, None)
        if times:
            u = times[0][1]
            p = np.array(seen[u, i][:3])
            near = sorted((float(np.sqrt(((p - seen[u, j][:3]) ** 2).sum())), j) for v, j in seen if v == u and j != i)
            for m in range(k, most + 1, step):
                moves = [np.array(seen[t, j][:3]) - seen[u, j][:3] for _, j in near[:m] if (t, j) in seen]
                if moves:
                    row = (*row[:3], *np.round(p + np.mean(moves, axis=0), 9), len(moves), seen[u, i][3])
                    break
        out.append(row)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_imputed(spark, seed):
    rng = np.random.default_rng(seed)
    boxes = []
    for t in range(6):
        for i in range(40):
            p = [float(v) for v in rng.uniform(0, 20, 3)]
            gone = rng.uniform() < (0.9 if t == 3 else 0.3) or i == 7
            boxes.append((t, i, [None, float("nan"), 1.0] if gone and i % 2 else [None] * 3 if gone else p, float(i)))
            if not gone and rng.uniform() < 0.1:
                boxes.append((t, i, [v + 1 for v in p], 99.0))
    df = spark.createDataFrame([(t, i, *p, w, "a", 1) for t, i, p, w in boxes], SCHEMA)
    got = [(r["neuron"], r["t"], r["t_ref"], *(None if r[c] is None else float(np.round(r[c], 9)) for c in "xyz"), r["n"], r["w"]) for r in ob.imputed_positions(df, features=("w",)).collect()]
    want = brute_imputed(boxes)
    assert sorted(got, key=repr) == [(*r[:3], *(None if v is None else float(v) for v in r[3:6]), *r[6:]) for r in want]
    assert any(r[6] == 0 for r in want) and any(0 < r[6] for r in want)
    assert ob.imputed_positions(df.limit(0)).collect() == []
