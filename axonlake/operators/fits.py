"""Robust baseline fits (A14): many series at once by variable projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("exp", "linear", "double_exp")
#: Rates that a model starts from, one for each exponential; the least rate; and the largest for each mean distance of samples: what is gone within a
#: sample or two is a spike, no baseline, and would take up the first sample whenever that is off.
STARTS = {"exp": (0.001,), "linear": (), "double_exp": (0.01, 0.001)}
LEAST_RATE, MOST_RATE = 1e-9, 0.5
#: Relative gain at which a fit ends; bounds of the steps over rates and over linear parameters, which end long before.
GAIN, INNER_GAIN, STEPS, INNER_STEPS = 1e-11, 1e-14, 300, 100
#: Largest change of a log rate in a step: a fit stays in the valley that its start lies in, and doesn't leap to a spike at the first sample.
LONGEST = 0.5
#: Samples of the series that are fitted at once.
CHUNK = 1 << 17


def _g(tau: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(1 - exp(-b tau)) / b: an exponential that turns into a line, not into a constant, as its rate goes to zero."""
    return -np.expm1(np.minimum(-b * tau, 600.0)) / b


def _h(tau: np.ndarray, b: np.ndarray, c: np.ndarray, g_b: np.ndarray | None = None, g_c: np.ndarray | None = None) -> np.ndarray:
    """Divided difference of _g over two rates: it turns into a parabola as both go to zero, into the derivative as they meet. g_b, g_c: _g at the rates, if known."""
    far, few = (np.abs(b - c) > 1e-4 * (b + c))[:, 0], (np.maximum(b, c) < 1e-3)[:, 0]
    out = ((_g(tau, b) if g_b is None else g_b) - (_g(tau, c) if g_c is None else g_c)) / np.where(far[:, None], b - c, 1.0)
    meet = np.flatnonzero(~far & ~few)
    if len(meet):
        t, mid = tau[meet], (b[meet] + c[meet]) / 2
        out[meet] = (t * np.exp(np.minimum(-mid * t, 600.0)) - _g(t, mid)) / mid
    if few.any():
        t, b, c = tau[few], b[few], c[few]
        out[few] = -(t**2) / 2 + (b + c) * t**3 / 6 - (b * b + b * c + c * c) * t**4 / 24
    return out


def basis(tau: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """(series, samples, functions) at log rates (series, rates). They span what the model's exponentials and the constant span, without near copies of each other."""
    one = np.ones_like(tau)
    if not logs.shape[1]:
        return np.stack([one, tau], axis=2)
    b = np.exp(logs)[:, :, None]
    g = _g(tau, b[:, 0])
    return np.stack([one, g] + ([_h(tau, b[:, 0], b[:, 1], g)] if logs.shape[1] == 2 else []), axis=2)


def _slopes(tau: np.ndarray, logs: np.ndarray, phi: np.ndarray, beta: np.ndarray, d: float) -> np.ndarray:
    """(series, samples, rates): what a fit changes by with each log rate, from basis() a step d to either side; only the functions that a rate moves are worked out anew."""
    b, up, down = (np.exp(x)[:, :, None] for x in (logs, logs + d, logs - d))
    g_up, g_down = _g(tau, up[:, 0]), _g(tau, down[:, 0])
    moved = np.zeros((logs.shape[1], *phi.shape))
    moved[0, :, :, 1] = g_up - g_down
    if logs.shape[1] == 2:
        own, other = phi[:, :, 1], _g(tau, b[:, 1])
        moved[0, :, :, 2] = _h(tau, up[:, 0], b[:, 1], g_up, other) - _h(tau, down[:, 0], b[:, 1], g_down, other)
        moved[1, :, :, 2] = _h(tau, b[:, 0], up[:, 1], own) - _h(tau, b[:, 0], down[:, 1], own)
    return np.stack([((m / (2 * d)) @ beta[:, :, None])[:, :, 0] for m in moved], axis=2)


def _loss(y: np.ndarray, phi: np.ndarray, beta: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Soft L1 loss of each series, what is left of its samples, and the roots that both this and the weights are made of."""
    r = (y - (phi @ beta[:, :, None])[:, :, 0]) * on
    root = np.sqrt(1 + r * r)
    return (2 * r * r / (root + 1)).sum(axis=1), r, root


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Batched h^-1 g, with rows and columns brought to one scale and a trace of a ridge."""
    d = 1 / np.sqrt(np.maximum(np.einsum("sii->si", h), 1e-300))
    scaled = h * d[:, :, None] * d[:, None, :] + 1e-13 * np.eye(h.shape[1])
    return d[:, :, None] * np.linalg.solve(scaled, d[:, :, None] * g)


def _linear(y: np.ndarray, phi: np.ndarray, on: np.ndarray, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linear parameters of least soft L1 loss, and the loss: Newton steps, reweighted ones where these don't go down. The loss is convex."""
    if beta is None:
        p = phi * on[:, :, None]
        beta = _solved(p.transpose(0, 2, 1) @ p, p.transpose(0, 2, 1) @ y[:, :, None])[:, :, 0]
    beta = beta.copy()
    loss, r, root = _loss(y, phi, beta, on)
    left, f, m, yy = np.arange(len(y)), phi, on, y
    for _ in range(INNER_STEPS):
        was, b = loss[left], beta[left]
        q = m / root
        g = f.transpose(0, 2, 1) @ (q * r)[:, :, None]
        new = b + _solved((f * (q**3)[:, :, None]).transpose(0, 2, 1) @ f, g)[:, :, 0]
        got, r, root = _loss(yy, f, new, m)
        bad = ~(got < was)
        if bad.any():
            new[bad] = b[bad] + _solved((f[bad] * q[bad, :, None]).transpose(0, 2, 1) @ f[bad], g[bad])[:, :, 0]
            got[bad], r[bad], root[bad] = _loss(yy[bad], f[bad], new[bad], m[bad])
        down = got < was
        beta[left[down]], loss[left[down]] = new[down], got[down]
        on_ = down & (was - got > INNER_GAIN * was)
        left = left[on_]
        if not len(left):
            break
        f, m, yy, r, root = f[on_], m[on_], yy[on_], r[on_], root[on_]
    return beta, loss


def _fit(tau: np.ndarray, y: np.ndarray, on: np.ndarray, logs: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log rates, linear parameters) of least soft L1 loss: a damped Gauss-Newton step over the rates alone, with the linear parameters projected out."""
    m = logs.shape[1]
    logs = np.clip(logs, least[:, None], most[:, None])
    phi = basis(tau, logs)
    beta, loss = _linear(y, phi, on, None)
    if not m:
        return logs, beta
    damp, left, d = np.full(len(y), 0.1), np.arange(len(y)), 1e-4
    for _ in range(STEPS):
        t, yy, o, p, b, was = tau[left], y[left], on[left], logs[left], beta[left], loss[left]  # phi is the basis at p
        r = (yy - (phi @ b[:, :, None])[:, :, 0]) * o
        q = o / np.sqrt(1 + r * r)
        w = (q**3)[:, :, None]
        jac = _slopes(t, p, phi, b, d)
        jac = jac - phi @ _solved((phi * w).transpose(0, 2, 1) @ phi, (phi * w).transpose(0, 2, 1) @ jac)
        h = (jac * w).transpose(0, 2, 1) @ jac
        g = jac.transpose(0, 2, 1) @ (q * r)[:, :, None]
        diag = np.einsum("sii->si", h)
        h = h + damp[left][:, None, None] * np.eye(m) * np.maximum(diag, 1e-12 * (1 + diag.max(axis=1, keepdims=True)))[:, None, :]
        step = np.clip(np.linalg.solve(h, g)[:, :, 0], -LONGEST, LONGEST)
        new = np.clip(p + step, least[left, None], most[left, None])
        phi_new = basis(t, new)
        beta_new, got = _linear(yy, phi_new, o, b)
        down = got < was
        phi[down] = phi_new[down]
        at = left[down]
        logs[at], beta[at], loss[at] = new[down], beta_new[down], got[down]
        damp[left] = np.where(down, np.maximum(damp[left] / 5, 1e-12), damp[left] * 4)
        small = np.where(down, was - got <= GAIN * np.maximum(was, 1e-10), damp[left] > 1e10)
        on_ = ~small & ~(np.abs(new - p).max(axis=1) < 1e-12)
        left = left[on_]
        if not len(left):
            break
        phi = phi[on_]
    return logs, beta


def _parameters(name: str, b: np.ndarray, beta: np.ndarray, t0: float, span: float) -> list[float]:
    """A series' parameters as usual: (a, b, c), (slope, start) or (a, b, a, b, c), over the times themselves."""
    if name == "linear":
        return [beta[1] / span, beta[0] - beta[1] * t0 / span]
    up = np.exp(np.minimum(b / span * t0, 700.0))
    if name == "exp":
        return [-beta[1] / b[0] * up[0], b[0] / span, beta[0] + beta[1] / b[0]]
    gap = b[0] - b[1]
    share = beta[2] / (gap if abs(gap) > 1e-12 else 1e-12)
    one, two = beta[1] + share, -share
    return [-one / b[0] * up[0], b[0] / span, -two / b[1] * up[1], b[1] / span, beta[0] + one / b[0] + two / b[1]]


def aicc(rss: float, n: int, k: int) -> float:
    a = n * np.log(max(rss, 1e-10) / n) + 2 * k
    return a + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else a


def r_squared(y: np.ndarray, fitted: np.ndarray) -> float:
    total = ((y - y.mean()) ** 2).sum()
    rest = ((y - fitted) ** 2).sum()
    return float(1 - rest / total) if total > 0 else float(rest == 0)


def mad_mask(y: np.ndarray, limit: float = 3.0) -> np.ndarray:
    dev = np.abs(y - np.median(y)) if len(y) else y
    mad = np.median(dev) if len(y) else 0.0
    return np.ones(len(y), bool) if not mad > 0 else dev / (1.4826 * mad) <= limit


Fit = tuple[np.ndarray, str, float, list[float]]


def _chunk(series: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Fit]:
    """Fits of series (t, y, at) with two samples or more, all finite."""
    n = max(len(t) for t, _, _ in series)
    tau, y, on = (np.zeros((len(series), n)) for _ in range(3))
    t0, span = np.array([t.min() for t, _, _ in series]), np.array([max(np.ptp(t), 1e-12) for t, _, _ in series])
    for i, (t, v, _) in enumerate(series):
        tau[i, : len(t)], y[i, : len(t)], on[i, : len(t)] = (t - t0[i]) / span[i], v, 1.0
    count = on.sum(axis=1)
    best: list[tuple | None] = [None] * len(series)
    for name in MODELS:
        k = 2 if name == "linear" else 2 * len(STARTS[name]) + 1
        rows = np.flatnonzero(count >= k)
        if not len(rows):
            continue
        least, most = np.log(LEAST_RATE * span[rows]), np.log(MOST_RATE * count[rows])
        logs = np.log(np.array(STARTS[name])[None, :] * span[rows, None]) if STARTS[name] else np.zeros((len(rows), 0))
        logs, beta = _fit(tau[rows], y[rows], on[rows], logs, most, np.minimum(least, most))
        fitted = (basis(tau[rows], logs) @ beta[:, :, None])[:, :, 0]
        rss = (((y[rows] - fitted) * on[rows]) ** 2).sum(axis=1)
        for j, i in enumerate(rows):
            score = aicc(float(rss[j]), int(count[i]), k)
            if np.isfinite(score) and (best[i] is None or score < best[i][0]):
                best[i] = (score, name, logs[j], beta[j], fitted[j, : int(count[i])])
    out: list[Fit] = []
    for i, (_, v, at) in enumerate(series):
        if best[i] is None:
            out.append((np.full(len(at), v.mean()), "constant", 0.0, [float(v.mean())]))
            continue
        _, name, logs, beta, fitted = best[i]
        f0 = (basis((at[None, :] - t0[i]) / span[i], logs[None, :]) @ beta[None, :, None])[0, :, 0]
        out.append((f0, name, r_squared(v, fitted), [float(p) for p in _parameters(name, np.exp(logs), beta, t0[i], span[i])]))
    return out


def fit_many(series: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Fit]:
    """A14 for each (times, values, times asked for): baseline there, model, R squared, parameters; outliers by MAD are left out first.

    Of the exponential, the line and the double exponential the one of least corrected Akaike criterion, the first on ties; a model needs
    as many samples as parameters. One sample or none gives a constant. Series of like length are fitted together; which ones doesn't matter.
    """
    out: list[Fit | None] = [None] * len(series)
    todo = []
    for i, (t, y, at) in enumerate(series):
        keep = np.isfinite(y)
        t, y = t[keep].astype(float), y[keep].astype(float)
        keep = mad_mask(y)
        t, y = t[keep], y[keep]
        if len(y) < 2:
            c = float(y[0]) if len(y) else 0.0
            out[i] = (np.full(len(at), c), "constant", 0.0, [c])
        else:
            todo.append((len(y), i, (t, y, at.astype(float))))
    todo.sort(key=lambda x: x[:2])
    while todo:
        take = 1
        while take < len(todo) and (take + 1) * todo[take][0] <= CHUNK:
            take += 1
        for (_, i, _), fit in zip(todo[:take], _chunk([s for _, _, s in todo[:take]]), strict=True):
            out[i] = fit
        todo = todo[take:]
    return out  # type: ignore[return-value]


def fit_f0(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> Fit:
    """fit_many() for one series."""
    return fit_many([(t, y, at)])[0]


def fitted_baselines(samples: DataFrame, keys: list[str], t: str = "t", v: str = "v", used: str | None = None) -> DataFrame:
    """(keys, model, r2, params, t, v, f0) with arrays over a series' samples, fitted to those where used holds (all if None).

    Samples are ordered by time, then value; a missing value is no sample. A table without rows gives none.
    """
    # Fits are slow for their bytes: adaptive execution would merge whole series into few tasks, also where they were dealt out before they were
    # gathered, as a key that is constant is no key to it. A quarter of the partitions, as fits of many series at once are cheaper.
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(n, max(16, n // 4))
    one = F.struct(F.col(t).cast("long").alias("t"), F.col(v).cast("double").alias("v"), (F.coalesce(F.col(used), F.lit(False)) if used else F.lit(True)).alias("u"))
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("s")).select(*keys, F.col("s.t").alias("t"), F.col("s.v").alias("v"), F.col("s.u").alias("u")).repartition(n, *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema.fields) + ", model string, r2 double, params array<double>, t array<long>, v array<double>, f0 array<double>"

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            series = []
            for x, y, u in zip(b.column("t"), b.column("v"), b.column("u"), strict=True):
                x, y, u = (c.values.to_numpy(zero_copy_only=False) for c in (x, y, u))
                x, y, u = x.astype(float), y.astype(float), u.astype(bool)
                series.append((x[u], y[u], x))
            got = fit_many(series)
            arrays = [pa.array([g[1] for g in got]), pa.array([g[2] for g in got]), pa.array([g[3] for g in got], pa.list_(pa.float64())), b.column("t"), b.column("v"), pa.array([g[0] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *arrays], [*keys, "model", "r2", "params", "t", "v", "f0"])

    return rows.mapInArrow(fit, schema)


def fit_quality(fits: DataFrame, by: tuple[str, ...] = ("model",), poor: float = 0.8) -> DataFrame:
    """Mean and median R squared, fits and poor fits of each model, or of each sub-recording."""
    return fits.groupBy(*by).agg(F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"), F.count("*").alias("n"), F.count(F.when(F.col("r2") < poor, 1)).alias("n_poor"))


def worst_and_best(fits: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """The k fits of least R squared and the k of largest, which tells them apart; ties by order. A fit of few may be both.

    Two sorted limits, each task's first k to one: the fits are read twice, so pass them written.
    """
    worst = fits.orderBy(F.asc("r2"), *order).limit(k).withColumn("which", F.lit("worst"))
    return worst.unionByName(fits.orderBy(F.desc("r2"), *order).limit(k).withColumn("which", F.lit("best")))
