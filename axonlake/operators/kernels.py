"""Numeric kernels that SQL can't express well, as numpy functions and the grouped maps that call them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .fits import MODELS, fit_f0, fit_quality, fitted_baselines  # noqa: F401  these were here first
from .objects import imputed_positions  # noqa: F401
from .warping import dtw_distances, dtw_many, linking_pairs, near_pairs, trial_pairs  # noqa: F401

# ---------------------------------------------------------------- time warping


def dtw_in_sql(x, y):
    """A16 as nested higher-order functions: exact, slower; kept to cross-check."""
    start = F.transform(F.concat(F.array(F.lit(0.0)), F.transform(y, lambda _: F.lit(float("inf")))), lambda v: v)

    def next_row(row, a):
        empty = F.array(F.lit(float("inf")))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(y)),
            empty,
            lambda new, j: F.concat(new, F.array(F.abs(a - F.element_at(y, j)) + F.least(F.element_at(row, j + 1), F.element_at(row, j), F.element_at(new, -1)))),
        )

    return F.element_at(F.aggregate(x, start, next_row), -1)


# ---------------------------------------------------------------- density clustering


def density_noise(edges: DataFrame, items: DataFrame, keys: list[str], eps: float, min_samples: int) -> DataFrame:
    """A17 without labels: is_core and is_noise of each item; edges: keys, i, j, dist (i < j). An item counts itself."""
    near = edges.where(F.col("dist") <= eps).select(*keys, "i", "j")
    both = near.unionByName(near.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
    n = both.groupBy(*keys, "i").agg((F.count("*") + 1).alias("n"))
    core = items.select(*keys, F.col("item").alias("i")).join(n, [*keys, "i"], "left").withColumn("is_core", F.coalesce("n", F.lit(1)) >= min_samples).drop("n")
    reached = both.join(core.where("is_core").select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi").select(*keys, "i").distinct().withColumn("_r", F.lit(True))
    out = core.join(reached, [*keys, "i"], "left")
    return out.select(*keys, F.col("i").alias("item"), "is_core", (~F.col("is_core") & F.col("_r").isNull()).alias("is_noise"))


def most_of_sparse(min_samples: int) -> int:
    """The most neighbours of an item that isn't core, as it counts itself."""
    return max(0, min_samples - 2)


def noise_of_neighbours(near: DataFrame, items: DataFrame, keys: list[str], min_samples: int) -> DataFrame:
    """density_noise() from numbers of neighbours instead of edges: keys, i, n, and near, the neighbours themselves of those with most_of_sparse() or fewer.

    Only items that aren't core are looked up with their few neighbours, so rows go with the items, not with the pairs.
    """
    core = items.select(*keys, F.col("item").alias("i")).join(near, [*keys, "i"], "left").withColumn("is_core", F.coalesce("n", F.lit(0)) + 1 >= min_samples)
    sparse = core.where(~F.col("is_core")).select(*keys, "i", F.explode("near").alias("j"))
    reached = sparse.join(core.where("is_core").select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi").select(*keys, "i").distinct().withColumn("_r", F.lit(True))
    out = core.select(*keys, "i", "is_core").join(reached, [*keys, "i"], "left")
    return out.select(*keys, F.col("i").alias("item"), "is_core", (~F.col("is_core") & F.col("_r").isNull()).alias("is_noise"))


def density_labels(n: int, i: np.ndarray, j: np.ndarray, min_samples: int) -> np.ndarray:
    """Labels 0, 1, ... by first item of each cluster, -1 for noise; (i, j) are the near pairs. A border item joins the cluster found first."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(i, j, strict=True):
        near[a].append(int(b))
        near[b].append(int(a))
    core = [len(x) + 1 >= min_samples for x in near]
    labels, k = np.full(n, -1), 0
    for s in range(n):
        if not core[s] or labels[s] >= 0:
            continue
        labels[s], todo = k, [s]
        while todo:
            for t in sorted(near[todo.pop()]):
                if labels[t] < 0:
                    labels[t] = k
                    if core[t]:
                        todo.append(t)
        k += 1
    return labels


def cluster_trials(edges: DataFrame, items: DataFrame, keys: list[str], eps: float = 12.0, min_samples: int = 2) -> DataFrame:
    """(keys, item, label, is_noise). A group is a neuron's trials of one stimulus: its near pairs meet in one task."""
    near = edges.where(F.col("dist") <= eps).select(*keys, F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"))
    own = items.select(*keys, F.col("item").cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema.fields) + ", item long, label int, is_noise boolean"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf.loc[pdf["b"].isna(), "a"].unique())
        pairs = pdf[pdf["b"].notna()]
        got = density_labels(len(names), np.searchsorted(names, pairs["a"]), np.searchsorted(names, pairs["b"].astype("int64")), min_samples)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(names) for k in keys})
        return out.assign(item=names, label=got.astype("int32"), is_noise=got < 0)

    return own.unionByName(near).groupBy(*keys).applyInPandas(label, schema)


def k_distance(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each item's k-th smallest positive distance, the last if there are fewer, ranked by size within the group."""
    both = edges.select(*keys, "i", "dist").unionByName(edges.select(*keys, F.col("j").alias("i"), "dist")).where("dist > 0")
    rank = F.row_number().over(W.partitionBy(*keys, "i").orderBy("dist"))
    kth = both.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*keys, "i").agg(F.max("dist").alias("k_dist"))
    return kth.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("k_dist", "i")).cast("long"))


def warped_clusters(trials: DataFrame, keys: list[str], eps: float = 12.0, min_samples: int = 2, item: str = "trial", column: str = "dff") -> DataFrame:
    """cluster_trials() by warping distance. Up to a density of 2 an item with a neighbour is core, so clusters are what pairs connect; others need all near pairs."""
    pairs = linking_pairs if min_samples <= 2 else near_pairs
    return cluster_trials(pairs(trials, keys, eps, item, column), trials.select(*keys, F.col(item).alias("item")), keys, eps, min_samples)


def ranked_distances(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """k_distance() from each item's k smallest positive distances, ascending (keys, i, near): one row an item is ranked, not one a pair."""
    kth = nearest.select(*keys, "i", F.element_at("near", -1).alias("k_dist"))
    return kth.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("k_dist", "i")).cast("long"))


# ---------------------------------------------------------------- linkage


def linkage(d: np.ndarray, method: str) -> np.ndarray:
    """Agglomeration of a distance matrix: rows (a, b, height, size) as usual, by height; 'average' or 'ward'.

    Chains of nearest neighbours: from any cluster on to its nearest, until two are nearest to each other; these are merged, whatever else there is,
    as under both methods no merger brings a third cluster nearer. Each cluster is looked at a few times, so time goes with the square of the rows.
    Of equal distances the way back goes first, then the smallest row; mergers of equal height are in the order in which chains find them.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    sizes, there = np.ones(n), np.ones(n, bool)
    chain: list[int] = []
    found = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(there)))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        h, sa, sb = d[a, b], sizes[a], sizes[b]
        if method == "average":
            row = (sa * d[a] + sb * d[b]) / (sa + sb)
        else:
            with np.errstate(invalid="ignore"):
                row = np.sqrt(np.maximum(((sa + sizes) * d[a] ** 2 + (sb + sizes) * d[b] ** 2 - sizes * h**2) / (sa + sb + sizes), 0))
        found.append((h, a, b))
        there[b] = False
        row[~there] = np.inf
        row[a] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        sizes[a] = sa + sb
    # Named in order of height; a and b stand for the clusters that hold them then.
    parent, count, out = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (h, a, b) in enumerate(sorted(found, key=lambda x: x[0])):
        p, q = sorted((top(a), top(b)))
        parent[p] = parent[q] = n + step
        count[n + step] = count[p] + count[q]
        out.append((p, q, h, count[n + step]))
    return np.array(out).reshape(-1, 4)


def members(z: np.ndarray, n: int) -> list[list[int]]:
    """Leaves of each node, in the order of its children."""
    got = [[i] for i in range(n)]
    for a, b, _, _ in z:
        got.append(got[int(a)] + got[int(b)])
    return got


def optimal_order(z: np.ndarray, d: np.ndarray) -> list[int]:
    """Leaf order of least summed distance of neighbours that the tree allows (Bar-Joseph et al., 2001), in O(n^3) by minima over rows.

    best[u, w] is the least sum for the smallest subtree that holds both, from u at one end to w at the other.
    """
    n = len(d)
    if n < 2:
        return list(range(n))
    leaves = [np.array(x) for x in members(z, n)]
    best, via = np.full((n, n), np.inf), np.zeros((n, n, 2), int)
    best[range(n), range(n)] = 0.0

    def ends(node: int) -> np.ndarray:
        """best among the node's leaves, infinite for two of one child: both can't be ends."""
        own = leaves[node]
        out = best[np.ix_(own, own)].copy()
        if node >= n:
            for child in z[node - n, :2].astype(int):
                inside = np.isin(own, leaves[child])
                out[np.ix_(inside, inside)] = np.inf
        return out

    for a, b, _, _ in z:
        a, b = int(a), int(b)
        left, right = leaves[a], leaves[b]
        ea, eb, cross = ends(a), ends(b), d[np.ix_(left, right)]
        step = ea[:, :, None] + cross[None, :, :] if len(left) ** 2 * len(right) <= 1 << 22 else None
        if step is not None:
            m, first = step.argmin(axis=1), step.min(axis=1)
        else:  # a row at a time, for memory
            rows = [ea[u][:, None] + cross for u in range(len(left))]
            m, first = np.array([r.argmin(axis=0) for r in rows]), np.array([r.min(axis=0) for r in rows])
        for u in range(len(left)):
            total = first[u][:, None] + eb
            k = total.argmin(axis=0)
            at = np.arange(len(right))
            best[left[u], right] = best[right, left[u]] = total[k, at]
            via[left[u], right] = np.stack([left[m[u, k]], right[k]], axis=1)

    def walk(node: int, u: int, w: int) -> list[int]:
        if node < n:
            return [u]
        a, b = z[node - n, :2].astype(int)
        if u not in leaves[a]:
            return walk(node, w, u)[::-1]
        m, k = via[u, w]
        return walk(a, u, int(m)) + walk(b, int(k), w)

    top = len(leaves) - 1
    own = leaves[top]
    u, w = np.unravel_index(ends(top).argmin(), (len(own), len(own)))
    u, w = sorted((int(own[u]), int(own[w])))
    return walk(top, u, w)


def cut(z: np.ndarray, n: int, height: float) -> np.ndarray:
    """Cluster of each leaf when links above height are cut, numbered by first leaf."""
    parent = list(range(n + len(z)))
    for k, (a, b, h, _) in enumerate(z):
        if h <= height:
            parent[int(a)] = parent[int(b)] = n + k
    roots = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(r, len(seen)) for r in roots])


def correlation_distance(x: np.ndarray) -> np.ndarray:
    return np.clip(1 - np.corrcoef(x), 0, 2)


def row_order(x: np.ndarray, method: str = "average") -> list[int]:
    """Order of rows by linkage of their correlation distance; rows without spread have none and come last, as they are."""
    flat = ~(x.std(axis=1) > 0) if x.size else np.ones(len(x), bool)
    rows = np.flatnonzero(~flat)
    if len(rows) <= 2:
        order = rows.tolist()
    else:
        d = correlation_distance(x[rows])
        z = linkage(d, method)
        order = rows[optimal_order(z, d) if method == "average" else members(z, len(rows))[-1]].tolist()
    return order + np.flatnonzero(flat).tolist()


def ordered_rows(matrix: DataFrame, row: str, column: str, value: str, keys: list[str], method: str = "average", last: str | None = None) -> DataFrame:
    """(keys, row, place). A matrix (neurons by stimuli or times) is small by nature and meets in one task.

    Missing values count as zero. Rows for which the column last holds come after all others, in order of their names.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matrix.select(*keys, row).schema.fields) + ", place int"

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        put = sorted(pdf.loc[pdf[last], row].unique()) if last else []
        wide = pdf[~pdf[row].isin(put)].pivot_table(index=row, columns=column, values=value, aggfunc="mean", sort=True).fillna(0.0)
        names = [*(wide.index.to_numpy()[row_order(wide.to_numpy(float), method)] if len(wide) else []), *put]
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(names) for k in keys})
        return out.assign(**{row: names, "place": np.arange(len(names), dtype="int32")})[[*keys, row, "place"]]

    return matrix.groupBy(*keys).applyInPandas(order, schema)


def delay_clusters(corr: np.ndarray, lag: np.ndarray, strength: np.ndarray, reference: str = "variance") -> list[tuple[int, int, int]]:
    """(row, cluster, delay) ordered by cluster, then delay to the cluster's reference row, then row.

    corr holds peak correlations by size; rows of (largest - corr) are taken as observations for Ward's
    linkage, cut at half the largest height. The reference is the row of largest strength, or of largest
    summed correlation.
    """
    n = len(corr)
    if n == 1:
        return [(0, 0, 0)]
    x = corr.max() - corr
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    z = linkage(d, "ward")
    clusters = cut(z, n, 0.5 * z[:, 2].max())
    out = []
    for c in range(clusters.max() + 1):
        rows = np.flatnonzero(clusters == c)
        score = strength[rows] if reference == "variance" else corr[np.ix_(rows, rows)].sum(axis=1)
        ref = rows[int(score.argmax())]
        out += sorted((c, int(lag[ref, r]), int(r)) for r in rows)
    return [(r, c, delay) for c, delay, r in out]


# ---------------------------------------------------------------- components


def gram_components(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix, largest first; a vector's largest entry by size is positive."""
    w, v = np.linalg.eigh(gram)
    order = np.argsort(-w, kind="stable")[:k]
    w, v = np.maximum(w[order], 0), v[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return w, v * np.where(sign == 0, 1, sign)


def covariance_of(vectors: DataFrame, dim: int, column: str = "dff") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix of arrays of a fixed length: sums on the executors, dim * dim numbers to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([s, p.ravel()]).tolist()], pa.list_(pa.float64()))], ["n", "x"])

    part = vectors.select(column).mapInArrow(sums, "n long, x array<double>")
    flat = part.select("n", F.posexplode("x").alias("i", "v"))
    n = part.agg(F.sum("n")).first()[0] or 0
    x = np.zeros(dim + dim * dim)
    for r in flat.groupBy("i").agg(F.sum("v").alias("v")).collect():
        x[r["i"]] = r["v"]
    mean = x[:dim] / max(n, 1)
    return n, mean, x[dim:].reshape(dim, dim) - n * np.outer(mean, mean)


def principal_components(vectors: DataFrame, dim: int, k: int, keys: list[str], column: str = "dff") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores, explained shares, loadings): centred, at most min(rows, dim) - 1 components. Scores: keys, component, score."""
    n, mean, scatter = covariance_of(vectors, dim, column)
    k = max(0, min(k, n - 1, dim - 1))
    w, v = gram_components(scatter, k)
    share = w / np.trace(scatter) if np.trace(scatter) > 0 else w
    parts = [(F.aggregate(F.zip_with(F.col(column), F.lit(v[:, c].tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - float(mean @ v[:, c])) for c in range(k)]
    rows = vectors.select(*keys, F.posexplode(F.array(*parts) if parts else F.array().cast("array<double>")).alias("component", "score"))
    return rows, share, v


def demixed_components(marginal: np.ndarray, data: np.ndarray, k: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Decoder (neurons, k) and encoder (neurons, k) of one marginal by reduced-rank regression (Kobak et al., 2016).

    Both are neurons x conditions. The regression of the marginal on the data is projected to the principal
    directions of its fit.
    """
    gram = data @ data.T
    a = marginal @ data.T @ np.linalg.inv(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)))
    fit = a @ data
    _, u = gram_components(fit @ fit.T, k)
    return a.T @ u, u


# ---------------------------------------------------------------- repair by curve


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with zero second derivatives at the ends; outside it goes on as the end pieces do."""
    n = len(x)
    if n == 0:
        return np.full(len(at), np.nan)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    a = np.zeros((n, n))
    r = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d, e = at - x[k], x[k + 1] - at
    return (m[k] * e**3 + m[k + 1] * d**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * e + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * d


def region_repaired(samples: DataFrame, keys: list[str], start: int, end: int, method: str, window: int = 10, degree: int = 2, t: str = "t", v: str = "v") -> DataFrame:
    """[start, end) replaced by a natural spline or a polynomial through the windows around it; (keys, t, v, repaired)."""
    if method not in ("spline", "polynomial"):
        raise ValueError(f"unknown method {method!r}; one of polynomial, spline")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys, t, v).schema.fields) + ", repaired double"

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[t].to_numpy(float), pdf[v].to_numpy(float)
        near = (((x >= start - window) & (x < start)) | ((x >= end) & (x < end + window))) & np.isfinite(y)
        inside, out = (x >= start) & (x < end), y.copy()
        order = np.argsort(x[near], kind="stable")
        p, q = x[near][order], y[near][order]
        if len(p):
            if method == "spline":
                out[inside] = natural_spline(p, q, x[inside])
            else:
                out[inside] = np.polyval(np.polyfit(p - start, q, min(degree, len(p) - 1)), x[inside] - start)
        return pdf[[*keys, t, v]].assign(repaired=out)

    return samples.groupBy(*keys).applyInPandas(repair, schema)
