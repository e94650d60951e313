"""Products of all pairs of units over places or times, block by block.

Units are dealt into blocks and places into slabs; a task holds two blocks of one slab as dense matrices and multiplies them, for all lags at once.
A sample goes to as many tasks as there are blocks, whatever the number of times and lags, and a task returns a row for each pair of its units; rows of
a pair are summed over slabs, partly where they arise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Units of a block, on average, and times or places of a slab.
UNITS, SLAB = 64, 4096


def _blocks(long: DataFrame, keys: list[str], unit: str, units: int) -> int:
    most = long.groupBy(*keys).agg(F.countDistinct(unit).alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(most or 1) // units))


def _sides(left: DataFrame, right: DataFrame, unit: str, blocks: int) -> DataFrame:
    """Both tables as sides 0 and 1 of all pairs i <= j of blocks of units."""
    block = F.pmod(F.xxhash64(unit), F.lit(blocks)).cast("int")
    a = left.select("*", block.alias("_i"), F.explode(F.sequence(block, F.lit(blocks - 1))).alias("_j"), F.lit(0).alias("_side"))
    b = right.select("*", F.explode(F.sequence(F.lit(0), block)).alias("_i"), block.alias("_j"), F.lit(1).alias("_side"))
    return a.unionByName(b)


def _schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def _dense(rows: pd.DataFrame, unit: str, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, values, mask) of a side; values are 0 where there is none."""
    names, k = np.unique(rows[unit].to_numpy(), return_inverse=True)
    x, m = np.zeros((len(names), width)), np.zeros((len(names), width))
    there = rows["_v"].notna().to_numpy()
    np.add.at(x, (k[there], at[there]), rows["_v"].to_numpy(float)[there])
    np.add.at(m, (k[there], at[there]), 1.0)
    return names, x, m


def _none(names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(dtype=object) for n in names})


def _pairs(keys: dict, left: np.ndarray, right: np.ndarray, same: bool, straight: np.ndarray, turned: np.ndarray) -> pd.DataFrame:
    """A row for each pair a <= b: sums is straight[u, w] where the left unit comes first, else turned[u, w]."""
    u, w = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    first = np.array([left[p] <= right[q] for p, q in zip(u, w, strict=True)], bool)
    keep = first if same else np.ones(len(u), bool)
    u, w, first = u[keep], w[keep], first[keep]
    sums = [(straight if f else turned)[p, q] for p, q, f in zip(u, w, first, strict=True)]
    out = pd.DataFrame({k: [v] * len(u) for k, v in keys.items()})
    return out.assign(a=np.where(first, left[u], right[w]), b=np.where(first, right[w], left[u]), sums=sums)


def _summed(parts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, a, b, s0 ... ) with the arrays' elements summed."""
    return parts.groupBy(*keys, "a", "b").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n)])


def covariances(long: DataFrame, unit: str, at: list[str], v: str = "v", units: int = UNITS, slab: int = SLAB) -> DataFrame:
    """(a, b, cov, corr), sample covariance of each pair of units over the places at which both have a value; both triangles, the diagonal too.

    A unit has one row at a place. Covariance is null for a single common place, correlation where one of both doesn't vary; units that have no place in common give no row,
    and rows without a unit or value none.
    """
    x = long.where(F.col(unit).isNotNull() & F.col(v).isNotNull())
    x = x.where(F.forall(F.array(*[F.col(c).isNotNull() for c in at]), lambda p: p))
    # Centred on the unit's own mean, so that sums of squares don't cancel.
    mean = x.groupBy(unit).agg(F.avg(v).alias("_mean"))
    rows = x.join(mean, unit).select(unit, *at, (F.col(v) - F.col("_mean")).cast("double").alias("_v"))
    slabs = max(1, -(-rows.select(F.approx_count_distinct(F.struct(*at))).first()[0] // slab))
    rows = rows.withColumn("_slab", F.pmod(F.xxhash64(*at), F.lit(slabs)).cast("int"))
    dealt = _sides(rows, rows, unit, _blocks(rows, [], unit, units))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf.groupby(at, sort=False).ngroup().to_numpy()
        side, width = pdf["_side"].to_numpy(), int(place.max()) + 1
        (p, x, m), (q, y, k) = (_dense(pdf[side == s], unit, place[side == s], width) for s in (0, 1))
        if not len(p) or not len(q):
            return _none(["a", "b", "sums"])
        straight = np.stack([m @ k.T, x @ k.T, m @ y.T, x @ y.T, (x * x) @ k.T, m @ (y * y).T], axis=2)
        return _pairs({}, p, q, pdf["_i"].iloc[0] == pdf["_j"].iloc[0], straight, straight[:, :, [0, 2, 1, 3, 5, 4]])

    kind = rows.schema[unit].dataType.simpleString()
    parts = dealt.groupBy("_i", "_j", "_slab").applyInPandas(product, f"a {kind}, b {kind}, sums array<double>")
    s = _summed(parts, [], 6).where("s0 > 0")
    n = F.col("s0")
    xy, xx, yy = (F.col(c) - F.col(d) * F.col(e) / n for c, d, e in (("s3", "s1", "s2"), ("s4", "s1", "s1"), ("s5", "s2", "s2")))
    # What is left of a sum of squares after rounding is no spread.
    spread = F.when((xx > 1e-14 * F.col("s4")) & (yy > 1e-14 * F.col("s5")), F.sqrt(xx * yy))
    half = s.select("a", "b", F.when(n > 1, xy / (n - 1)).alias("cov"), (xy / spread).alias("corr"))
    return half.unionByName(half.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov", "corr"))


def cross_correlation_peaks(long: DataFrame, unit: str, keys: list[str], max_lag: int = 10, t: str = "t", v: str = "v", units: int = UNITS, slab: int = SLAB) -> DataFrame:
    """(keys, a, b, corr, lag), for each pair of units the lag of largest correlation in size, the smaller lag on ties.

    Traces are centred on their mean and divided by max(mean, 1). The sum at a lag is over times t of a at which b has a value at t - lag; only
    a <= b is computed, the other half has the lag's sign turned. A unit has one row at a time, a whole number; pairs without a common time at any lag give no row.
    """
    slab = max(slab, max_lag)
    mean = F.avg(v).over(W.partitionBy(*keys, unit))
    s = long.where(F.col(unit).isNotNull() & F.col(t).isNotNull())
    s = s.select(*keys, unit, F.col(t).cast("long").alias("_t"), ((F.col(v) - mean) / F.greatest(mean, F.lit(1.0))).alias("_v")).where(F.col("_v").isNotNull())

    def slab_of(c: Column) -> Column:
        return F.floor(c / float(slab)).cast("long")

    left = s.withColumn("_slab", slab_of(F.col("_t")))
    right = s.withColumn("_slab", F.explode(F.sequence(slab_of(F.col("_t") - max_lag), slab_of(F.col("_t") + max_lag))))
    dealt = _sides(left, right, unit, _blocks(s, keys, unit, units))
    lags = 2 * max_lag + 1

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        side, at = pdf["_side"].to_numpy(), (pdf["_t"] - pdf["_slab"] * slab).to_numpy(int)
        p, x, m = _dense(pdf[side == 0], unit, at[side == 0], slab)
        q, y, k = _dense(pdf[side == 1], unit, at[side == 1] + max_lag, slab + 2 * max_lag)
        if not len(p) or not len(q):
            return _none([*keys, "a", "b", "sums"])
        cuts = [slice(max_lag - lag, max_lag - lag + slab) for lag in range(-max_lag, max_lag + 1)]
        c, n = (np.stack([f @ g[:, w].T for w in cuts], axis=2) for f, g in ((x, y), (m, k)))
        straight, turned = np.concatenate([c, n], axis=2), np.concatenate([c[:, :, ::-1], n[:, :, ::-1]], axis=2)
        return _pairs({c: pdf[c].iloc[0] for c in keys}, p, q, pdf["_i"].iloc[0] == pdf["_j"].iloc[0], straight, turned)

    kind = s.schema[unit].dataType.simpleString()
    parts = dealt.groupBy(*keys, "_i", "_j", "_slab").applyInPandas(product, f"{_schema(s, keys)}a {kind}, b {kind}, sums array<double>")
    total = _summed(parts, keys, 2 * lags)
    # Rounded first, so that sums equal but for their order tie.
    each = [F.when(F.col(f"s{lags + k}") > 0, F.struct(F.round(F.abs(F.col(f"s{k}")), 9).alias("size"), F.lit(max_lag - k).alias("back"), F.col(f"s{k}").alias("c"))) for k in range(lags)]
    best = total.select(*keys, "a", "b", F.array_max(F.array(*each)).alias("m")).where("m IS NOT NULL")
    return best.select(*keys, "a", "b", F.col("m.c").alias("corr"), (-F.col("m.back")).alias("lag"))
