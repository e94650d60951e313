"""Ordered-sample operators on long tables: gaps, gradients, outliers, baselines.

A series is a set of key columns, a time column t and a value v; missing values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def interpolated(df: DataFrame, keys: list[str], t: str = "t", v: str = "v", out: str = "filled") -> DataFrame:
    """Linear between the neighbours that have values, the nearest value at the edges; null where all are.

    The neighbour after is the last one before in descending order: a frame that grows with the row is carried on, one that
    shrinks would be read anew for each row. Times are expected once in a series.
    """
    point = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    lo, hi = (F.last(point, ignorenulls=True).over(W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, 0)) for o in (F.asc(t), F.desc(t)))
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col(t) - F.col("_lo.t")) / F.nullif(F.col("_hi.t") - F.col("_lo.t"), F.lit(0))
    return df.withColumn(out, F.coalesce(F.col(v), line, F.col("_lo.v"), F.col("_hi.v"))).drop("_lo", "_hi")


def spikes_repaired(df: DataFrame, keys: list[str], limit: float = 10.0, t: str = "t", v: str = "v") -> DataFrame:
    """Values beyond the limit are interpolated, as single precision; a series without any is left as it is, gaps too."""
    bad = F.abs(F.col(v)) > limit
    has = F.max(F.coalesce(bad, F.lit(False)).cast("int")).over(W.partitionBy(*keys)) == 1
    marked = df.withColumn("_has", has).withColumn("_v", F.when(~F.coalesce(bad, F.lit(False)), F.col(v)))
    filled = interpolated(marked, keys, t, "_v", "_filled")
    return filled.withColumn("repaired", F.when(F.col("_has"), F.col("_filled")).otherwise(F.col(v)).cast("float")).drop("_has", "_v", "_filled")


def matrix_filled(df: DataFrame, keys: list[str], compat_frame: bool = False, t: str = "t", v: str = "v") -> DataFrame:
    """A10: W02, then zero for a series without any value. compat_frame: such a series stays null, and a time at which any series lacks a value is zero in all."""
    out = interpolated(df, keys, t, v)
    if not compat_frame:
        return out.withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    gap = F.max(F.col("filled").isNull().cast("int")).over(W.partitionBy(t)) == 1
    return out.withColumn("filled", F.when(gap, F.lit(0.0)).otherwise(F.col("filled")))


def isolated(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> Column:
    """A value whose neighbours on both sides are missing; the edges count as missing."""
    by = W.partitionBy(*keys).orderBy(t)
    return F.col(v).isNotNull() & F.lag(v).over(by).isNull() & F.lead(v).over(by).isNull()


def gradient(keys: list[str], t: str = "t", v: str = "v") -> Column:
    """Central differences, one-sided at the ends, null for a single sample."""
    by = W.partitionBy(*keys).orderBy(t)
    before, after = F.lag(v).over(by), F.lead(v).over(by)
    return F.coalesce((after - before) / 2, after - F.col(v), F.col(v) - before)


def mad_kept(df: DataFrame, keys: list[str], limit: float = 3.0, v: str = "v") -> DataFrame:
    """Rows within limit robust deviations of their group's median; a group without spread keeps all."""
    by = W.partitionBy(*keys)
    df = df.withColumn("_med", F.median(v).over(by)).withColumn("_dev", F.abs(F.col(v) - F.col("_med")))
    df = df.withColumn("_mad", F.median("_dev").over(by))
    keep = (F.coalesce("_mad", F.lit(0.0)) == 0) | (F.col("_dev") / (1.4826 * F.col("_mad")) <= limit)
    return df.where(keep).drop("_med", "_dev", "_mad")


def delta_f(df: DataFrame, keys: list[str], f: str = "f", f0: str = "f0", background: float = 0.0) -> DataFrame:
    """(F - safe) / (safe - background), safe = max(F0, a tenth of F0's 5th percentile); the divisor keeps 1e-6 from zero."""
    low = F.percentile(f0, 0.05).over(W.partitionBy(*keys))
    df = df.withColumn("_safe", F.greatest(F.col(f0), 0.1 * low))
    d = F.col("_safe") - background
    d = F.when(F.abs(d) >= 1e-6, d).when(d < 0, -1e-6).otherwise(1e-6)
    return df.withColumn("dff", (F.col(f) - F.col("_safe")) / d).drop("_safe")


def linear_baseline(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Least-squares line through each series, as column f0."""
    by = W.partitionBy(*keys)
    mt, mv = F.avg(t).over(by), F.avg(v).over(by)
    df = df.withColumn("_mt", mt).withColumn("_mv", mv)
    slope = F.sum((F.col(t) - F.col("_mt")) * (F.col(v) - F.col("_mv"))).over(by) / F.nullif(F.sum((F.col(t) - F.col("_mt")) ** 2).over(by), F.lit(0.0))
    return df.withColumn("f0", F.col("_mv") + F.coalesce(slope, F.lit(0.0)) * (F.col(t) - F.col("_mt"))).drop("_mt", "_mv")


def region_linear(df: DataFrame, keys: list[str], start: int, end: int, window: int, t: str = "t", v: str = "v") -> DataFrame:
    """[start, end) replaced by a line from the mean of the window before to the mean of the window after, both ends included."""
    by = W.partitionBy(*keys)
    before = F.avg(F.when((F.col(t) >= start - window) & (F.col(t) < start), F.col(v))).over(by)
    after = F.avg(F.when((F.col(t) >= end) & (F.col(t) < end + window), F.col(v))).over(by)
    df = df.withColumn("_a", F.coalesce(before, after)).withColumn("_b", F.coalesce(after, before))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(t) - start) / float(max(1, end - start - 1))
    return df.withColumn("repaired", F.when((F.col(t) >= start) & (F.col(t) < end), line).otherwise(F.col(v))).drop("_a", "_b")


def normal_draw(seed: int, columns: list[str]) -> Column:
    """A standard normal number from a hash of the seed and the columns (Box-Muller)."""

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def region_normal(df: DataFrame, keys: list[str], start: int, end: int, window: int, seed: int = 0, noise: float = 1.0, t: str = "t", v: str = "v") -> DataFrame:
    """[start, end) drawn from the normal distribution of the windows around it (deviation of the population).

    The draw is a hash of seed, keys and time (Box-Muller), so it is the same at any partitioning.
    """
    by = W.partitionBy(*keys)
    near = ((F.col(t) >= start - window) & (F.col(t) < start)) | ((F.col(t) >= end) & (F.col(t) < end + window))
    around = F.when(near, F.col(v))

    drawn = F.avg(around).over(by) + noise * normal_draw(seed, [*keys, t]) * F.stddev_pop(around).over(by)
    return df.withColumn("repaired", F.when((F.col(t) >= start) & (F.col(t) < end), drawn).otherwise(F.col(v)))


def region_moving_average(df: DataFrame, keys: list[str], start: int, end: int, window: int, t: str = "t", v: str = "v") -> DataFrame:
    """[start, end) replaced by the mean of the samples outside it within window of each time."""
    outside = F.when((F.col(t) < start) | (F.col(t) >= end), F.col(v))
    mean = F.avg(outside).over(W.partitionBy(*keys).orderBy(t).rangeBetween(-window, window))
    return df.withColumn("repaired", F.when((F.col(t) >= start) & (F.col(t) < end), F.coalesce(mean, F.col(v))).otherwise(F.col(v)))


def region_weighted_average(df: DataFrame, keys: list[str], start: int, end: int, window: int, seed: int = 0, noise: float = 0.1, t: str = "t", v: str = "v") -> DataFrame:
    """[start, end) replaced by the means of both windows, weighted by place, plus a normal draw of noise times their difference.

    A side without values counts as 0; a single sample lies in the middle. Draws are hashes of seed, keys and time, as in region_normal().
    """
    by = W.partitionBy(*keys)
    before = F.coalesce(F.avg(F.when((F.col(t) >= start - window) & (F.col(t) < start), F.col(v))).over(by), F.lit(0.0))
    after = F.coalesce(F.avg(F.when((F.col(t) >= end) & (F.col(t) < end + window), F.col(v))).over(by), F.lit(0.0))
    df = df.withColumn("_a", before).withColumn("_b", after)
    right = (F.col(t) - start) / float(end - start - 1) if end - start > 1 else F.lit(0.5)
    drawn = noise * F.abs(F.col("_b") - F.col("_a")) * normal_draw(seed, [*keys, t])
    value = (1 - right) * F.col("_a") + right * F.col("_b") + drawn
    return df.withColumn("repaired", F.when((F.col(t) >= start) & (F.col(t) < end), value).otherwise(F.col(v))).drop("_a", "_b")


def waterfall(df: DataFrame, keys: list[str], rank: str, offset: float, v: str = "v") -> DataFrame:
    """Each trace lowered to zero and raised by offset times its rank."""
    return df.withColumn("shifted", F.col(v) - F.min(v).over(W.partitionBy(*keys)) + offset * F.col(rank))


def nearest_in_time(missing: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """For each missing (keys, t) the known time nearest to it, the earlier on ties. known: keys, t.

    The last known time before and the first after (the last in descending order) are window look-ups over the union: no pairs
    are formed. Without a known time it is null; repeated rows each come back.
    """
    both = missing.select(*keys, "t", F.lit(1).alias("_miss")).unionByName(known.select(*keys, "t", F.lit(0).alias("_miss")))
    at = F.when(F.col("_miss") == 0, F.col("t"))
    orders = (F.asc("t"), F.asc("_miss")), (F.desc("t"), F.asc("_miss"))
    lo, hi = (F.last(at, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*o).rowsBetween(W.unboundedPreceding, 0)) for o in orders)
    found = both.withColumn("_lo", lo).withColumn("_hi", hi).where("_miss = 1")
    near = F.when(F.col("_hi").isNull() | (F.col("t") - F.col("_lo") <= F.col("_hi") - F.col("t")), F.col("_lo")).otherwise(F.col("_hi"))
    return found.select(*keys, "t", F.coalesce(near, "_hi").alias("nearest_t"))
