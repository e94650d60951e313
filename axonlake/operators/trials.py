"""Array operators on packed trials (one row a trial, samples in an array): no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Samples of the stimulus that a segment holds, before scaling, whatever the interval's length.
STIMULUS_SAMPLES = 10


def mean_of(x: Column) -> Column:
    """Mean of an array's elements, null for none."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(x), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum_from(x: Column, lo: Column, n: int) -> Column:
    """Sum of n elements from lo on, by place: a slice would copy the whole array first, once for each block of it."""
    return F.aggregate(F.sequence(lo, lo + n - 1), F.lit(0.0), lambda a, j: a + F.get(x, j))


def span(x: Column, start: Column, end: Column) -> Column:
    """Elements [start, end) counted from 0, clamped to the array; empty where nothing is left."""
    lo = F.greatest(F.lit(0), start)
    n = F.greatest(F.lit(0), F.least(end, F.size(x)) - lo)
    return F.slice(x, (lo + 1).cast("int"), n.cast("int"))


def segment(trace: Column, start: Column, end: Column, pre: int = 5, post: int = 30, vps: int = 1) -> Column:
    """Struct of samples, onset and offset: [start - pre, start), a fixed stretch from start, [end, end + post)."""
    before = span(trace, start - pre * vps, start)
    during = span(trace, start, start + STIMULUS_SAMPLES * vps)
    after = span(trace, end, end + post * vps)
    onset = F.size(before)
    return F.struct(F.concat(before, during, after).alias("dff"), onset.alias("onset"), (onset + F.size(during)).alias("offset"))


def baseline_corrected(trace: Column, start: Column, pre: int = 5) -> Column:
    """Struct of the factor, the mean of up to pre samples before start, and the trace less it."""
    factor = F.coalesce(mean_of(span(trace, start - pre, start)), F.lit(0.0))
    return _let(factor, lambda f: F.struct(f.alias("factor"), F.transform(trace, lambda v: v - f).alias("corrected")))


def block_means(x: Column, v: int) -> Column:
    """Means of whole blocks of v; an array of v samples or fewer stays."""
    n = F.floor(F.size(x) / float(v)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _sum_from(x, i * v, v) / v)
    return F.when(F.size(x) <= v, x).otherwise(blocks)


def _ends_kept(x: Column, n: Column, inner) -> Column:
    """n values, the first and the last of x, inner(i) between."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, F.element_at(x, 1)).when(i == n - 1, F.element_at(x, -1)).otherwise(inner(i)))


def ends_preserved(x: Column, v: int) -> Column:
    """First and last sample as they are; between, means of scaled bins that stay v samples off the ends, else the line."""
    size = F.size(x)
    n = F.floor(size / float(v)).cast("int")

    def inner(i: Column) -> Column:
        lo = F.greatest(F.lit(v), F.floor(i * size / n).cast("int"))
        hi = F.least(size - v, F.floor((i + 1) * size / n).cast("int"))
        a = i / (n - 1)
        return F.when(hi > lo, mean_of(F.slice(x, lo + 1, F.greatest(hi - lo, F.lit(0))))).otherwise((1 - a) * F.element_at(x, 1) + a * F.element_at(x, -1))

    return F.when(size <= v, x).otherwise(_ends_kept(x, n, inner))


def ends_weighted(x: Column, v: int, weight: float = 1.5) -> Column:
    """Block means in which a block's first and last sample weigh more; first and last sample as they are."""
    n = F.floor(F.size(x) / float(v)).cast("int")
    # For v = 1 the one sample is both ends; its mean is itself.
    total = v + 2 * (weight - 1)

    def inner(i: Column) -> Column:
        plain = _sum_from(x, i * v, v)
        return plain if v == 1 else (plain + (weight - 1) * (F.get(x, i * v) + F.get(x, i * v + v - 1))) / total

    return F.when(F.size(x) <= v, x).otherwise(_ends_kept(x, n, inner))


def array_gradient(x: Column) -> Column:
    """W06 on an array of two samples or more."""
    n = F.size(x)
    return F.transform(
        x,
        lambda y, i: F.when(i == 0, F.get(x, F.lit(1)) - y).when(i == n - 1, y - F.get(x, i - 1)).otherwise((F.get(x, i + 1) - F.get(x, i - 1)) / 2),
    )


def array_quantile(x: Column, q: float) -> Column:
    """Linear quantile of an array's elements."""
    s = F.array_sort(x)
    at = (F.size(x) - 1) * q
    lo = F.floor(at).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(x) - 1))
    return a + (b - a) * (at - lo)


def change_adaptive(x: Column, v: int) -> Column:
    """Block means; a block of three samples or more with a steep change (over the 75th percentile) leans to its farther extreme."""
    n = F.floor(F.size(x) / float(v)).cast("int")

    def blocks(grad: Column, thr: Column) -> Column:
        def inner(i: Column) -> Column:
            block, steep = F.slice(x, i * v + 1, F.lit(v)), F.array_max(F.slice(grad, i * v + 1, F.lit(v)))
            m, hi, lo = mean_of(block), F.array_max(block), F.array_min(block)
            w = F.least(F.when(thr > 0, steep / (2 * thr)).otherwise(F.lit(1.0)), F.lit(1.0))
            far = F.when(F.abs(hi - m) > F.abs(lo - m), hi).otherwise(lo)
            return F.when((steep > thr) & F.lit(v >= 3), m * (1 - w) + far * w).otherwise(m)

        return _ends_kept(x, n, inner)

    steep = F.transform(array_gradient(x), lambda y: F.abs(y))
    return F.when(F.size(x) <= v, x).otherwise(_let(steep, lambda g: _let(array_quantile(g, 0.75), lambda q: blocks(g, q))))


METHODS = {"original": block_means, "preserve": ends_preserved, "weighted": ends_weighted, "adaptive": change_adaptive}


def pieces_downsampled(pre: Column, during: Column, post: Column, v: int, method: str = "preserve") -> Column:
    """Each piece downsampled alone; struct of the whole, onset, and the last sample of the stimulus (inclusive)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(sorted(METHODS))}")
    a, b, c = (F.when(F.size(p) == 0, p).otherwise(METHODS[method](p, v)) for p in (pre, during, post))
    return F.struct(F.concat(a, b, c).alias("dff"), F.size(a).alias("onset"), (F.size(a) + F.size(b) - 1).alias("last"))


def signed_peak(x: Column, start: int = 30, end: int = 180) -> Column:
    """Of the largest and smallest sample in [start, end) the one of larger size, the smallest on ties; 0 without samples."""
    part = span(x, F.lit(start), F.lit(end))
    hi, lo = F.array_max(part), F.array_min(part)
    return F.coalesce(F.when(F.abs(hi) > F.abs(lo), hi).otherwise(lo), F.lit(0.0))


def resampled(x: Column, points: Column) -> Column:
    """Linear samples at evenly spaced places from the first to the last; a single sample is repeated."""
    last = F.size(x) - 1

    def at(i: Column) -> Column:
        p = i * last / F.greatest(points - 1, F.lit(1))
        lo = F.floor(p).cast("int")
        a, b = F.get(x, lo), F.get(x, F.least(lo + 1, last))
        return a + (b - a) * (p - lo)

    return F.when((points > 0) & (F.size(x) > 0), F.transform(F.sequence(F.lit(0), F.greatest(points - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))


def long_view(trials: DataFrame, column: str = "dff", time: str = "time_point", value: str = "v") -> DataFrame:
    """A row for each sample, times from 0; other columns stay. Empty and null arrays give none.

    The plain generator would have its array tested for size below, which computes the array's expression again wherever that names it.
    """
    return trials.select(*[c for c in trials.columns if c != column], F.posexplode_outer(column).alias(time, value)).where(F.col(time).isNotNull())


def zscored(trials: DataFrame, group_size: int | None = None, keys: tuple[str, ...] = ("worm", "neuron"), order: str = "segment_index", column: str = "dff") -> DataFrame:
    """Z by mean and sample deviation over all samples of the keys, or of each group_size trials in a row; deviation 0 counts as 1.

    Sums are taken for each trial first, so that the shuffle moves a few numbers a trial and its array once.
    """
    x = F.col(column)
    parts = [*keys]
    if group_size:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
        trials = trials.withColumn("_part", F.floor(rank / float(group_size)))
        parts.append("_part")
    by = W.partitionBy(*parts)
    n = F.sum(F.size(x)).over(by)
    trials = trials.withColumn("_n", n).withColumn("mu", F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).over(by) / F.nullif(n, F.lit(0)))
    mu = F.col("mu")
    ss = F.sum(F.aggregate(F.transform(x, lambda v: (v - mu) * (v - mu)), F.lit(0.0), lambda a, v: a + v)).over(by)
    sd = F.sqrt(ss / F.nullif(F.col("_n") - 1, F.lit(0)))
    trials = trials.withColumn("sd", F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    d = F.col("sd")
    return trials.withColumn("z", F.transform(x, lambda v: (v - mu) / d)).drop("_n", "_part")
