"""Queries on trials: arrays, responses, pairs, kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from axonlake.operators import demixing as dm
from axonlake.operators import fits as ft
from axonlake.operators import intervals as iv
from axonlake.operators import kernels as kn
from axonlake.operators.objects import kept
from axonlake.operators import pairs as pr
from axonlake.operators import recordings as rc
from axonlake.operators import responses as rs
from axonlake.operators import trials as tr
from axonlake.operators import warping as wp

from .views import LOG, LONG, PEAKS, RUNS, TRIALS, long, peaks, query, r6, r6_pairs, table, trials

GROUP = ["neuron", "stimulus"]


def _rounded(c):
    return F.transform(c, lambda v: F.round(v, 6) + F.lit(0.0))


# ---------------------------------------------------------------- arrays


@query(
    f"""WITH {TRIALS} SELECT trial, list_transform(list_concat(dff[greatest(start_time - 5, 0) + 1 : start_time], dff[start_time + 1 : start_time + 10], dff[start_time + 13 : start_time + 42]), lambda v: round(v, 6) + 0) AS dff,
CAST(least(start_time, 5) AS INT) AS onset, CAST(least(start_time, 5) + 10 AS INT) AS "offset" FROM trials"""
)
def trial_segments(spark, d):
    s = F.col("start_time")
    out = trials(spark, d).select("trial", tr.segment(F.col("dff"), s, s + 12).alias("s"))
    return out.select("trial", _rounded(F.col("s.dff")).alias("dff"), F.col("s.onset").alias("onset"), F.col("s.offset").alias("offset"))


@query(
    f"""WITH {TRIALS}, b AS (SELECT *, coalesce(list_avg(dff[greatest(start_time - 5, 0) + 1 : start_time]), 0) AS f FROM trials)
SELECT trial, round(f, 6) AS factor, list_transform(dff, lambda v: round(v - f, 6) + 0) AS corrected FROM b"""
)
def baseline_corrected(spark, d):
    out = trials(spark, d).select("trial", tr.baseline_corrected(F.col("dff"), F.col("start_time")).alias("b"))
    return out.select("trial", r6(F.col("b.factor"), "factor"), _rounded(F.col("b.corrected")).alias("corrected"))


@query(f"WITH {LONG} SELECT neuron, stimulus, worm, date, segment_index, trial, CAST(t AS INT) AS t, CAST(t - start_time AS INT) AS relative_t, round(v, 6) AS v FROM long")
def trials_long(spark, d):
    return long(spark, d).select("neuron", "stimulus", "worm", "date", "segment_index", "trial", "t", (F.col("t") - F.col("start_time")).alias("relative_t"), r6(F.col("v"), "v"))


@query(f"""WITH {LONG} SELECT date, worm, segment_index, {', '.join(f'round(avg(CASE WHEN t = {t} THEN v END), 6) AS t{t}' for t in range(64))} FROM long GROUP BY ALL""")
def trials_pivot(spark, d):
    at = list(range(64))
    p = long(spark, d).groupBy("date", "worm", "segment_index").pivot("t", at).agg(F.avg("v"))
    return p.select("date", "worm", "segment_index", *[r6(F.col(str(t)), f"t{t}") for t in at])


@query(f"WITH {TRIALS} SELECT trial, list_transform(range(12), lambda i: round(list_avg(dff[i * 5 + 1 : i * 5 + 5]), 6) + 0) AS dff FROM trials")
def downsample_block(spark, d):
    return trials(spark, d).select("trial", _rounded(tr.block_means(F.col("dff"), 5)).alias("dff"))


@query(
    f"""WITH {TRIALS} SELECT trial, list_transform(range(12), lambda i: round(CASE WHEN i = 0 THEN dff[1] WHEN i = 11 THEN dff[64]
ELSE list_avg(dff[greatest(5, i * 64 // 12) + 1 : least(59, (i + 1) * 64 // 12)]) END, 6) + 0) AS dff FROM trials"""
)
def downsample_preserve(spark, d):
    return trials(spark, d).select("trial", _rounded(tr.ends_preserved(F.col("dff"), 5)).alias("dff"))


@query(
    f"""WITH {TRIALS} SELECT trial, list_transform(range(12), lambda i: round(CASE WHEN i = 0 THEN dff[1] WHEN i = 11 THEN dff[64]
ELSE (list_sum(dff[i * 5 + 1 : i * 5 + 5]) + 0.5 * (dff[i * 5 + 1] + dff[i * 5 + 5])) / 6 END, 6) + 0) AS dff FROM trials"""
)
def downsample_weighted(spark, d):
    return trials(spark, d).select("trial", _rounded(tr.ends_weighted(F.col("dff"), 5)).alias("dff"))


@query(
    f"""WITH {TRIALS}, g AS (SELECT trial, dff, list_transform(range(64), lambda i: abs(CASE WHEN i = 0 THEN dff[2] - dff[1] WHEN i = 63 THEN dff[64] - dff[63] ELSE (dff[i + 2] - dff[i]) / 2 END)) AS g FROM trials),
q AS (SELECT trial, quantile_cont(x, 0.75) AS thr FROM (SELECT trial, unnest(g) AS x FROM g) GROUP BY trial),
b AS (SELECT trial, i, dff[i * 5 + 1 : i * 5 + 5] AS blk, list_max(g[i * 5 + 1 : i * 5 + 5]) AS steep, thr, dff[1] AS head, dff[64] AS tail FROM g JOIN q USING (trial), range(12) r(i)),
w AS (SELECT *, list_avg(blk) AS m, list_max(blk) AS hi, list_min(blk) AS lo, least(steep / (2 * thr), 1) AS k FROM b)
SELECT trial, list(round(CASE WHEN i = 0 THEN head WHEN i = 11 THEN tail WHEN steep > thr THEN m * (1 - k) + k * CASE WHEN abs(hi - m) > abs(lo - m) THEN hi ELSE lo END ELSE m END, 6) + 0 ORDER BY i) AS dff FROM w GROUP BY trial"""
)
def downsample_adaptive(spark, d):
    return trials(spark, d).select("trial", _rounded(tr.change_adaptive(F.col("dff"), 5)).alias("dff"))


@query(
    f"""WITH {TRIALS}, p AS (SELECT trial, dff[1:5] AS a, dff[6:15] AS b, dff[16:64] AS c FROM trials)
SELECT trial, list_transform(list_concat(a, list_transform(range(2), lambda i: list_avg(b[i * 5 + 1 : i * 5 + 5])), list_transform(range(9), lambda i: list_avg(c[i * 5 + 1 : i * 5 + 5]))), lambda v: round(v, 6) + 0) AS dff,
5 AS onset, 6 AS last FROM p"""
)
def downsample_pieces(spark, d):
    x = F.col("dff")
    parts = [tr.span(x, F.lit(a), F.lit(b)) for a, b in ((0, 5), (5, 15), (15, 64))]
    out = trials(spark, d).select("trial", tr.pieces_downsampled(*parts, 5, "original").alias("p"))
    return out.select("trial", _rounded(F.col("p.dff")).alias("dff"), F.col("p.onset").alias("onset"), F.col("p.last").alias("last"))


@query(
    f"""WITH {TRIALS} SELECT trial, list_transform(range(40), lambda i: round(dff[CAST(floor(i * 63 / 39.0) AS INT) + 1] + (dff[least(CAST(floor(i * 63 / 39.0) AS INT) + 2, 64)] - dff[CAST(floor(i * 63 / 39.0) AS INT) + 1])
* (i * 63 / 39.0 - floor(i * 63 / 39.0)), 6) + 0) AS dff FROM trials"""
)
def resample_grid(spark, d):
    return trials(spark, d).select("trial", _rounded(tr.resampled(F.col("dff"), F.lit(40))).alias("dff"))


@query(
    f"""WITH {TRIALS}, p AS (SELECT trial, dff[1:5] AS a, dff[6:15] AS b, dff[16:64] AS c FROM trials),
g AS (SELECT trial, a, b, c, list_transform(range(49), lambda i: abs(CASE WHEN i = 0 THEN c[2] - c[1] WHEN i = 48 THEN c[49] - c[48] ELSE (c[i + 2] - c[i]) / 2 END)) AS g FROM p),
q AS (SELECT trial, quantile_cont(x, 0.75) AS thr FROM (SELECT trial, unnest(g) AS x FROM g) GROUP BY trial),
k AS (SELECT trial, i, c[i * 5 + 1 : i * 5 + 5] AS blk, list_max(g[i * 5 + 1 : i * 5 + 5]) AS steep, thr, c[1] AS head, c[49] AS tail, a, b FROM g JOIN q USING (trial), range(9) r(i)),
w AS (SELECT *, list_avg(blk) AS m, list_max(blk) AS hi, list_min(blk) AS lo, least(steep / (2 * thr), 1) AS part FROM k),
o AS (SELECT trial, any_value(a) AS a, any_value(b) AS b, list(CASE WHEN i = 0 THEN head WHEN i = 8 THEN tail WHEN steep > thr THEN m * (1 - part) + part * CASE WHEN abs(hi - m) > abs(lo - m) THEN hi ELSE lo END ELSE m END ORDER BY i) AS c FROM w GROUP BY trial)
SELECT trial, list_transform(list_concat(a, [b[1], b[10]], c), lambda v: round(v, 6) + 0) AS dff, 5 AS onset, 6 AS last FROM o"""
)
def downsample_pieces_adaptive(spark, d):
    x = F.col("dff")
    parts = [tr.span(x, F.lit(a), F.lit(b)) for a, b in ((0, 5), (5, 15), (15, 64))]
    out = trials(spark, d).select("trial", tr.pieces_downsampled(*parts, 5, "adaptive").alias("p"))
    return out.select("trial", _rounded(F.col("p.dff")).alias("dff"), F.col("p.onset").alias("onset"), F.col("p.last").alias("last"))


ZSCORE = "round(avg(v) OVER w, 6) AS mu, round(coalesce(nullif(stddev_samp(v) OVER w, 0), 1), 6) AS sd, round((v - avg(v) OVER w) / coalesce(nullif(stddev_samp(v) OVER w, 0), 1), 5) + 0 AS z"


def _z(df):
    return df.select("trial", r6(F.col("mu"), "mu"), r6(F.col("sd"), "sd"), F.posexplode("z").alias("t", "z")).withColumn("z", F.round("z", 5) + F.lit(0.0))


@query(f"WITH {LONG} SELECT trial, CAST(t AS INT) AS t, {ZSCORE} FROM long WINDOW w AS (PARTITION BY worm, neuron)")
def zscore_trials(spark, d):
    return _z(tr.zscored(trials(spark, d)))


@query(
    f"WITH {LONG}, n AS (SELECT trial, (row_number() OVER (PARTITION BY worm, neuron ORDER BY segment_index) - 1) // 3 AS g FROM trials) SELECT trial, CAST(t AS INT) AS t, {ZSCORE} FROM long JOIN n USING (trial) WINDOW w AS (PARTITION BY worm, neuron, g)"
)
def zscore_grouped(spark, d):
    return _z(tr.zscored(trials(spark, d), group_size=3))


# ---------------------------------------------------------------- responses

STATS = "round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n"


def _stats(df, keys):
    return df.select(*keys, r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"), "n")


@query(f"WITH {LONG} SELECT neuron, stimulus, CAST(t AS INT) AS t, {STATS} FROM long GROUP BY neuron, stimulus, t")
def mean_sem_trace(spark, d):
    return _stats(rs.mean_sem(long(spark, d), [*GROUP, "t"]), [*GROUP, "t"])


SHORT = f"{LONG}, cut AS (SELECT * FROM long WHERE t < 64 - trial % 4), short AS (SELECT * FROM cut QUALIFY t < 64 - max(trial % 4) OVER (PARTITION BY neuron, stimulus))"


@query(f"WITH {SHORT} SELECT neuron, stimulus, CAST(t AS INT) AS t, {STATS} FROM short GROUP BY neuron, stimulus, t")
def mean_sem_minlen(spark, d):
    t = trials(spark, d).withColumn("dff", F.slice("dff", F.lit(1), (64 - F.col("trial") % 4).cast("int")))
    return _stats(rs.mean_sem(tr.long_view(rs.cut_to_shortest(t, GROUP), time="t"), [*GROUP, "t"]), [*GROUP, "t"])


@query(f"WITH {PEAKS} SELECT neuron, stimulus, round(v, 6) AS v FROM peaks")
def signed_peak(spark, d):
    return peaks(spark, d).select(*GROUP, r6(F.col("v"), "v"))


MATRIX = PEAKS + ", matrix AS (SELECT n.neuron, s.stimulus, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT neuron FROM peaks) n CROSS JOIN (SELECT DISTINCT stimulus FROM peaks) s LEFT JOIN peaks p USING (neuron, stimulus))"


def _matrix(spark, d):
    return rs.dense(peaks(spark, d), *GROUP)


@query(f"WITH {MATRIX} SELECT neuron, stimulus, round(v, 6) AS v FROM matrix")
def peak_matrix(spark, d):
    return _matrix(spark, d).select(*GROUP, r6(F.col("v"), "v"))


@query(f"WITH {MATRIX} SELECT neuron, split_part(stimulus, '_', 1) AS compound, round(avg(v), 6) AS v FROM matrix GROUP BY ALL")
def compound_mean(spark, d):
    return rs.compound_means(_matrix(spark, d)).select("neuron", "compound", r6(F.col("v"), "v"))


@query(f"""WITH {MATRIX} SELECT neuron, {', '.join(f"round(avg(CASE WHEN stimulus = 'c2_{k}' THEN v END), 6) AS c2_{k}" for k in (1, 2, 3))} FROM matrix WHERE split_part(stimulus, '_', 1) = 'c2' GROUP BY neuron""")
def dilution_table(spark, d):
    one = _matrix(spark, d).where(rs.compound_of(F.col("stimulus")) == "c2")
    p = one.groupBy("neuron").pivot("stimulus", ["c2_1", "c2_2", "c2_3"]).agg(F.avg("v"))
    return p.select("neuron", *[r6(F.col(c), c) for c in ("c2_1", "c2_2", "c2_3")])


@query(f"WITH {MATRIX} SELECT neuron, stimulus, round(coalesce(v / nullif(max(abs(v)) OVER (PARTITION BY neuron), 0), 0), 6) AS normalised FROM matrix")
def max_norm(spark, d):
    return rs.max_normalised(_matrix(spark, d)).select(*GROUP, r6(F.col("normalised"), "normalised"))


@query(
    f"""WITH {MATRIX}, a AS (SELECT neuron, stimulus, abs(v) AS v, split_part(stimulus, '_', 1) AS compound FROM matrix)
SELECT neuron, stimulus, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END, 6) AS share FROM a WINDOW w AS (PARTITION BY compound)"""
)
def sum_norm(spark, d):
    m = _matrix(spark, d).withColumn("v", F.abs("v")).withColumn("compound", rs.compound_of(F.col("stimulus")))
    return rs.sum_normalised(m).select(*GROUP, r6(F.col("share"), "share"))


@query(f"WITH {TRIALS} SELECT stimulus, count(DISTINCT neuron) AS n FROM trials GROUP BY stimulus ORDER BY n DESC, stimulus LIMIT 1")
def widest_stimulus(spark, d):
    return trials(spark, d).groupBy("stimulus").agg(F.countDistinct("neuron").alias("n")).orderBy(F.desc("n"), "stimulus").limit(1)


DENSE = f"{LONG}, mean AS (SELECT neuron, stimulus, t, avg(v) AS v FROM long GROUP BY ALL), tensor AS (SELECT n.neuron, s.stimulus, u.t, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT neuron FROM mean) n CROSS JOIN (SELECT DISTINCT stimulus FROM mean) s CROSS JOIN (SELECT DISTINCT t FROM mean) u LEFT JOIN mean m USING (neuron, stimulus, t))"


def _tensor(spark, d):
    m = long(spark, d).groupBy("neuron", "stimulus", "t").agg(F.avg("v").alias("v"))
    every = m.select("neuron").distinct().crossJoin(m.select("stimulus").distinct()).crossJoin(m.select("t").distinct())
    return every.join(m, ["neuron", "stimulus", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


@query(f"WITH {DENSE} SELECT neuron, stimulus, CAST(t AS INT) AS t, round(v, 6) AS v FROM tensor")
def tensor_mean(spark, d):
    return _tensor(spark, d).select("neuron", "stimulus", "t", r6(F.col("v"), "v"))


@query(
    f"""WITH {DENSE} SELECT neuron, stimulus, CAST(t AS INT) AS t, round(avg(v) OVER nt - avg(v) OVER n, 6) + 0 AS m_t, round(avg(v) OVER ns - avg(v) OVER n, 6) + 0 AS m_s,
round(v - avg(v) OVER nt - avg(v) OVER ns + avg(v) OVER n, 6) + 0 AS m_st FROM tensor WINDOW n AS (PARTITION BY neuron), ns AS (PARTITION BY neuron, stimulus), nt AS (PARTITION BY neuron, t)"""
)
def dpca_marginals(spark, d):
    return rs.marginals(_tensor(spark, d)).select("neuron", "stimulus", "t", *[r6(F.col(c), c) for c in ("m_t", "m_s", "m_st")])


@query(
    f"""WITH {LONG}, ids AS (SELECT DISTINCT stimulus, worm || '_' || segment_index || '_' || date AS id FROM trials), own AS (SELECT stimulus, worm || '_' || segment_index || '_' || date AS id, neuron, t, avg(v) AS v FROM long GROUP BY ALL),
every AS (SELECT i.stimulus, i.id, n.neuron, u.t, coalesce(o.v, 0) AS v FROM ids i CROSS JOIN (SELECT DISTINCT neuron FROM own) n CROSS JOIN range(64) u(t) LEFT JOIN own o ON o.stimulus = i.stimulus AND o.id = i.id AND o.neuron = n.neuron AND o.t = u.t)
SELECT stimulus, neuron, CAST(t AS INT) AS t, {STATS} FROM every GROUP BY stimulus, neuron, t"""
)
def averaged_responses(spark, d):
    """Mean over trials in which a neuron that is missing counts as zeros: trials x neurons x times without forming that product.

    The missing trials add zeros to the sums, so only their number is needed.
    """
    t = long(spark, d).withColumn("id", rs.trial_id())
    own = t.groupBy("stimulus", "id", "neuron", "t").agg(F.avg("v").alias("v"))
    n = t.groupBy("stimulus").agg(F.countDistinct("id").alias("n"))
    sums = own.groupBy("stimulus", "neuron", "t").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    names = t.select("neuron").distinct()
    every = n.crossJoin(names).crossJoin(t.select("t").distinct()).join(sums, ["stimulus", "neuron", "t"], "left")
    s, q = F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest((q - s * s / F.col("n")) / (F.col("n") - 1), F.lit(0.0))))
    return _stats(every.withColumn("mean", s / F.col("n")).withColumn("sem", sd / F.sqrt("n")), ["stimulus", "neuron", "t"])


@query(f"WITH {LONG}, m AS (SELECT neuron, t, avg(v) AS v FROM long WHERE stimulus = 'c1_1' GROUP BY ALL) PIVOT m ON t IN ({', '.join(map(str, range(64)))}) USING round(avg(v), 6) GROUP BY neuron".replace("PIVOT m ON", "SELECT * FROM (PIVOT m ON") + ")")
def pivot_mean(spark, d):
    at = list(range(64))
    p = long(spark, d).where("stimulus = 'c1_1'").groupBy("neuron").pivot("t", at).agg(F.avg("v"))
    return p.select("neuron", *[r6(F.col(str(t)), str(t)) for t in at])


COV = f"WITH {LONG}, m AS (SELECT neuron, t, avg(v) AS v FROM long GROUP BY ALL) SELECT x.neuron AS a, y.neuron AS b, "


@query(COV + "round(covar_samp(x.v, y.v), 6) + 0 AS cov, round(corr(x.v, y.v), 6) + 0 AS corr FROM m x JOIN m y USING (t) GROUP BY ALL")
def covariance_matrix(spark, d):
    m = long(spark, d).groupBy("neuron", "t").agg(F.avg("v").alias("v"))
    return rs.covariances(m, "neuron", ["t"]).select("a", "b", r6(F.col("cov"), "cov"), r6(F.col("corr"), "corr"))


@query(
    f"""WITH {LONG}, m AS (SELECT neuron, t, avg(v) AS v FROM long GROUP BY ALL), s AS (SELECT neuron, t, (v - avg(v) OVER w) / greatest(avg(v) OVER w, 1) AS x FROM m WINDOW w AS (PARTITION BY neuron)),
c AS (SELECT p.neuron AS a, q.neuron AS b, l.lag, sum(p.x * q.x) AS c FROM s p CROSS JOIN range(-10, 11) l(lag) JOIN s q ON p.t = q.t + l.lag WHERE p.neuron <= q.neuron GROUP BY ALL)
SELECT a, b, round(c, 6) + 0 AS corr, CAST(lag AS INT) AS lag FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(c), 9) DESC, lag) = 1"""
)
def xcorr_peak_lag(spark, d):
    m = long(spark, d).groupBy("neuron", "t").agg(F.avg("v").alias("v"))
    return rs.cross_correlation_peaks(m, "neuron", []).select("a", "b", r6(F.col("corr"), "corr"), "lag")


@query(
    f"""WITH {TRIALS}, e AS (SELECT neuron, list_min(dff) AS lo, list_max(dff) AS hi FROM trials), q AS (SELECT neuron, quantile_cont(lo, 0.05) AS lo, quantile_cont(hi, 0.95) AS hi FROM e GROUP BY neuron)
SELECT neuron, round(lo - 0.15 * (hi - lo), 6) AS lo, round(hi + 0.15 * (hi - lo), 6) AS hi FROM q"""
)
def y_range(spark, d):
    e = trials(spark, d).groupBy("neuron").agg(F.percentile(F.array_min("dff"), 0.05).alias("lo"), F.percentile(F.array_max("dff"), 0.95).alias("hi"))
    pad = 0.15 * (F.col("hi") - F.col("lo"))
    return e.select("neuron", r6(F.col("lo") - pad, "lo"), r6(F.col("hi") + pad, "hi"))


@query(f"WITH {TRIALS} SELECT split_part(stimulus, '_', 1) AS compound, list(stimulus ORDER BY CAST(split_part(stimulus, '_', 2) AS INT)) AS stimuli FROM (SELECT DISTINCT stimulus FROM trials) GROUP BY ALL")
def compound_groups(spark, d):
    s = trials(spark, d).select("stimulus").distinct()
    g = s.groupBy(rs.compound_of(F.col("stimulus")).alias("compound")).agg(F.array_sort(F.collect_list(F.struct(rs.order_of(F.col("stimulus")).alias("o"), "stimulus"))).alias("x"))
    return g.select("compound", F.col("x.stimulus").alias("stimuli"))


@query(
    f"""WITH {TRIALS} SELECT s.stimulus AS code, coalesce(name, stimulus) AS name, coalesce(color, '#000000') AS color FROM (SELECT DISTINCT stimulus FROM trials) s
LEFT JOIN (VALUES ('c1_1', 'NaCl 100mM', '#1f77b4'), ('c1_2', 'NaCl 50mM', '#ff7f0e'), ('c2_1', 'Diacetyl E4', '#2ca02c')) AS m(code, name, color) ON s.stimulus = m.code"""
)
def compound_summary(spark, d):
    m = spark.sql("SELECT * FROM VALUES ('c1_1', 'NaCl 100mM', '#1f77b4'), ('c1_2', 'NaCl 50mM', '#ff7f0e'), ('c2_1', 'Diacetyl E4', '#2ca02c') AS m(code, name, color)")
    s = trials(spark, d).select(F.col("stimulus").alias("code")).distinct().join(F.broadcast(m), "code", "left")
    return s.select("code", F.coalesce("name", "code").alias("name"), F.coalesce("color", F.lit("#000000")).alias("color"))


@query(f"WITH {TRIALS} SELECT stimulus, count(*) AS n FROM trials GROUP BY ALL")
def value_counts(spark, d):
    return trials(spark, d).groupBy("stimulus").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pairs of sides, sets


@query(
    f"""WITH {MATRIX}, b AS (SELECT *, CASE WHEN regexp_matches(neuron, '^.+[LR]$') THEN left(neuron, length(neuron) - 1) ELSE neuron END AS base FROM matrix),
n AS (SELECT base, count(DISTINCT neuron) AS k FROM b GROUP BY base)
SELECT CASE WHEN k > 1 THEN base ELSE neuron END AS neuron, stimulus, round(avg(v), 6) AS v FROM b JOIN n USING (base) GROUP BY ALL"""
)
def lr_combine_matrix(spark, d):
    return rs.sides_averaged(_matrix(spark, d), ["stimulus"]).select("neuron", "stimulus", r6(F.col("v"), "v"))


MERGE = """s AS (SELECT *, CASE WHEN neuron NOT IN ('ASEL', 'ASER') AND regexp_matches(neuron, '^.+[LR]$') THEN right(neuron, 1) END AS side FROM trials),
b AS (SELECT *, CASE WHEN side IS NOT NULL THEN left(neuron, length(neuron) - 1) ELSE neuron END AS base, row_number() OVER (PARTITION BY neuron, stimulus ORDER BY date, worm, segment_index, trial) AS ordinal FROM s),
k AS (SELECT base, stimulus, count(DISTINCT side) AS sides FROM b GROUP BY ALL),
j AS (SELECT l.base AS neuron, l.stimulus, l.ordinal, list_transform(range(least(len(l.dff), len(r.dff))), lambda i: (l.dff[i + 1] + r.dff[i + 1]) / 2) AS dff
FROM b l JOIN b r ON l.base = r.base AND l.stimulus = r.stimulus AND l.ordinal = r.ordinal AND l.side = 'L' AND r.side = 'R'
UNION ALL SELECT b.base, b.stimulus, b.ordinal, b.dff FROM b JOIN k USING (base, stimulus) WHERE k.sides < 2)"""


@query(f"WITH {TRIALS}, {MERGE} SELECT neuron, stimulus, ordinal, list_transform(dff, lambda v: round(v, 6) + 0) AS dff FROM j")
def lr_merge_trials(spark, d):
    m = rs.sides_merged(trials(spark, d))
    return m.select("neuron", "stimulus", F.col("ordinal").cast("long").alias("ordinal"), _rounded(F.col("dff")).alias("dff"))


HOLES = PEAKS.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 11 <> 0 AND NOT ((vec_id // 10) % 8 = 1 AND label < 5)") + ", matrix AS (SELECT n.neuron, s.stimulus, p.v FROM (SELECT DISTINCT neuron FROM peaks) n CROSS JOIN (SELECT DISTINCT stimulus FROM peaks) s LEFT JOIN peaks p USING (neuron, stimulus))"


def _holes(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 11 <> 0 AND NOT (floor(vec_id / 10) % 8 = 1 AND label < 5)")
    t = trials(spark, d).join(e.select(F.col("vec_id").alias("trial")), "trial", "left_semi")
    p = t.groupBy("neuron", "stimulus").agg(F.avg(tr.signed_peak(F.col("dff"))).alias("v"))
    every = p.select("neuron").distinct().crossJoin(p.select("stimulus").distinct())
    return every.join(p, GROUP, "left")


@query(
    f"""WITH {HOLES}, m AS (SELECT *, CASE WHEN neuron LIKE '%L' THEN left(neuron, length(neuron) - 1) || 'R' WHEN neuron LIKE '%R' THEN left(neuron, length(neuron) - 1) || 'L' ELSE neuron END AS mirror FROM matrix)
SELECT m.neuron, m.stimulus, round(coalesce(m.v, CASE WHEN m.mirror <> m.neuron THEN o.v END, 0), 6) AS filled FROM m LEFT JOIN matrix o ON o.neuron = m.mirror AND o.stimulus = m.stimulus"""
)
def mirror_fill(spark, d):
    return rs.mirror_filled(_holes(spark, d)).select("neuron", "stimulus", r6(F.col("filled"), "filled"))


@query(f"WITH {TRIALS} SELECT t.trial FROM trials t WHERE neuron IN ('AVA', 'ASEL') AND worm NOT IN ('w3') AND NOT regexp_matches(neuron, '^[0-9]+$')")
def select_neurons(spark, d):
    names = spark.sql("SELECT * FROM VALUES ('AVA'), ('ASEL') AS n(neuron)")
    out = spark.sql("SELECT * FROM VALUES ('w3') AS w(worm)")
    return rs.without(rs.only(rs.identified(trials(spark, d)), F.broadcast(names), ["neuron"]), F.broadcast(out), ["worm"]).select("trial")


@query(
    f"""WITH {TRIALS} SELECT trial, worm || '_' || segment_index || '_' || date AS id FROM trials WHERE NOT (neuron = 'ASHL' AND stimulus = 'c1_1' AND segment_index % 2 = 0)"""
)
def drop_trials(spark, d):
    t = trials(spark, d).withColumn("id", rs.trial_id())
    bad = t.where("neuron = 'ASHL' AND stimulus = 'c1_1' AND segment_index % 2 = 0").select("neuron", "stimulus", "id")
    return rs.without(t, bad, ["neuron", "stimulus", "id"]).select("trial", "id")


@query(f"WITH {TRIALS} SELECT neuron, stimulus, date, count(*) AS n FROM (SELECT * FROM trials WHERE date = '20250101' UNION ALL SELECT * FROM trials WHERE date = '20250202') GROUP BY ALL")
def union_dates(spark, d):
    t = trials(spark, d)
    both = t.where("date = '20250101'").unionByName(t.where("date = '20250202'"), allowMissingColumns=True)
    return both.groupBy("neuron", "stimulus", "date").agg(F.count("*").alias("n"))


@query(
    f"""WITH {TRIALS}, l AS (SELECT DISTINCT stimulus FROM trials WHERE neuron = 'ASHL'), r AS (SELECT DISTINCT stimulus FROM trials WHERE neuron = 'ASHR')
SELECT stimulus, 'both' AS side FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT stimulus, 'left' FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT stimulus, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""
)
def stimuli_of_sides(spark, d):
    t = trials(spark, d)
    left, right = (t.where(F.col("neuron") == n).select("stimulus").distinct() for n in ("ASHL", "ASHR"))
    parts = [left.intersect(right).withColumn("side", F.lit("both")), left.subtract(right).withColumn("side", F.lit("left")), right.subtract(left).withColumn("side", F.lit("right"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {TRIALS} SELECT row_number() OVER (ORDER BY stimulus) - 1 AS place, stimulus FROM (SELECT DISTINCT stimulus FROM trials)")
def ordered_distinct(spark, d):
    s = trials(spark, d).select("stimulus").distinct()
    listed = s.agg(F.array_sort(F.collect_list("stimulus")).alias("x"))
    return listed.select(F.posexplode("x").alias("place", "stimulus")).withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------- kernels


def _edges(spark, d):
    return kn.dtw_distances(trials(spark, d), GROUP)


#: The warping table row by row, for all pairs of a group; and the clusters of density 2 as what near pairs connect.
DTW = f"""WITH RECURSIVE {TRIALS}, p AS (SELECT a.neuron, a.stimulus, a.trial AS i, b.trial AS j, a.dff AS x, b.dff AS y FROM trials a JOIN trials b ON a.neuron = b.neuron AND a.stimulus = b.stimulus AND a.trial < b.trial),
steps AS (SELECT i, j, 0 AS n, [0.0::DOUBLE] || list_transform(y, lambda v: 'inf'::DOUBLE) AS r FROM p
UNION ALL SELECT i, j, n + 1, list_reduce(list_zip(y, r[2:], r[:-2]), lambda done, q: list_append(done, abs(x[n + 1] - q[1]) + least(q[2], q[3], done[-1])), ['inf'::DOUBLE]) FROM steps JOIN p USING (i, j) WHERE n < len(x)),
e AS (SELECT neuron, stimulus, i, j, r[-1] AS dist FROM steps JOIN p USING (i, j) WHERE n = len(x))"""
LABELS = f"""{DTW}, near AS (SELECT i, j FROM e WHERE dist <= 4.5 UNION ALL SELECT j, i FROM e WHERE dist <= 4.5),
reach AS (SELECT i AS item, i AS r FROM near UNION SELECT reach.item, near.j FROM reach JOIN near ON reach.r = near.i),
clusters AS (SELECT item, min(r) AS c FROM reach GROUP BY item),
ranked AS (SELECT t.trial AS item, dense_rank() OVER (PARTITION BY neuron, stimulus ORDER BY c) - 1 AS label FROM trials t JOIN clusters ON item = t.trial)"""


@query(f"{DTW} SELECT neuron, stimulus, i, j, round(dist, 6) AS dist FROM e")
def dtw_pairs(spark, d):
    return _edges(spark, d).select(*GROUP, "i", "j", r6_pairs(F.col("dist"), "dist"))


L1 = f"""WITH {TRIALS}, e AS (SELECT a.neuron, a.stimulus, a.trial AS i, b.trial AS j, list_sum(list_transform(list_zip(a.dff, b.dff), lambda p: abs(p[1] - p[2]))) AS dist
FROM trials a JOIN trials b ON a.neuron = b.neuron AND a.stimulus = b.stimulus AND a.trial < b.trial)"""


@query(f"{L1} SELECT neuron, stimulus, i, j, round(dist, 6) AS dist FROM e")
def trial_distances(spark, d):
    return pr.l1_distances(trials(spark, d), GROUP).select(*GROUP, "i", "j", r6_pairs(F.col("dist"), "dist"))


@query(
    f"""{L1}, n AS (SELECT neuron, stimulus, i, j FROM e WHERE dist <= 7.5 UNION ALL SELECT neuron, stimulus, j, i FROM e WHERE dist <= 7.5),
c AS (SELECT t.trial AS item, t.neuron, t.stimulus, count(n.i) >= 2 AS is_core FROM trials t LEFT JOIN n ON n.i = t.trial GROUP BY t.trial, t.neuron, t.stimulus)
SELECT c.neuron, c.stimulus, c.item, c.is_core, NOT c.is_core AND NOT coalesce(bool_or(k.is_core), false) AS is_noise FROM c LEFT JOIN n ON n.i = c.item LEFT JOIN c k ON k.item = n.j GROUP BY c.neuron, c.stimulus, c.item, c.is_core"""
)
def dbscan_noise(spark, d):
    t = trials(spark, d)
    near = pr.l1_neighbours(t, GROUP, 7.5, kn.most_of_sparse(3))
    return kn.noise_of_neighbours(near, t.select(*GROUP, F.col("trial").alias("item")), GROUP, 3)


@query(f"{DTW} SELECT neuron, stimulus, i, j, round(dist, 6) AS dist FROM e WHERE dist <= 4.5")
def dtw_near_pairs(spark, d):
    """A16 under a radius."""
    return wp.near_pairs(trials(spark, d), GROUP, 4.5).select(*GROUP, "i", "j", r6_pairs(F.col("dist"), "dist"))


def _labels(spark, d):
    t = trials(spark, d)
    return t, kn.warped_clusters(t, GROUP, 4.5)


@query(f"{LABELS} SELECT neuron, stimulus, trial AS item, CAST(coalesce(label, -1) AS INT) AS label, label IS NULL AS is_noise FROM trials LEFT JOIN ranked ON item = trial")
def dbscan_labels(spark, d):
    """Clusters of each neuron's trials of a stimulus, by warping distance."""
    return _labels(spark, d)[1]


@query(
    f"""{L1}, n AS (SELECT neuron, stimulus, i, dist FROM e UNION ALL SELECT neuron, stimulus, j, dist FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist) AS r FROM n WHERE dist > 0),
k AS (SELECT neuron, stimulus, i, max(dist) AS k_dist FROM r WHERE r <= 2 GROUP BY ALL) SELECT neuron, stimulus, i, round(k_dist, 6) AS k_dist, row_number() OVER (PARTITION BY neuron, stimulus ORDER BY k_dist, i) AS place FROM k"""
)
def k_distance(spark, d):
    return kn.ranked_distances(pr.l1_nearest(trials(spark, d), GROUP, 2), GROUP).select(*GROUP, "i", r6(F.col("k_dist"), "k_dist"), "place")


@query(f"{LABELS} SELECT neuron, stimulus, trial FROM trials WHERE trial IN (SELECT item FROM ranked)")
def noise_removed(spark, d):
    """Trials left after those that density clustering calls noise are taken out."""
    clean, _ = wp.noise_split(*_labels(spark, d), GROUP)
    return clean.select(*GROUP, "trial")


@query(f"{LABELS} SELECT neuron, stimulus, worm, segment_index, trial, round(dff[1], 6) + 0 AS first_value FROM trials WHERE trial NOT IN (SELECT item FROM ranked)")
def noise_trials(spark, d):
    """The trials that were taken out, with their keys."""
    _, removed = wp.noise_split(*_labels(spark, d), GROUP)
    return removed.select(*GROUP, "worm", "segment_index", "trial", r6(F.element_at("dff", 1), "first_value"))


@query()
def neuron_order_peaks(spark, d):
    m = _matrix(spark, d).withColumn("one", F.lit(0))
    return kn.ordered_rows(m, "neuron", "stimulus", "v", ["one"]).select("neuron", "place")


SIDED = LONG.replace("FROM embeddings", "FROM embeddings WHERE NOT ((vec_id // 10) % 8 = 1 AND label < 5) AND NOT ((vec_id // 10) % 8 = 6 AND label > 6)")


def _sided(spark, d):
    """Mean traces, some of which a neuron lacks while the other side has them, and some of a neuron without sides."""
    n, s = F.col("neuron"), F.col("stimulus")
    e = table(spark, d, "embeddings").where("NOT (floor(vec_id / 10) % 8 = 1 AND label < 5) AND NOT (floor(vec_id / 10) % 8 = 6 AND label > 6)")
    x = long(spark, d).join(e.select(F.col("vec_id").alias("trial")), "trial", "left_semi")
    return x.groupBy(n, s, "t").agg(F.avg("v").alias("v"))


@query(
    f"""WITH {SIDED}, m AS (SELECT neuron, stimulus, t, avg(v) AS v FROM long GROUP BY ALL), own AS (SELECT DISTINCT neuron, stimulus FROM m),
every AS (SELECT n.neuron, s.stimulus, CASE WHEN n.neuron LIKE '%L' THEN left(n.neuron, length(n.neuron) - 1) || 'R' WHEN n.neuron LIKE '%R' THEN left(n.neuron, length(n.neuron) - 1) || 'L' ELSE n.neuron END AS mirror
FROM (SELECT DISTINCT neuron FROM m) n CROSS JOIN (SELECT DISTINCT stimulus FROM m) s),
src AS (SELECT e.neuron, e.stimulus, CASE WHEN o.neuron IS NOT NULL THEN e.neuron WHEN p.neuron IS NOT NULL THEN e.mirror END AS source
FROM every e LEFT JOIN own o ON o.neuron = e.neuron AND o.stimulus = e.stimulus LEFT JOIN own p ON p.neuron = e.mirror AND p.stimulus = e.stimulus)
SELECT src.neuron, src.stimulus, CAST(u.t AS INT) AS t, round(coalesce(m.v, 0), 6) AS v, source IS NULL AS missing
FROM src CROSS JOIN (SELECT DISTINCT t FROM m) u LEFT JOIN m ON m.neuron = src.source AND m.stimulus = src.stimulus AND m.t = u.t"""
)
def traces_imputed(spark, d):
    return rs.traces_imputed(_sided(spark, d)).select("neuron", "stimulus", "t", r6(F.col("v"), "v"), "missing")


@query()
def neuron_order_traces(spark, d):
    """Neurons of each stimulus by Ward's linkage of their traces, those without a trace on either side last."""
    return kn.ordered_rows(rs.traces_imputed(_sided(spark, d)), "neuron", "t", "v", ["stimulus"], method="ward", last="missing")


@query()
def delay_clusters(spark, d):
    """Neurons of each date clustered by peak correlation and ordered by delay."""
    m = long(spark, d).groupBy("date", "neuron", "t").agg(F.avg("v").alias("v"))
    half = rs.cross_correlation_peaks(m, "neuron", ["date"])
    full = half.unionByName(half.where("a <> b").select("date", F.col("b").alias("a"), F.col("a").alias("b"), "corr", (-F.col("lag")).alias("lag")))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["a"].unique())
        c = pdf.pivot(index="a", columns="b", values="corr").loc[names, names].to_numpy(float)
        lag = pdf.pivot(index="a", columns="b", values="lag").loc[names, names].to_numpy(float)
        got = kn.delay_clusters(np.abs(c), lag, np.diag(c))
        return pd.DataFrame({"date": pdf["date"].iloc[0], "neuron": [names[r] for r, _, _ in got], "cluster": [k for _, k, _ in got], "delay": [x for _, _, x in got], "place": range(len(got))}).astype({"cluster": "int32", "delay": "int32", "place": "int32"})

    return full.groupBy("date").applyInPandas(order, "date string, neuron string, cluster int, delay int, place int")


@query()
def pca_scores(spark, d):
    rows, _, _ = kn.principal_components(trials(spark, d), 64, 3, ["trial"])
    return rows.select("trial", "component", r6(F.col("score"), "score"))


@query()
def pca_explained(spark, d):
    _, share, _ = kn.principal_components(trials(spark, d), 64, 63, ["trial"])
    total = np.cumsum(share)
    return spark.createDataFrame([(i, round(float(s), 6), round(float(c), 6)) for i, (s, c) in enumerate(zip(share, total, strict=True))], "component int, share double, cumulative double")


@query()
def pca_top_weights(spark, d):
    """The ten weights of largest size of the first component."""
    _, _, v = kn.principal_components(trials(spark, d), 64, 1, ["trial"])
    top = np.argsort(-np.abs(v[:, 0]), kind="stable")[:10]
    return spark.createDataFrame([(int(i), round(float(v[i, 0]), 6)) for i in top], "t int, weight double")


def _marginals(spark, d):
    return rs.marginals(_tensor(spark, d))


@query()
def dpca_components(spark, d):
    """Share of all variance that each demixed component explains."""
    found = dm.demixed(_marginals(spark, d), 3)
    rows = [(m, k, round(float(v), 6)) for m in dm.MARGINALS for k, v in enumerate(found.explained[m])]
    return spark.createDataFrame(rows, "marginal string, component int, explained double")


@query()
def dpca_projections(spark, d):
    """Each condition's projections on the demixed components."""
    return dm.demixed(_marginals(spark, d), 3).projections.select("marginal", "component", "stimulus", "t", r6(F.col("z"), "z"))


@query(
    f"""WITH {DENSE}, m AS (SELECT avg(v) OVER nt - avg(v) OVER n AS m_t, avg(v) OVER ns - avg(v) OVER n AS m_s, v - avg(v) OVER nt - avg(v) OVER ns + avg(v) OVER n AS m_st
FROM tensor WINDOW n AS (PARTITION BY neuron), ns AS (PARTITION BY neuron, stimulus), nt AS (PARTITION BY neuron, t)),
s AS (SELECT sum(m_t ** 2) AS m_t, sum(m_s ** 2) AS m_s, sum(m_st ** 2) AS m_st, sum((m_t + m_s + m_st) ** 2) AS total FROM m)
SELECT 'm_t' AS marginal, round(m_t / total, 6) AS share FROM s UNION ALL SELECT 'm_s', round(m_s / total, 6) FROM s UNION ALL SELECT 'm_st', round(m_st / total, 6) FROM s"""
)
def dpca_variance(spark, d):
    """Share of all variance that lies in each marginal."""
    m = _marginals(spark, d)
    total = F.sum((F.col("m_t") + F.col("m_s") + F.col("m_st")) ** 2)
    s = m.agg(F.array(*[F.struct(F.lit(c).alias("marginal"), (F.sum(F.col(c) ** 2) / total).alias("share")) for c in dm.MARGINALS]).alias("s"))
    return s.select(F.explode("s").alias("s")).select("s.marginal", r6(F.col("s.share"), "share"))


@query()
def f0_fit(spark, d):
    """Baselines of each worm's event values."""
    from .views import log

    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return kn.fit_quality(kn.fitted_baselines(s, ["worm"])).select("model", r6(F.col("mean_r2"), "mean_r2"), r6(F.col("median_r2"), "median_r2"), "n", "n_poor")


def _recordings(spark, d):
    """Samples, stimuli and sub-recordings of the log: a recording counts from 0, its parts are its first 40 samples and the rest."""
    from .views import log, runs

    s = log(spark, d).select("worm", F.lit("n").alias("neuron"), (F.col("counter") - 1).alias("t"), (F.col("v") + 200).alias("v"))
    stimuli = runs(spark, d).where("state = 'purchase'").select("worm", "seq", "state", (F.col("start") - 1).alias("start"), F.col("end").alias("end"))
    n = s.groupBy("worm").agg((F.max("t") + 1).alias("n"))
    lengths = n.select("worm", F.array(F.least(F.lit(40), F.col("n")).cast("string"), (F.col("n") - 40).cast("string")).alias("n_seg"))
    return s, stimuli, iv.sub_recordings(lengths)


@query(
    f"""WITH {LOG}, {RUNS}, n AS (SELECT worm, count(*) AS n FROM log GROUP BY worm), parts AS (SELECT worm, 0 AS part, 0 AS lo, least(40, n) AS hi FROM n UNION ALL SELECT worm, 1, 40, n FROM n WHERE n > 40),
st AS (SELECT worm, part, seq, greatest(start - 1, lo) - lo AS a FROM runs JOIN parts USING (worm) WHERE state = 'purchase' AND start - 1 < hi AND "end" > lo),
w AS (SELECT worm, part, CASE WHEN lag(a) OVER o IS NULL THEN a - 20 ELSE a - 5 END AS x, CASE WHEN lag(a) OVER o IS NULL THEN a - 3 ELSE a - 1 END AS y FROM st WINDOW o AS (PARTITION BY worm, part ORDER BY seq)
UNION ALL SELECT worm, part, hi - lo - 20, hi - lo FROM parts)
SELECT l.worm, p.part::INT AS part, l.counter - 1 AS t, coalesce(bool_or(l.counter - 1 - p.lo >= w.x AND l.counter - 1 - p.lo < w.y), false) AS used
FROM log l JOIN parts p ON l.worm = p.worm AND l.counter - 1 >= p.lo AND l.counter - 1 < p.hi LEFT JOIN w ON w.worm = p.worm AND w.part = p.part GROUP BY ALL"""
)
def baseline_samples(spark, d):
    """The samples that each sub-recording's baseline is fitted to."""
    return rc.baseline_samples(*_recordings(spark, d)).select("worm", "part", "t", "used")


@query()
def recording_quality(spark, d):
    """Fits over the baseline windows of each sub-recording."""
    _, fits = rc.relative_change(rc.baseline_samples(*_recordings(spark, d)))
    return kn.fit_quality(fits, ("part",)).select("part", r6(F.col("mean_r2"), "mean_r2"), r6(F.col("median_r2"), "median_r2"), "n", "n_poor")


@query()
def recording_trials(spark, d):
    """A15 in one piece: recordings to z-scored trials."""
    out = rc.recording_trials(*_recordings(spark, d), group_size=5)
    return out.select("worm", "segment_index", "start", "onset", "offset", _rounded(F.col("dff")).alias("dff"), _rounded(F.col("z")).alias("z"))


@query()
def f0_worst_best(spark, d):
    """Five worst and five best fits."""
    from .views import log

    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    f = kept(kn.fitted_baselines(s, ["worm"]).select("worm", "model", "r2"))  # one fit for both ends
    return ft.worst_and_best(f, ["worm"]).select("which", "worm", "model", r6(F.col("r2"), "r2"))


LINES = f"""WITH {LOG}, sides AS (SELECT *, CASE WHEN counter <= 30 THEN 'start' ELSE 'end' END AS model FROM log),
fits AS (SELECT worm, model, round(regr_r2(v, counter), 9) AS r2 FROM sides GROUP BY ALL HAVING count(*) > 2)"""


def _lines(spark, d):
    """Given fits: a least squares line for the first thirty samples of each worm, and one for the rest."""
    from .views import log

    s = log(spark, d).withColumn("model", F.when(F.col("counter") <= 30, "start").otherwise("end"))
    return s.groupBy("worm", "model").agg(F.round(F.regr_r2("v", "counter"), 9).alias("r2"), F.count("*").alias("n")).where("n > 2").drop("n")


@query(
    f"""{LINES}, ranked AS (SELECT *, row_number() OVER (ORDER BY r2, worm, model) AS lo, row_number() OVER (ORDER BY r2 DESC, worm, model) AS hi FROM fits)
SELECT 'worst' AS which, worm, model, r2 FROM ranked WHERE lo <= 5 UNION ALL SELECT 'best', worm, model, r2 FROM ranked WHERE hi <= 5"""
)
def fits_ranked(spark, d):
    """The five worst and the five best of given fits."""
    return ft.worst_and_best(_lines(spark, d), ["worm", "model"]).select("which", "worm", "model", "r2")


@query(f"{LINES} SELECT model, round(avg(r2), 6) + 0 AS mean_r2, round(median(r2), 6) + 0 AS median_r2, count(*) AS n, count(CASE WHEN r2 < 0.02 THEN 1 END) AS n_poor FROM fits GROUP BY model")
def fits_summary(spark, d):
    """Quality of given fits."""
    return ft.fit_quality(_lines(spark, d), poor=0.02).select("model", r6(F.col("mean_r2"), "mean_r2"), r6(F.col("median_r2"), "median_r2"), "n", "n_poor")


@query()
def region_repair_spline(spark, d):
    from .views import log

    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return kn.region_repaired(s, ["worm"], 10, 15, "spline").select("worm", "t", r6(F.col("repaired"), "repaired"))


@query(
    f"""WITH {LOG}, near AS (SELECT worm, CAST(counter - 10 AS DOUBLE) AS x, v FROM log WHERE (counter >= 0 AND counter < 10) OR (counter >= 15 AND counter < 25)),
s AS (SELECT worm, CAST(count(*) AS DOUBLE) AS n, sum(x) AS a, sum(x ** 2) AS b, sum(x ** 3) AS c, sum(x ** 4) AS e, sum(v) AS p, sum(v * x) AS q, sum(v * x ** 2) AS r FROM near GROUP BY worm),
k AS (SELECT worm, n * (b * e - c * c) - a * (a * e - b * c) + b * (a * c - b * b) AS det, p * (b * e - c * c) - a * (q * e - r * c) + b * (q * c - r * b) AS k0,
n * (q * e - r * c) - p * (a * e - b * c) + b * (a * r - b * q) AS k1, n * (b * r - c * q) - a * (a * r - b * q) + p * (a * c - b * b) AS k2 FROM s)
SELECT l.worm, l.counter AS t, round(CASE WHEN counter >= 10 AND counter < 15 AND k.det <> 0 THEN (k0 + k1 * (counter - 10) + k2 * (counter - 10) ** 2) / det ELSE v END, 6) + 0 AS repaired FROM log l LEFT JOIN k USING (worm)"""
)
def region_repair_polynomial(spark, d):
    from .views import log

    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return kn.region_repaired(s, ["worm"], 10, 15, "polynomial").select("worm", "t", r6(F.col("repaired"), "repaired"))


# ---------------------------------------------------------------- features, intervals of traces


@query(
    f"""WITH {LONG}, ids AS (SELECT DISTINCT stimulus FROM trials), m AS (SELECT stimulus, neuron, t, avg(v) AS v FROM long GROUP BY ALL), n AS (SELECT neuron, row_number() OVER (ORDER BY neuron) - 1 AS k FROM (SELECT DISTINCT neuron FROM trials))
SELECT i.stimulus, CAST(n.k * 64 + u.t AS BIGINT) AS feature, round(coalesce(m.v, 0), 6) + 0 AS v FROM ids i CROSS JOIN n CROSS JOIN range(64) u(t) LEFT JOIN m ON m.stimulus = i.stimulus AND m.neuron = n.neuron AND m.t = u.t"""
)
def feature_vectors(spark, d):
    """A sample for each stimulus, features neuron by neuron, zeros where a neuron has no trial."""
    return rs.feature_vectors(_tensor(spark, d), 64).select("stimulus", "feature", r6(F.col("v"), "v"))


@query(
    f"""WITH {LONG}, ids AS (SELECT DISTINCT stimulus, worm || '_' || segment_index || '_' || date AS id FROM trials), m AS (SELECT stimulus, worm || '_' || segment_index || '_' || date AS id, neuron, t, avg(v) AS v FROM long GROUP BY ALL),
n AS (SELECT neuron, row_number() OVER (ORDER BY neuron) - 1 AS k FROM (SELECT DISTINCT neuron FROM trials))
SELECT i.stimulus, i.id, CAST(n.k * 64 + m.t AS BIGINT) AS feature, round(m.v, 6) + 0 AS v FROM ids i JOIN m USING (stimulus, id) JOIN n USING (neuron)"""
)
def trial_feature_vectors(spark, d):
    """A sample for each trial of a stimulus; what a neuron lacks is zero and left out (a sparse vector)."""
    m = long(spark, d).withColumn("id", rs.trial_id()).groupBy("stimulus", "id", "neuron", "t").agg(F.avg("v").alias("v"))
    return rs.feature_vectors(m, 64, ("stimulus", "id")).select("stimulus", "id", "feature", r6(F.col("v"), "v"))


@query(f"""WITH {LONG} SELECT trial, round(max(CASE WHEN t BETWEEN 10 AND 20 AND v > 0 THEN v END), 6) AS top, round(coalesce(sum(CASE WHEN t BETWEEN 10 AND 20 AND v > 0 THEN v END), 0), 6) AS total FROM long GROUP BY trial""")
def interval_extremes(spark, d):
    """Largest and summed value of an interval, from floor to ceiling, missing values left out."""
    x = F.filter(tr.span(F.col("dff"), F.floor(F.lit(10.4)).cast("int"), F.ceil(F.lit(20.2)).cast("int")), lambda v: v > 0)
    return trials(spark, d).select("trial", r6(F.array_max(x), "top"), r6(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), "total"))
