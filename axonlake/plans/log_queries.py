"""Queries on the device log and on series."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonlake.operators import intervals as iv
from axonlake.operators import responses as rs
from axonlake.operators import series as sr

from .views import GAPPY, LOG, RUNS, gappy, log, query, r6, runs, table


@query(
    f"""WITH {LOG}, {RUNS}, spans AS (SELECT worm, seq, state, start, "end" + 1 AS "end" FROM runs WHERE state <> 'purchase')
SELECT l.worm, coalesce(s.state, 'Unknown') AS state, round(avg(l.v), 6) AS mean, round(stddev_samp(l.v) / sqrt(count(l.v)), 6) AS sem, count(l.v) AS n
FROM log l LEFT JOIN spans s ON l.worm = s.worm AND l.counter >= s.start AND l.counter < s."end" GROUP BY ALL"""
)
def interval_join_stats(spark, d):
    """Flagship: log to runs, runs joined back onto the samples (one state left out becomes Unknown), mean and SEM by state."""
    spans = runs(spark, d).where("state <> 'purchase'").withColumn("end", F.col("end") + 1)
    samples = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    out = rs.mean_sem(iv.interval_join(samples, spans), ["worm", "state"])
    return out.select("worm", "state", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"), "n")


UNKNOWN = LOG.replace("event_type AS state", "CASE WHEN event_id % 5 < 2 THEN NULL ELSE event_type END AS state")


def _unknown(spark, d):
    """The log with states that are missing, several in a row too."""
    return log(spark, d).withColumn("state", F.when(F.col("event_id") % 5 >= 2, F.col("state")))


@query(f'WITH {UNKNOWN}, {RUNS} SELECT worm, seq, state, start, "end" FROM runs')
def run_length_missing_states(spark, d):
    return iv.runs(_unknown(spark, d), ["worm"])


@query(
    f"""WITH {UNKNOWN}, {RUNS}, twice AS (SELECT worm, counter, round(v, 1) AS v FROM log UNION ALL SELECT worm, counter, round(v, 1) FROM log WHERE event_id % 3 = 0
UNION ALL SELECT NULL, 1, v FROM log WHERE event_id % 50 = 0), spans AS (SELECT worm, seq, state, start - 1 AS start, "end" + 2 AS "end" FROM runs),
hits AS (SELECT i.worm, i.counter, arg_min(coalesce(s.state, 'Unknown'), s.seq) AS state FROM (SELECT DISTINCT worm, counter FROM twice) i JOIN spans s ON i.worm = s.worm AND i.counter >= s.start AND i.counter < s."end" GROUP BY ALL)
SELECT t.worm, t.counter AS t, t.v, coalesce(h.state, 'Unknown') AS state, count(*) AS n FROM twice t LEFT JOIN hits h ON t.worm = h.worm AND t.counter = h.counter GROUP BY ALL"""
)
def interval_join_repeats(spark, d):
    """J04 with repeated samples, samples without a recording, overlapping intervals and intervals without a state."""
    s = _unknown(spark, d).select("worm", F.col("counter").alias("t"), F.round("v", 1).alias("v"), "event_id")
    none = table(spark, d, "events").where("event_id % 50 = 0").select(F.lit(None).cast("long").alias("worm"), F.lit(1).cast("long").alias("t"), F.col("value").alias("v"), "event_id")
    spans = iv.runs(_unknown(spark, d), ["worm"]).withColumn("start", F.col("start") - 1).withColumn("end", F.col("end") + 2)
    samples = s.unionByName(s.where("event_id % 3 = 0")).unionByName(none).drop("event_id")
    return iv.interval_join(samples, spans, 8).groupBy("worm", "t", "v", "state").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS worm, date_trunc('hour', ts) AS hour, arg_max(event_type, event_id) AS state, max(event_id) AS event_id FROM events GROUP BY ALL""")
def dedupe_keep_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("worm"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("state"), "event_id")
    return iv.keep_last(e, ["worm", "hour"], ["event_id"]).select("worm", "hour", "state", "event_id")


@query(
    """SELECT event_id, coalesce(name, 'Unknown') AS name FROM events
LEFT JOIN (VALUES ('click', 'Odor1'), ('view', 'Buffer'), ('purchase', 'Odor2')) AS m(code, name) ON event_type = code"""
)
def state_lookup_default(spark, d):
    names = spark.sql("SELECT * FROM VALUES ('click', 'Odor1'), ('view', 'Buffer'), ('purchase', 'Odor2') AS m(code, name)")
    return iv.with_default(table(spark, d, "events").select("event_id", F.col("event_type").alias("code")), F.broadcast(names), "code", "name").select("event_id", "name")


@query(f'WITH {LOG}, {RUNS} SELECT worm, seq, state, start, "end" FROM runs')
def run_length_states(spark, d):
    return runs(spark, d)


@query(
    f"""WITH {LOG}, files AS (SELECT *, counter // 16 AS file FROM log), marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS change
FROM files WINDOW w AS (PARTITION BY worm, file ORDER BY counter)), numbered AS (SELECT *, sum(change) OVER (PARTITION BY worm, file ORDER BY counter) AS seq FROM marked),
pieces AS (SELECT worm, file, seq, first(state) AS state, min(counter) AS start, max(counter) AS "end" FROM numbered GROUP BY worm, file, seq),
joined AS (SELECT *, CASE WHEN lag(state) OVER w = state AND start IN (lag("end") OVER w, lag("end") OVER w + 1) THEN 0 ELSE 1 END AS fresh FROM pieces WINDOW w AS (PARTITION BY worm ORDER BY file, seq)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY worm ORDER BY file, seq) AS g FROM joined)
SELECT worm, CAST(g AS BIGINT) AS seq, first(state) AS state, min(start) AS start, max("end") AS "end" FROM grouped GROUP BY worm, g"""
)
def coalesce_runs(spark, d):
    files = log(spark, d).withColumn("file", F.floor(F.col("counter") / 16).cast("long"))
    return iv.coalesced(iv.runs(files, ["worm", "file"]), ["worm"], ["file", "seq"])


@query(
    f"""WITH {LOG}, {RUNS}, named AS (SELECT worm, seq, CASE WHEN state = 'click' THEN 'All Off' ELSE state END AS state, start, "end" FROM runs),
edges AS (SELECT worm, min(seq) AS lo, max(seq) AS hi, arg_min(state, seq) AS s0, arg_min(start, seq) AS a0, arg_min("end", seq) AS e0 FROM named GROUP BY worm)
SELECT n.worm, n.seq, n.state, CAST(floor((n.start - CASE WHEN s0 = 'All Off' THEN e0 ELSE a0 END + 1) / 4.0) AS BIGINT) AS start,
CAST(floor((n."end" - CASE WHEN s0 = 'All Off' THEN e0 ELSE a0 END + 1) / 4.0) AS BIGINT) AS "end" FROM named n JOIN edges USING (worm)
WHERE NOT (n.state = 'All Off' AND n.seq IN (lo, hi))"""
)
def frames_to_volumes(spark, d):
    named = runs(spark, d).withColumn("state", F.when(F.col("state") == "click", "All Off").otherwise(F.col("state")))
    return iv.to_volumes(named, 4)


SHEETS = """sheets AS (SELECT CASE WHEN worm % 3 = 0 THEN 'w' || (worm // 3) ELSE 'w' || (worm // 3) || '_' || (worm % 3) END AS sheet, seq, state, start, "end" FROM runs)"""


@query(
    f"""WITH {LOG}, {RUNS}, {SHEETS}, parsed AS (SELECT *, regexp_extract(sheet, '^(w\\d+)', 1) AS worm, coalesce(TRY_CAST(regexp_extract(sheet, '_(\\d+)$', 1) AS INT), 0) AS part FROM sheets),
ends AS (SELECT worm, part, arg_max("end", seq) AS e FROM parsed GROUP BY ALL),
shifts AS (SELECT worm, part, coalesce(sum(e) OVER (PARTITION BY worm ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends)
SELECT worm, part, seq, state, CAST(start + s AS BIGINT) AS start, CAST("end" + s AS BIGINT) AS "end" FROM parsed JOIN shifts USING (worm, part)"""
)
def merge_recordings_offset(spark, d):
    w = F.col("worm")
    base = F.concat(F.lit("w"), F.floor(w / 3).cast("string"))
    sheets = runs(spark, d).withColumn("sheet", F.when(w % 3 == 0, base).otherwise(F.concat(base, F.lit("_"), (w % 3).cast("string")))).drop("worm")
    return iv.merged_recordings(sheets)


BUFFERED = """named AS (SELECT worm, seq, CASE state WHEN 'view' THEN 'Buffer' WHEN 'click' THEN 'Buffer2' WHEN 'logout' THEN 'Flush' ELSE state END AS state, start, "end" FROM runs)"""


def _buffered(spark, d):
    s = F.col("state")
    return runs(spark, d).withColumn("state", F.when(s == "view", "Buffer").when(s == "click", "Buffer2").when(s == "logout", "Flush").otherwise(s))


@query(f"""WITH {LOG}, {RUNS}, {BUFFERED} SELECT worm, seq, state FROM named WHERE "end" <> start AND state NOT IN ('Buffer', 'Flush')""")
def stimulus_names_exact(spark, d):
    return iv.stimulus_list(_buffered(spark, d), ["Buffer", "Flush"]).select("worm", "seq", "state")


@query(
    f"""WITH {LOG}, {RUNS}, {BUFFERED} SELECT worm, seq, state, CASE WHEN contains(state, 'Buffer') THEN 'buffer' WHEN contains(state, 'Flush') THEN 'other' ELSE 'stimulus' END AS kind
FROM named WHERE "end" <> start"""
)
def stimulus_buffer_split(spark, d):
    return iv.stimulus_or_buffer(_buffered(spark, d), ["Flush"]).select("worm", "seq", "state", "kind")


@query(
    f"""WITH {LOG}, {RUNS}, {BUFFERED}, a AS (SELECT worm, seq AS name_seq, state AS name, row_number() OVER (PARTITION BY worm ORDER BY seq) AS ordinal FROM named WHERE "end" <> start AND state NOT IN ('Buffer', 'Flush')),
b AS (SELECT worm, seq, start, "end", row_number() OVER (PARTITION BY worm ORDER BY seq) AS ordinal FROM named WHERE "end" <> start AND NOT contains(state, 'Buffer') AND NOT contains(state, 'Flush'))
SELECT worm, ordinal, name_seq, name, seq, start, "end" FROM a JOIN b USING (worm, ordinal)"""
)
def positional_zip(spark, d):
    named = _buffered(spark, d)
    names = iv.stimulus_list(named, ["Buffer", "Flush"]).select("worm", F.col("seq").alias("name_seq"), F.col("state").alias("name"))
    spans = iv.stimulus_or_buffer(named, ["Flush"]).where("kind = 'stimulus'").select("worm", "seq", "start", "end")
    return iv.zipped(names, spans, ["worm"], ["name_seq"], ["seq"]).withColumn("ordinal", F.col("ordinal").cast("long"))


PARTS = """parts AS (SELECT worm, 0 AS part, 0 AS lo, 20 AS hi FROM (SELECT DISTINCT worm FROM log) UNION ALL SELECT worm, 1, 20, 55 FROM (SELECT DISTINCT worm FROM log) UNION ALL SELECT worm, 2, 55, 80 FROM (SELECT DISTINCT worm FROM log))"""


def _parts(spark, d):
    lengths = log(spark, d).select("worm").distinct().withColumn("n_seg", F.array(*[F.lit(x) for x in ("20", "35", "x", "-3", "25")]))
    return iv.sub_recordings(lengths)


@query(f"WITH {LOG}, {PARTS} SELECT worm, CAST(part AS INT) AS part, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM parts")
def split_recording(spark, d):
    return _parts(spark, d)


@query(
    f"""WITH {LOG}, {RUNS}, {PARTS} SELECT worm, CAST(part AS INT) AS part, seq, state, CAST(greatest(start, lo) - lo AS BIGINT) AS start, CAST(least("end", hi) - lo AS BIGINT) AS "end"
FROM runs JOIN parts USING (worm) WHERE start < hi AND "end" > lo AND least("end", hi) > greatest(start, lo)"""
)
def interval_overlap_rebase(spark, d):
    return iv.overlap_rebased(runs(spark, d), _parts(spark, d))


WINDOWS = """lengths AS (SELECT worm, count(*) AS n FROM log GROUP BY worm), stim AS (SELECT worm, seq, start, lag(start) OVER (PARTITION BY worm ORDER BY seq) IS NULL AS head FROM runs WHERE state = 'purchase'),
raw AS (SELECT worm, seq, CASE WHEN head THEN start - 20 ELSE start - 5 END AS lo, CASE WHEN head THEN start - 3 ELSE start - 1 END AS hi FROM stim UNION ALL SELECT worm, NULL, n - 20, n FROM lengths),
windows AS (SELECT worm, seq, greatest(lo, 0) AS lo, least(hi, n) AS hi FROM raw JOIN lengths USING (worm) WHERE least(hi, n) > greatest(lo, 0))"""


def _windows(spark, d):
    lengths = log(spark, d).groupBy("worm").agg(F.count("*").alias("n"))
    return iv.baseline_windows(runs(spark, d).where("state = 'purchase'"), lengths)


@query(f"WITH {LOG}, {RUNS}, {WINDOWS} SELECT worm, seq, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM windows")
def baseline_windows(spark, d):
    return _windows(spark, d)


@query(f"""WITH {LOG}, {RUNS}, {WINDOWS} SELECT worm, counter AS t, count(*) AS times, round(sum(v), 6) AS total FROM log JOIN windows USING (worm) WHERE counter >= lo AND counter < hi GROUP BY ALL""")
def baseline_window_samples(spark, d):
    samples = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    out = iv.window_samples(samples, _windows(spark, d))
    return out.groupBy("worm", "t").agg(F.count("*").alias("times"), r6(F.sum("v"), "total"))


IDS = """ids AS (SELECT CAST(n_regionkey AS BIGINT) AS worm, CAST(n_nationkey AS BIGINT) AS digital, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation)"""


@query(
    f"""WITH {IDS}, e AS (SELECT worm, unnest(range(max(digital) + 1)) AS digital FROM ids GROUP BY worm)
SELECT worm, digital, coalesce(name, CAST(digital AS VARCHAR)) AS name FROM e LEFT JOIN ids USING (worm, digital)"""
)
def identity_densify(spark, d):
    n = table(spark, d, "nation")
    ids = n.select(F.col("n_regionkey").cast("long").alias("worm"), F.col("n_nationkey").cast("long").alias("digital"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    return iv.densified(ids, "digital", "name").select("worm", "digital", "name")


@query(f"""WITH {LOG} SELECT 'w' || worm AS worm, counter, 'w' || worm || CASE WHEN counter > 1 THEN '_' || (counter - 1) ELSE '' END AS sheet FROM log""")
def sheet_names(spark, d):
    t = log(spark, d).select(F.concat(F.lit("w"), F.col("worm").cast("string")).alias("worm"), "counter")
    return iv.suffixed_names(t, "worm", "counter")


LAID = """laid AS (SELECT worm, seq, start, "end", row_number() OVER (PARTITION BY worm ORDER BY state, seq) AS ord FROM runs WHERE "end" > start)"""


@query(
    f"""WITH {LOG}, {RUNS}, {LAID}, placed AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY worm ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM laid)
SELECT p.worm, p.ord, l.counter AS old_t, CAST(b + l.counter - p.start AS BIGINT) AS t, l.v FROM placed p JOIN log l ON p.worm = l.worm AND l.counter >= p.start AND l.counter < p."end" """
)
def timeline_permuted(spark, d):
    from pyspark.sql.window import Window as W

    laid = runs(spark, d).where("end > start").withColumn("ord", F.row_number().over(W.partitionBy("worm").orderBy("state", "seq")).cast("long"))
    samples = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return iv.permuted_timeline(samples, laid)


@query(
    f"""WITH {LOG}, {RUNS}, s AS (SELECT worm, start, row_number() OVER (PARTITION BY worm ORDER BY seq) AS i, 1 AS kind FROM runs WHERE state <> 'view'
UNION ALL SELECT worm, start, row_number() OVER (PARTITION BY worm ORDER BY seq), 0 FROM runs WHERE state = 'view')
SELECT worm, i, start, kind, row_number() OVER (PARTITION BY worm ORDER BY i, kind) - 1 AS ord FROM s"""
)
def intervals_interleaved(spark, d):
    from pyspark.sql.window import Window as W

    i = F.row_number().over(W.partitionBy("worm").orderBy("seq")).cast("long")
    r = runs(spark, d)
    b, s = (r.where(c).select("worm", "start", i.alias("i")) for c in ("state = 'view'", "state <> 'view'"))
    return iv.interleaved(b, s).select("worm", "i", "start", "kind", "ord")


# ---------------------------------------------------------------- series

FILLED = """pts AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS lt, last_value(v IGNORE NULLS) OVER a AS lv,
first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ht, first_value(v IGNORE NULLS) OVER b AS hv FROM gappy
WINDOW a AS (PARTITION BY worm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY worm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT worm, t, v, coalesce(v, lv + (hv - lv) * (t - lt) / nullif(ht - lt, 0), lv, hv) AS filled FROM pts)"""


@query(f"WITH {GAPPY}, {FILLED} SELECT worm, t, round(filled, 6) AS filled FROM filled")
def gap_fill_linear(spark, d):
    return sr.interpolated(gappy(spark, d), ["worm"]).select("worm", "t", r6(F.col("filled"), "filled"))


@query(f"WITH {GAPPY}, {FILLED} SELECT worm, t, round(coalesce(filled, 0), 6) AS filled FROM filled")
def matrix_fill(spark, d):
    return sr.matrix_filled(gappy(spark, d), ["worm"]).select("worm", "t", r6(F.col("filled"), "filled"))


@query(f"WITH {GAPPY}, {FILLED} SELECT worm, t, round(CASE WHEN bool_or(filled IS NULL) OVER (PARTITION BY t) THEN 0 ELSE filled END, 6) AS filled FROM filled")
def matrix_fill_frame(spark, d):
    return sr.matrix_filled(gappy(spark, d), ["worm"], compat_frame=True).select("worm", "t", r6(F.col("filled"), "filled"))


@query(
    f"""WITH {GAPPY.replace('gappy AS', 'raw AS')}, flagged AS (SELECT *, max(CASE WHEN abs(v) > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY worm) AS has FROM raw),
gappy AS (SELECT worm, t, CASE WHEN abs(v) <= 150 THEN v END AS v, v AS orig, has FROM flagged), {FILLED.replace('SELECT worm, t, v, coalesce', 'SELECT worm, t, orig, has, coalesce')}
SELECT worm, t, round(CAST(CAST(CASE WHEN has = 1 THEN filled ELSE orig END AS FLOAT) AS DOUBLE), 3) AS repaired FROM filled"""
)
def spike_repair(spark, d):
    return sr.spikes_repaired(gappy(spark, d), ["worm"], 150.0).select("worm", "t", F.round(F.col("repaired").cast("double"), 3).alias("repaired"))


@query(f"""WITH {GAPPY} SELECT worm, t FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM gappy WINDOW w AS (PARTITION BY worm ORDER BY t)) WHERE v IS NOT NULL AND p IS NULL AND n IS NULL""")
def isolated_points(spark, d):
    return gappy(spark, d).withColumn("alone", sr.isolated(None, ["worm"])).where("alone").select("worm", "t")


@query(f"WITH {GAPPY} SELECT worm, t, CASE WHEN abs(v) <= 60 THEN v END AS v FROM gappy")
def outlier_mask(spark, d):
    return gappy(spark, d).select("worm", "t", F.when(F.abs("v") <= 60, F.col("v")).alias("v"))


@query(
    f"""WITH {LOG} SELECT worm, counter AS t, round(coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w), 6) AS gradient FROM log WINDOW w AS (PARTITION BY worm ORDER BY counter)"""
)
def gradient(spark, d):
    return log(spark, d).select("worm", F.col("counter").alias("t"), r6(sr.gradient(["worm"], "counter"), "gradient"))


@query(
    f"""WITH {LOG}, m AS (SELECT *, median(v) OVER (PARTITION BY worm) AS med FROM log), k AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY worm) AS mad FROM m)
SELECT worm, counter, v FROM k WHERE coalesce(mad, 0) = 0 OR abs(v - med) / (1.4826 * mad) <= 1.5"""
)
def mad_filter(spark, d):
    return sr.mad_kept(log(spark, d), ["worm"], 1.5).select("worm", "counter", "v")


@query(
    f"""WITH {LOG} SELECT worm, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95,
round(quantile_cont(v, 0.99), 6) AS p99 FROM log GROUP BY worm"""
)
def percentiles(spark, d):
    return log(spark, d).groupBy("worm").agg(*[r6(F.percentile("v", p), f"p{round(p * 100):02d}") for p in (0.01, 0.05, 0.75, 0.95, 0.99)])


@query(
    f"""WITH {LOG}, f AS (SELECT worm, counter, v + 200 AS f, avg(v + 200) OVER w + coalesce(covar_pop(counter, v) OVER w / nullif(var_pop(counter) OVER w, 0), 0) * (counter - avg(counter) OVER w) AS f0 FROM log WINDOW w AS (PARTITION BY worm)),
s AS (SELECT *, greatest(f0, 0.1 * quantile_cont(f0, 0.05) OVER (PARTITION BY worm)) AS safe FROM f)
SELECT worm, counter AS t, round((f - safe) / CASE WHEN abs(safe - 102) >= 1e-6 THEN safe - 102 WHEN safe < 102 THEN -1e-6 ELSE 1e-6 END, 6) AS dff FROM s"""
)
def delta_f_over_f0(spark, d):
    s = log(spark, d).select("worm", F.col("counter").alias("t"), (F.col("v") + 200).alias("f"))
    return sr.delta_f(sr.linear_baseline(s, ["worm"], "t", "f"), ["worm"], background=102.0).select("worm", "t", r6(F.col("dff"), "dff"))


@query(
    f"""WITH {LOG}, a AS (SELECT *, avg(CASE WHEN counter >= 5 AND counter < 10 THEN v END) OVER w AS p, avg(CASE WHEN counter >= 15 AND counter < 20 THEN v END) OVER w AS q FROM log WINDOW w AS (PARTITION BY worm)),
b AS (SELECT *, coalesce(p, q) AS lo, coalesce(q, p) AS hi FROM a) SELECT worm, counter AS t, round(CASE WHEN counter >= 10 AND counter < 15 THEN lo + (hi - lo) * (counter - 10) / 4.0 ELSE v END, 6) AS repaired FROM b"""
)
def region_repair_linear(spark, d):
    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return sr.region_linear(s, ["worm"], 10, 15, 5).select("worm", "t", r6(F.col("repaired"), "repaired"))


@query(
    f"""WITH {LOG} SELECT worm, counter AS t, round(CASE WHEN counter >= 10 AND counter < 15 THEN coalesce(avg(CASE WHEN counter < 10 OR counter >= 15 THEN v END) OVER w, v) ELSE v END, 6) AS repaired
FROM log WINDOW w AS (PARTITION BY worm ORDER BY counter RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""
)
def region_repair_moving(spark, d):
    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return sr.region_moving_average(s, ["worm"], 10, 15, 5).select("worm", "t", r6(F.col("repaired"), "repaired"))


@query(
    f"""WITH {LOG}, a AS (SELECT *, coalesce(avg(CASE WHEN counter >= 5 AND counter < 10 THEN v END) OVER w, 0) AS p, coalesce(avg(CASE WHEN counter >= 15 AND counter < 20 THEN v END) OVER w, 0) AS q FROM log WINDOW w AS (PARTITION BY worm))
SELECT worm, counter AS t, round(CASE WHEN counter >= 10 AND counter < 15 THEN p + (q - p) * (counter - 10) / 4.0 ELSE v END, 6) AS repaired FROM a"""
)
def region_repair_weighted(spark, d):
    """Weighted means of both sides; without its draws, which a test checks."""
    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return sr.region_weighted_average(s, ["worm"], 10, 15, 5, noise=0.0).select("worm", "t", r6(F.col("repaired"), "repaired"))


@query()
def region_repair_normal(spark, d):
    s = log(spark, d).select("worm", F.col("counter").alias("t"), "v")
    return sr.region_normal(s, ["worm"], 10, 15, 5, seed=7).select("worm", "t", r6(F.col("repaired"), "repaired"))


@query(
    f"""WITH {GAPPY}, known AS (SELECT worm, t FROM gappy WHERE v IS NOT NULL), miss AS (SELECT worm, t FROM gappy WHERE v IS NULL)
SELECT m.worm, m.t, arg_min(k.t, abs(k.t - m.t) * 2 + CASE WHEN k.t > m.t THEN 1 ELSE 0 END) AS nearest_t FROM miss m LEFT JOIN known k ON m.worm = k.worm GROUP BY ALL"""
)
def asof_nearest(spark, d):
    g = gappy(spark, d)
    return sr.nearest_in_time(g.where("v IS NULL"), g.where("v IS NOT NULL"), ["worm"])


@query(f"WITH {LOG} SELECT worm, counter, round(v - min(v) OVER (PARTITION BY worm) + 50.0 * worm, 6) AS shifted FROM log")
def waterfall(spark, d):
    return sr.waterfall(log(spark, d), ["worm"], "worm", 50.0).select("worm", "counter", r6(F.col("shifted"), "shifted"))
