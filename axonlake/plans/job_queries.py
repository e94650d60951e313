"""The jobs as queries: each runs twice into one new folder and gives the output as it stands then."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobs import log_intervals, text_responses

from .views import query, r6


def job_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; on one machine, where spark.checkpoint.dir names none, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="axonlake-jobs-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH log AS (SELECT user_id AS worm, CAST(ts AS DATE) AS day, event_type AS state, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS counter FROM events),
marked AS (SELECT *, CASE WHEN counter = 1 OR lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS change FROM log WINDOW w AS (PARTITION BY worm, day ORDER BY counter)),
numbered AS (SELECT *, sum(change) OVER (PARTITION BY worm, day ORDER BY counter) AS seq FROM marked),
runs AS (SELECT worm, day, CAST(seq AS BIGINT) AS seq, first(state) AS state, min(counter) AS start, max(counter) AS "end" FROM numbered GROUP BY worm, day, seq),
edges AS (SELECT worm, day, min(seq) AS lo, max(seq) AS hi, max("end") AS n, CASE WHEN arg_min(state, seq) = 'click' THEN arg_min("end", seq) ELSE arg_min(start, seq) END AS adjust FROM runs GROUP BY worm, day),
shifts AS (SELECT worm, day, coalesce(sum(n) OVER (PARTITION BY worm ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM edges)
SELECT r.worm, r.day, r.seq, r.state, r.start, r."end",
CASE WHEN NOT coalesce(state = 'click' AND seq IN (lo, hi), false) THEN CAST(floor((start - adjust + 1) / 4.0) AS BIGINT) END AS first_volume,
CASE WHEN NOT coalesce(state = 'click' AND seq IN (lo, hi), false) THEN CAST(floor(("end" - adjust + 1) / 4.0) AS BIGINT) END AS last_volume,
CAST(shift AS BIGINT) AS shift FROM runs r JOIN edges USING (worm, day) JOIN shifts USING (worm, day)"""
)
def job1_log_intervals(spark, d):
    """The device log to intervals in frames, in volumes and on each worm's timeline, by day, file by file."""
    at = job_folder(spark, "log-intervals")
    for _ in range(2):
        log_intervals.run(spark, f"{d}/events.parquet", f"{at}/output", f"{at}/checkpoint")
    return log_intervals.timeline(spark, f"{at}/output").select("worm", "day", "seq", "state", "start", "end", "first_volume", "last_volume", "shift")


@query(
    r"""WITH words AS (SELECT lang AS neuron, source AS stimulus, row_number() OVER () AS trial, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: CAST(strlen(w) AS DOUBLE)) AS x FROM documents),
corrected AS (SELECT neuron, stimulus, trial, list_transform(x, lambda v: v - coalesce(list_avg(x[1:5]), 0)) AS x FROM words),
trials AS (SELECT neuron, stimulus, CASE WHEN len(x) <= 10 THEN x ELSE list_transform(range(len(x) // 10), lambda i: list_avg(x[i * 10 + 1 : i * 10 + 10])) END AS x FROM corrected),
long AS (SELECT neuron, stimulus, CAST(unnest(range(len(x))) AS INT) AS t, unnest(x) AS v FROM trials),
traces AS (SELECT neuron, stimulus, t, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem, count(v) AS n FROM long GROUP BY ALL),
each AS (SELECT neuron, stimulus, coalesce(CASE WHEN abs(list_max(x)) > abs(list_min(x)) THEN list_max(x) ELSE list_min(x) END, 0) AS v FROM trials),
peaks AS (SELECT neuron, stimulus, count(*) AS trials, avg(v) AS peak FROM each GROUP BY ALL),
normed AS (SELECT *, coalesce(peak / nullif(max(abs(peak)) OVER (PARTITION BY neuron), 0), 0) AS normalised FROM peaks)
SELECT p.neuron, p.stimulus, p.trials, round(p.peak, 6) + 0 AS peak, round(p.normalised, 6) + 0 AS normalised, t.t, round(t.mean, 6) + 0 AS mean, round(t.sem, 6) + 0 AS sem, t.n
FROM normed p LEFT JOIN traces t ON p.neuron IS NOT DISTINCT FROM t.neuron AND p.stimulus IS NOT DISTINCT FROM t.stimulus"""
)
def job2_text_responses(spark, d):
    """Documents as recordings to mean traces and normalised peaks, by language."""
    at = job_folder(spark, "text-responses")
    for _ in range(2):
        text_responses.run(spark, f"{d}/documents.parquet", at)
    p, t = text_responses.peaks_of(spark, at).alias("p"), text_responses.traces_of(spark, at).alias("t")
    both = p.join(t, F.col("p.neuron").eqNullSafe(F.col("t.neuron")) & F.col("p.stimulus").eqNullSafe(F.col("t.stimulus")), "left")
    return both.select("p.neuron", "p.stimulus", "trials", r6(F.col("peak"), "peak"), r6(F.col("normalised"), "normalised"), "t.t", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"), "n")
