"""The recording tables as views of the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NEURONS = ("AWAL", "AWAR", "ASHL", "ASHR", "ASEL", "ASER", "AVA", "7")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device log: worm, counter, state, v."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("worm"), F.row_number().over(order).cast("long").alias("counter"), F.col("event_type").alias("state"), F.col("value").alias("v"), "event_id")


LOG = "log AS (SELECT user_id AS worm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type AS state, value AS v, event_id FROM events)"
RUNS = """marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS change FROM log WINDOW w AS (PARTITION BY worm ORDER BY counter)),
numbered AS (SELECT *, sum(change) OVER (PARTITION BY worm ORDER BY counter) AS seq FROM marked),
runs AS (SELECT worm, CAST(seq AS BIGINT) AS seq, first(state) AS state, min(counter) AS start, max(counter) AS "end" FROM numbered GROUP BY worm, seq)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonlake.operators.intervals import runs as found

    return found(log(spark, sf_dir), ["worm"])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with gaps: every seventh event has no value."""
    return log(spark, sf_dir).select("worm", F.col("counter").alias("t"), F.when(F.col("event_id") % 7 != 0, F.col("v")).alias("v"))


GAPPY = LOG + ",\ngappy AS (SELECT worm, counter AS t, CASE WHEN event_id % 7 <> 0 THEN v END AS v FROM log)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials: each embedding a trace of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    names = F.array(*map(F.lit, NEURONS))
    return e.select(
        v.alias("trial"),
        F.get(names, (F.floor(v / 10) % 8).cast("int")).alias("neuron"),
        F.concat(F.lit("c"), (F.floor(F.col("label") / 3) + 1).cast("string"), F.lit("_"), (F.col("label") % 3 + 1).cast("string")).alias("stimulus"),
        F.concat(F.lit("w"), (v % 5).cast("string")).alias("worm"),
        F.when(v % 2 == 0, "20250101").otherwise("20250202").alias("date"),
        F.floor(v / 5).cast("long").alias("segment_index"),
        (v % 7 + 6).cast("int").alias("start_time"),
        F.col("embedding").cast("array<double>").alias("dff"),
    )


TRIALS = f"""trials AS (SELECT vec_id AS trial, {list(NEURONS)}[CAST(vec_id // 10 % 8 AS INT) + 1] AS neuron,
'c' || (label // 3 + 1) || '_' || (label % 3 + 1) AS stimulus, 'w' || (vec_id % 5) AS worm,
CASE WHEN vec_id % 2 = 0 THEN '20250101' ELSE '20250202' END AS date, vec_id // 5 AS segment_index, CAST(vec_id % 7 + 6 AS INT) AS start_time,
CAST(embedding AS DOUBLE[]) AS dff FROM embeddings)"""
LONG = TRIALS + ",\nlong AS (SELECT trial, neuron, stimulus, worm, date, segment_index, start_time, unnest(range(len(dff))) AS t, unnest(dff) AS v FROM trials)"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonlake.operators.trials import long_view

    return long_view(trials(spark, sf_dir), time="t")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean signed peak of each neuron and stimulus that has trials."""
    from axonlake.operators.trials import signed_peak

    t = trials(spark, sf_dir)
    return t.groupBy("neuron", "stimulus").agg(F.avg(signed_peak(F.col("dff"))).alias("v"))


PEAKS = TRIALS + """,
parts AS (SELECT neuron, stimulus, list_max(dff[31:180]) AS hi, list_min(dff[31:180]) AS lo FROM trials),
peaks AS (SELECT neuron, stimulus, avg(coalesce(CASE WHEN abs(hi) > abs(lo) THEN hi ELSE lo END, 0)) AS v FROM parts GROUP BY ALL)"""


def r6(c, name: str):
    """Rounded, so that sums in another order compare equal; negative zero counts as zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def r6_pairs(c, name: str):
    """r6() of a column with a row for each pair. Rounding goes through a decimal number, which only what is large or near a half needs."""
    scaled = c * F.lit(1e6)
    below = F.floor(scaled)
    plain = (F.abs(c) < 1e6) & (F.abs(scaled - below - 0.5) > 1e-3)  # beyond what the product is rounded by
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(F.round(c, 6) + F.lit(0.0)).alias(name)
