"""Queries of sources and sinks: each writes what it derives from a given table into a new folder, and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from axonlake.operators import responses as rs
from axonlake.sources import tables as st

from .job_queries import job_folder
from .views import LOG, TRIALS, log, query, r6, table, trials

BITS = {"click": "1,0,0", "view": "0,1,0", "purchase": "0,0,1"}


@query(
    f"""WITH {LOG} SELECT CAST(worm AS VARCHAR) AS worm, CASE WHEN worm % 2 = 0 THEN 7 ELSE 0 END AS file_ord, counter,
CASE state WHEN 'click' THEN 'Odor1' WHEN 'view' THEN 'Buffer' WHEN 'purchase' THEN 'Unknown' ELSE 'All Off' END AS state_name FROM log"""
)
def source_device_log(spark, d):
    """A device log of state bits and its configuration, written and read; a file without a number of its own takes that of its name."""
    at = job_folder(spark, "source-log")
    s = F.col("state")
    bits = F.array(*[(F.coalesce(s == name, F.lit(False))).cast("tinyint") for name in BITS])
    rows = log(spark, d).select(F.col("worm").cast("string").alias("worm"), F.when(F.col("worm") % 2 == 0, 7).alias("file_ord"), F.col("counter").alias("row_ord"), "counter", bits.alias("state"))
    # Each task writes a file of its own; the name they share has the number of the log file that they are parts of.
    rows.write.option("mapreduce.output.basename", "log0").parquet(f"{at}/log")
    st.write_config(spark.createDataFrame([("1,0,0", "Odor1"), ("0, 1, 0", "Buffer"), ("0,0,0", "All Off")], "bits string, state_name string"), f"{at}/config")
    named = st.unknown_filled(st.read_log(spark, f"{at}/log"), st.read_config(spark, f"{at}/config"))
    return named.select("worm", "file_ord", "counter", "state_name")


@query("SELECT n_nationkey || ',' || n_regionkey AS bits, n_name AS state_name FROM nation")
def source_config(spark, d):
    """A state map written and read."""
    at = job_folder(spark, "source-config")
    n = table(spark, d, "nation")
    st.write_config(n.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("bits"), F.col("n_name").alias("state_name")), at)
    return st.read_config(spark, at)


@query(f"WITH {TRIALS} SELECT worm, trial, len(dff) AS n, round(list_sum(dff), 6) + 0 AS total FROM trials WHERE worm NOT IN ('w1', 'w3')")
def source_intensity(spark, d):
    """Traces partitioned by worm, read without those of two worms."""
    at = job_folder(spark, "source-intensity")
    st.write_by_worm(trials(spark, d).select("worm", "trial", "dff"), at)
    x = st.read_intensity(spark, at, ("w1", "w3"))
    return x.select("worm", "trial", F.size("dff").cast("long").alias("n"), r6(F.aggregate("dff", F.lit(0.0), lambda a, v: a + v), "total"))


@query(f"WITH {TRIALS} SELECT worm, trial, CAST(row_number() OVER (PARTITION BY worm ORDER BY trial) - 1 AS VARCHAR) AS id FROM trials")
def source_single_trial(spark, d):
    """Traces without ids, numbered within each recording."""
    at = job_folder(spark, "source-single")
    trials(spark, d).select("worm", F.col("trial").alias("neuron_idx"), F.col("dff").alias("f")).write.parquet(at)
    return st.read_single_trial(spark, at).select("worm", F.col("neuron_idx").alias("trial"), "id")


@query(f"WITH {TRIALS} SELECT worm, trial, CASE worm WHEN 'w2' THEN 1 ELSE 64 END AS n FROM trials WHERE worm <> 'w4' OR trial % 2 = 0")
def source_replaced(spark, d):
    """A table by worm, of which two worms are written anew, one with other traces and one with fewer."""
    at = job_folder(spark, "source-replaced")
    t = trials(spark, d).select("worm", "trial", "dff")
    st.write_by_worm(t, at)
    st.replace_partitions(t.where("worm = 'w2'").withColumn("dff", F.slice("dff", 1, 1)), at)
    st.replace_partitions(t.where("worm = 'w4' AND trial % 2 = 0"), at)
    return spark.read.parquet(at).select("worm", "trial", F.size("dff").alias("n"))


@query("SELECT min(event_id) AS frame_number FROM events WHERE event_type = 'click'")
def source_first_frame(spark, d):
    """Frame number of the first row of a table of frames."""
    at = job_folder(spark, "source-frames")
    clicks = table(spark, d, "events").where("event_type = 'click'")
    clicks.select(F.col("event_id").alias("frame_number"), "value").coalesce(1).sortWithinPartitions("frame_number").write.csv(at, header=True)
    return spark.createDataFrame([(st.first_frame(spark, at),)], "frame_number long")


@query(f"""WITH {TRIALS} SELECT neuron, stimulus, CAST(row_number() OVER (PARTITION BY neuron, stimulus ORDER BY trial) - 1 AS INT) AS segment_index, 'w1' AS worm, '20250101' AS date, round(dff[1], 6) + 0 AS first_value FROM trials""")
def source_trial_records(spark, d):
    """A table of neurons and stimuli with nested trials to a row for each trial."""
    at = job_folder(spark, "source-nested")
    own = F.array_sort(F.collect_list(F.struct("trial", "dff")))
    trials(spark, d).groupBy("neuron", "stimulus").agg(own.alias("t")).select("neuron", "stimulus", F.col("t.dff").alias("trials")).write.parquet(at)
    rows = st.trial_records(spark.read.parquet(at), date=F.lit("20250101"))
    return rows.select("neuron", "stimulus", "segment_index", "worm", "date", r6(F.element_at("dff", 1), "first_value"))


def _npy(spark, d, name):
    at = job_folder(spark, name)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), "embedding")
    st.encoded_arrays(e, "embedding", (8, 8)).write.parquet(at)
    return spark.read.parquet(at)


ARRAYS = """SELECT CAST(vec_id AS VARCHAR) AS path, 8 AS height, round(list_min(x), 6) + 0 AS lowest, round(list_max(x), 6) + 0 AS highest, round(list_avg(x), 5) + 0 AS mean FROM (SELECT vec_id, {} AS x FROM embeddings)"""


def _ranges(found):
    return found.select("path", F.element_at("shape", 1).alias("height"), r6(F.col("lowest"), "lowest"), r6(F.col("highest"), "highest"), (F.round("mean", 5) + 0.0).alias("mean"))


@query(ARRAYS.format("CAST(embedding AS DOUBLE[])"))
def source_arrays(spark, d):
    """Matrices as .npy files, written, read and decoded where they lie."""
    return _ranges(st.array_summaries(_npy(spark, d, "source-npy")))


@query(ARRAYS.format("list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v < 0.05 THEN 0 ELSE v END)"))
def source_arrays_thresholded(spark, d):
    """The same files with the background set to zero, compressed."""
    return _ranges(st.array_summaries(st.thresholded_arrays(_npy(spark, d, "source-npz"), 0.05)))


@query(f"""WITH {TRIALS} SELECT neuron, stimulus, count(*) AS n, string_agg(worm || '_' || segment_index || '_' || date, ',' ORDER BY worm, segment_index, date) AS ids FROM trials GROUP BY ALL""")
def trials_rekeyed(spark, d):
    """Trials of each neuron and stimulus in one row."""
    x = rs.rekeyed(trials(spark, d))
    ids = F.transform("trials", lambda t: F.concat_ws("_", t["worm"], t["segment_index"].cast("string"), t["date"]))
    return x.select("neuron", "stimulus", F.size("trials").cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))
