"""Device log to interval tables, file by file as they arrive.

A recording is one worm's log of one day, its frames counted from 1 in order of time. The job reads the log files that its checkpoint doesn't know yet,
adds them to a cleaned log by day, and lays out anew the days that they touch: runs of one state in frames, the same in volumes, and both on
the worm's timeline, where each day follows the days before it. A late file therefore changes its own day, and shifts the later ones.

    <output>/log        batch=N/day=D    cleaned rows, as they came
    <output>/intervals  day=D            runs of each recording
    <output>/timeline   day=D            the same with their place on the worm's timeline: the result

A day is computed from rows of that day alone, in pieces of an hour that are joined where the state goes on, so that no task holds a whole recording.
The timeline takes of the earlier days only each recording's last interval. A batch that is run again, after a failure at any point, writes the
same folders with the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from axonlake.operators import intervals as iv

log = logging.getLogger("jobs.log_intervals")

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
LOG = "worm long, ts timestamp_ntz, event_id long, state string, batch long, day date"
INTERVALS = "worm long, seq long, state string, start long, end long, first_volume long, last_volume long, is_last boolean, day date"
TIMELINE = "worm long, seq long, state string, start long, end long, first_volume long, last_volume long, shift long, day date"


def cleaned(events: DataFrame) -> DataFrame:
    """Rows that have a worm, a time and an id. A missing state is a state of its own."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    return rows.select(F.col("user_id").alias("worm"), "ts", "event_id", F.col("event_type").alias("state"), F.col("ts").cast("date").alias("day"))


def recordings(rows: DataFrame, slices: int, off: str) -> DataFrame:
    """INTERVALS of cleaned rows of whole days. Of rows with one id in a recording the one that came last counts."""
    hourly = ["worm", "day", "hour"]
    once = iv.keep_last(rows.withColumn("hour", F.hour("ts")), [*hourly, "event_id"], ["batch", "ts", "state"])
    counted = once.withColumn("counter", F.row_number().over(W.partitionBy(*hourly).orderBy("ts", "event_id")).cast("long"))
    found = iv.runs(counted, hourly)
    # Frames of the earlier hours: the last run of an hour ends at its number of frames.
    frames = F.when(F.lead("seq").over(W.partitionBy(*hourly).orderBy("seq")).isNull(), F.col("end"))
    before = F.coalesce(F.sum("frames").over(W.partitionBy("worm", "day").orderBy("hour").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("frames", frames).withColumn("before", before)
    placed = placed.withColumn("start", F.col("start") + F.col("before")).withColumn("end", F.col("end") + F.col("before"))
    whole = iv.coalesced(placed, ["worm", "day"], ["hour", "seq"])
    whole = whole.withColumn("is_last", F.lead("seq").over(W.partitionBy("worm", "day").orderBy("seq")).isNull())
    volumes = iv.to_volumes(whole.select(F.struct("worm", "day").alias("worm"), "seq", "state", "start", "end"), slices, off)
    volumes = volumes.select("worm.worm", "worm.day", "seq", F.col("start").alias("first_volume"), F.col("end").alias("last_volume"))
    return whole.join(volumes, ["worm", "day", "seq"], "left").select("worm", "seq", "state", "start", "end", "first_volume", "last_volume", "is_last", "day")


def timeline_from(intervals: DataFrame, first_day: object) -> DataFrame:
    """TIMELINE of the days from first_day on: shift is the number of frames of the worm's earlier recordings."""
    ends = intervals.where("is_last").select("worm", "day", "end")
    shift = F.coalesce(F.sum("end").over(W.partitionBy("worm").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.select("worm", "day", shift.alias("shift")).where(F.col("day") >= F.lit(first_day))
    later = intervals.where(F.col("day") >= F.lit(first_day)).drop("is_last")
    return later.join(shifts, ["worm", "day"]).select("worm", "seq", "state", "start", "end", "first_volume", "last_volume", "shift", "day")


def _pattern(path: str) -> str:
    """A file stream takes folders and patterns, not a file: a pattern that fits the path alone stands for either."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _replace_days(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def timeline(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(TIMELINE).parquet(f"{output}/timeline")


def run(spark: SparkSession, events: str, output: str, checkpoint: str, slices: int = 4, off: str = "click", files_per_batch: int = 1000) -> int:
    """Takes in what is new of the log files under events (a folder, a pattern or a file); returns the number of rows read. Files are told apart by path, by the checkpoint."""

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        added = f"{output}/log/batch={number}"
        cleaned(batch).write.mode("overwrite").partitionBy("day").parquet(added)
        new = session.read.schema(LOG).parquet(f"{output}/log").where(F.col("batch") == number)
        days = [r["day"] for r in new.groupBy("day").agg(F.count("*").alias("n")).orderBy("day").collect()]  # as many as the folders that it wrote
        if not days:
            log.info("batch %d: no rows", number)
            return
        touched = session.read.schema(LOG).parquet(f"{output}/log").where(F.col("day").isin(days))
        _replace_days(recordings(touched, slices, off), f"{output}/intervals")
        intervals = session.read.schema(INTERVALS).parquet(f"{output}/intervals")
        _replace_days(timeline_from(intervals, days[0]), f"{output}/timeline")
        log.info("batch %d: %d rows of %d days from %s to %s; intervals of these days written to %s", number, new.count(), len(days), days[0], days[-1], f"{output}/intervals")

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(events))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new rows from %s; result in %s", read, events, f"{output}/timeline")
    return read


PARAMETERS = {"events": str, "output": str, "checkpoint": str, "slices": int, "off": str, "files_per_batch": int}

if __name__ == "__main__":
    from jobs import main

    main(run, __doc__, PARAMETERS)
