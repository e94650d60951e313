"""Averaged responses of text recordings: from documents to mean traces and normalised peaks.

A document is a trial: its trace is the byte length of each of its words in order, its neuron the language, its stimulus the source. Traces are
corrected by their first samples, downsampled in blocks, and averaged at each time over the trials of a neuron and stimulus; the largest deflection of each
trial gives the table of peaks, which is normalised by neuron.

    <output>/traces  neuron=N    stimulus, t, mean, sem, n
    <output>/peaks   neuron=N    stimulus, trials, peak, normalised

Whole texts are read. Both tables are grouped sums, so that a stimulus with most of the documents is summed where they lie. A run replaces both tables.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators import responses as rs
from axonlake.operators import trials as tr

log = logging.getLogger("jobs.text_responses")

TRACES = "stimulus string, t int, mean double, sem double, n long, neuron string"
PEAKS = "stimulus string, trials long, peak double, normalised double, neuron string"


def recorded(documents: DataFrame, baseline: int, block: int) -> DataFrame:
    """(neuron, stimulus, dff) of each document; a text that is null or has no words gives an empty trace."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    traced = documents.select(F.col("lang").alias("neuron"), F.col("source").alias("stimulus"), F.transform(words, lambda w: F.octet_length(w).cast("double")).alias("trace"))
    corrected = traced.select("neuron", "stimulus", tr.baseline_corrected(F.col("trace"), F.lit(baseline), baseline)["corrected"].alias("x"))
    return corrected.select("neuron", "stimulus", tr.block_means(F.col("x"), block).alias("dff"))


def run(spark: SparkSession, documents: str, output: str, baseline: int = 5, block: int = 10) -> None:
    docs = spark.read.parquet(documents).select("text", "lang", "source")
    log.info("read %d documents from %s", docs.count(), documents)
    trials = recorded(docs, baseline, block)
    traces = rs.mean_sem(tr.long_view(trials, time="t"), ["neuron", "stimulus", "t"])
    traces.select("stimulus", "t", "mean", "sem", "n", "neuron").write.mode("overwrite").partitionBy("neuron").parquet(f"{output}/traces")
    peak = trials.select("neuron", "stimulus", tr.signed_peak(F.col("dff"), 0, 1 << 30).alias("v"))
    matrix = peak.groupBy("neuron", "stimulus").agg(F.count("*").alias("trials"), F.avg("v").alias("peak"))
    table = rs.max_normalised(matrix, "neuron", "peak").select("stimulus", "trials", "peak", "normalised", "neuron")
    table.write.mode("overwrite").partitionBy("neuron").parquet(f"{output}/peaks")
    for name, df in (("traces", traces_of(spark, output)), ("peaks", peaks_of(spark, output))):
        log.info("wrote %d rows to %s/%s", df.count(), output, name)


def traces_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(TRACES).parquet(f"{output}/traces")


def peaks_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PEAKS).parquet(f"{output}/peaks")


PARAMETERS = {"documents": str, "output": str, "baseline": int, "block": int}

if __name__ == "__main__":
    from jobs import main

    main(run, __doc__, PARAMETERS)
