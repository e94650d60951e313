"""From whole recordings to trials: sub-recordings, baseline windows, fits, relative change, segments, z-scores in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv
from . import kernels as kn
from . import series as sr
from . import trials as tr


def baseline_samples(samples: DataFrame, stimuli: DataFrame, parts: DataFrame, pre: int = 20, gap: int = 3, vps: int = 1) -> DataFrame:
    """Samples (worm, neuron, t, v) with part, local (time in the part) and used: whether a baseline window of the part holds them.

    Windows are laid out for each sub-recording by itself, from the stimuli that reach into it (A12, J07, A13); a part without stimuli
    has its last window alone. Samples outside all parts go.
    """
    key = F.concat_ws(":", F.col("worm").cast("string"), F.col("part").cast("string"))
    lengths = parts.select(key.alias("worm"), (F.col("hi") - F.col("lo")).alias("n"))
    inside = iv.overlap_rebased(stimuli, parts).withColumn("worm", key)
    windows = iv.baseline_windows(inside.select("worm", "seq", "start", "end"), lengths, vps, pre, gap)
    at = windows.select(F.col("worm").alias("_key"), F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("local")).distinct()
    placed = samples.join(parts, "worm").where("t >= lo AND t < hi").withColumn("local", F.col("t") - F.col("lo")).withColumn("_key", key)
    return placed.join(at.withColumn("used", F.lit(True)), ["_key", "local"], "left").select("worm", "neuron", "part", "t", "local", "v", F.coalesce("used", F.lit(False)).alias("used"))


def relative_change(placed: DataFrame, background: float = 102.0) -> tuple[DataFrame, DataFrame]:
    """(worm, neuron, part, t, f, f0, dff) and the fits of each sub-recording (A14, A08, G15): every part is fitted by itself and stitched by its times."""
    keys = ["worm", "neuron", "part"]
    fits = kn.fitted_baselines(placed, keys, "t", "v", "used")
    flat = fits.select(*keys, F.explode(F.arrays_zip("t", "v", "f0")).alias("s")).select(*keys, F.col("s.t").alias("t"), F.col("s.v").alias("f"), F.col("s.f0").alias("f0"))
    return sr.delta_f(flat, keys, background=background), fits.select(*keys, "model", "r2", "params")


def recording_trials(samples: DataFrame, stimuli: DataFrame, parts: DataFrame, pre: int = 5, post: int = 30, vps: int = 1, group_size: int | None = None, background: float = 102.0) -> DataFrame:
    """(worm, neuron, segment_index, stimulus, start, dff, onset, offset, mu, sd, z): a trial for each stimulus and neuron.

    samples: worm, neuron, t (from 0, without gaps), v; stimuli: worm, seq, state, start, end; parts: worm, part, lo, hi. A recording without
    stimuli gives no trials; samples without a value are left out of fits and stay null in trials.
    """
    change, _ = relative_change(baseline_samples(samples, stimuli, parts, vps=vps), background)
    whole = change.groupBy("worm", "neuron").agg(F.array_sort(F.collect_list(F.struct("t", "dff"))).alias("x")).select("worm", "neuron", F.col("x.dff").alias("trace"))
    cut = whole.join(stimuli, "worm").select("worm", "neuron", F.col("seq").alias("segment_index"), F.col("state").alias("stimulus"), "start", tr.segment(F.col("trace"), F.col("start").cast("int"), F.col("end").cast("int"), pre, post, vps).alias("s"))
    return tr.zscored(cut.select("worm", "neuron", "segment_index", "stimulus", "start", "s.*"), group_size)
