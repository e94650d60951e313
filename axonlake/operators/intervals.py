"""Run-length states, intervals and recordings: device log to volumes.

A log has worm, counter and state; an interval has worm, seq, state, start and end (half open where it is joined
to samples). Every window is partitioned by recording, so nothing here gathers all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of equal keys, the last by order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_default(df: DataFrame, dim: DataFrame, on: str, column: str, default: str = "Unknown") -> DataFrame:
    """Name of a code from a dimension of a few rows, else the default."""
    return df.join(dim, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def runs(log: DataFrame, keys: list[str], counter: str = "counter", state: str = "state") -> DataFrame:
    """(keys, seq, state, start, end) of maximal runs of one state, by counter; start and end are counters.

    A missing state is a state of its own. Counters are expected once (R03 sees to it): of repeated ones the order is open. An empty
    log gives no runs; other columns are ignored.
    """
    by = W.partitionBy(*keys).orderBy(counter)
    change = ((F.row_number().over(by) == 1) | ~F.lag(state).over(by).eqNullSafe(F.col(state))).cast("int")
    numbered = log.withColumn("_change", change).withColumn("seq", F.sum("_change").over(by))
    out = numbered.groupBy(*keys, "seq").agg(F.first(state).alias("state"), F.min(counter).alias("start"), F.max(counter).alias("end"))
    return out.withColumn("seq", F.col("seq").cast("long"))


def coalesced(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of several files joined where the state (or its lack) stays and the counters go on."""
    by = W.partitionBy(*keys).orderBy(*order)
    same = F.lag("state").over(by).eqNullSafe(F.col("state")) & F.col("start").isin(F.lag("end").over(by), F.lag("end").over(by) + 1)
    numbered = found.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(by))
    out = numbered.groupBy(*keys, "_group").agg(F.first("state").alias("state"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumnRenamed("_group", "seq").withColumn("seq", F.col("seq").cast("long"))


def to_volumes(found: DataFrame, slices: int, off: str = "All Off", last_end: Column | None = None) -> DataFrame:
    """Frames to volumes, floor((x - adjust + 1) / slices), without the leading and the trailing off state.

    adjust is the end of a leading off run, else the first start. last_end, if given, replaces the last run's end
    before the trim. A missing state is never the off state.
    """
    by = W.partitionBy("worm").orderBy("seq")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.struct("state", "start", "end")).over(whole)
    last = F.max("seq").over(whole)
    df = found.withColumn("_first", first).withColumn("_last", last).withColumn("_low", F.min("seq").over(whole))
    if last_end is not None:
        df = df.withColumn("end", F.when(F.col("seq") == F.col("_last"), last_end).otherwise(F.col("end")))
    adjust = F.when(F.col("_first.state") == off, F.col("_first.end")).otherwise(F.col("_first.start"))
    trimmed = df.withColumn("_adjust", adjust).where(~(F.col("state").eqNullSafe(off) & ((F.col("seq") == F.col("_last")) | (F.col("seq") == F.col("_low")))))

    def volume(c: str) -> Column:
        return F.floor((F.col(c) - F.col("_adjust") + 1) / float(slices)).cast("long")

    return trimmed.select("worm", "seq", "state", volume("start").alias("start"), volume("end").alias("end"))


def merged_recordings(sheets: DataFrame) -> DataFrame:
    """Sheets w1, w1_1, w1_2 ... of one animal one after another, each shifted by the last ends before it.

    sheets: sheet, seq, state, start, end. Sheets of another name form are left out.
    """
    pattern = r"^(w\d+)(?:_(\d+))?$"
    parsed = sheets.where(F.col("sheet").rlike(pattern)).withColumn("worm", F.regexp_extract("sheet", pattern, 1))
    parsed = parsed.withColumn("part", F.coalesce(F.expr(rf"try_cast(regexp_extract(sheet, '{pattern}', 2) as int)".replace("\\", "\\\\")), F.lit(0)))
    ends = parsed.groupBy("worm", "part").agg(F.max_by("end", "seq").alias("_end"))
    before = W.partitionBy("worm").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = ends.select("worm", "part", F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_shift"))
    out = parsed.join(shift, ["worm", "part"])
    return out.select("worm", "part", "seq", "state", (F.col("start") + F.col("_shift")).alias("start"), (F.col("end") + F.col("_shift")).alias("end"))


def stimulus_list(intervals: DataFrame, exclude: list[str]) -> DataFrame:
    """Intervals of some length whose state is none of exclude, by exact name."""
    return intervals.where((F.col("end") != F.col("start")) & ~F.col("state").isin(*exclude))


def stimulus_or_buffer(intervals: DataFrame, exclude: list[str], buffer: str = "Buffer") -> DataFrame:
    """Each interval of some length as stimulus, buffer or other, by substring: names and intervals may thus differ."""
    hit = F.lit(False)
    for e in [buffer, *exclude]:
        hit = hit | F.col("state").contains(e)
    kind = F.when(F.col("state").contains(buffer), "buffer").when(hit, "other").otherwise("stimulus")
    return intervals.where("end <> start").withColumn("kind", kind)


def zipped(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of one side with the i-th of the other; the longer side is cut."""
    a = left.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "ordinal"])


def interval_join(samples: DataFrame, intervals: DataFrame, bucket: int = 256, default: str = "Unknown") -> DataFrame:
    """State of each sample (worm, t, ...), start <= t < end, the interval of lowest seq first, else the default.

    Intervals are spread over buckets of time and gathered by recording and bucket (as many as overlap there), so each sample meets one
    row and its columns are shuffled once. Repeated samples each come back; samples without a worm or a time, and intervals without
    a state, give the default; empty intervals cover nothing.
    """
    spans = intervals.where("end > start").select("worm", "seq", "state", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("_bucket"))
    listed = spans.groupBy("worm", "_bucket").agg(F.collect_list(F.struct("seq", "start", "end", "state")).alias("_spans"))
    keyed = samples.withColumn("_bucket", F.floor(F.col("t") / bucket)).join(listed, ["worm", "_bucket"], "left")
    t = F.col("t")
    first = F.array_min(F.filter("_spans", lambda x: (x["start"] <= t) & (t < x["end"])))
    return keyed.select(*samples.columns, F.coalesce(first["state"], F.lit(default)).alias("state"))


def overlap_rebased(intervals: DataFrame, parts: DataFrame) -> DataFrame:
    """Intervals cut to sub-recordings (worm, part, lo, hi) and counted from each part's start; empty ones go."""
    j = intervals.join(parts, "worm").where("start < hi AND end > lo")
    out = j.select("worm", "part", "seq", "state", (F.greatest("start", "lo") - F.col("lo")).alias("start"), (F.least("end", "hi") - F.col("lo")).alias("end"))
    return out.where("end > start")


def sub_recordings(lengths: DataFrame) -> DataFrame:
    """(worm, part, lo, hi) from an array of lengths; entries that aren't positive integers are dropped."""
    good = lengths.select("worm", F.filter(F.transform("n_seg", lambda x: x.try_cast("int")), lambda x: x > 0).alias("n"))
    flat = good.select("worm", F.posexplode("n").alias("part", "len"))
    by = W.partitionBy("worm").orderBy("part")
    hi = F.sum("len").over(by)
    return flat.select("worm", F.col("part").cast("int"), (hi - F.col("len")).cast("long").alias("lo"), hi.cast("long").alias("hi"))


def baseline_windows(stimuli: DataFrame, lengths: DataFrame, vps: int = 1, pre: int = 20, gap: int = 3) -> DataFrame:
    """Windows whose samples the baseline is fitted to, clamped to the recording.

    The first stimulus gives [start - pre * vps, start - gap), without scaling the gap; later ones
    [start - 5 * vps, start - vps); a last window is [n - pre * vps, n). lengths: worm, n.
    """
    by = W.partitionBy("worm").orderBy("seq")
    first = F.lag("start").over(by).isNull()
    own = stimuli.select(
        "worm",
        "seq",
        F.when(first, F.col("start") - pre * vps).otherwise(F.col("start") - 5 * vps).alias("lo"),
        F.when(first, F.col("start") - gap).otherwise(F.col("start") - vps).alias("hi"),
    )
    tail = lengths.select("worm", F.lit(None).cast("long").alias("seq"), (F.col("n") - pre * vps).alias("lo"), F.col("n").alias("hi"))
    both = own.unionByName(tail).join(lengths, "worm")
    out = both.select("worm", "seq", F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least("hi", "n").cast("long").alias("hi"))
    return out.where("hi > lo")


def window_samples(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples in each window; a sample of two windows comes twice."""
    w = windows.select("worm", "lo", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("t"))
    return samples.join(w.select("worm", "t", "lo"), ["worm", "t"])


def densified(ids: DataFrame, key: str, name: str) -> DataFrame:
    """Worm and every number from 0 to the largest, with its name, else the number as text."""
    top = ids.groupBy("worm").agg(F.max(key).alias("_top")).where("_top >= 0")
    every = top.select("worm", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top").cast("long"))).alias(key))
    return every.join(ids.select("worm", F.col(key).cast("long").alias(key), name), ["worm", key], "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))


def suffixed_names(trials: DataFrame, key: str = "worm", order: str = "trial") -> DataFrame:
    """Sheet names w1, w1_1, w1_2 ... in order of trial."""
    k = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return trials.withColumn("_k", k).withColumn("sheet", F.when(F.col("_k") == 0, F.col(key)).otherwise(F.concat_ws("_", key, F.col("_k").cast("string")))).drop("_k")


def permuted_timeline(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """Samples laid out anew by the order of their intervals.

    intervals: worm, ord, start, end; samples: worm, t, v. Samples outside all intervals go; the new time is
    the place in its interval plus the lengths of the intervals that come before.
    """
    by = W.partitionBy("worm").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    placed = intervals.where("end > start").withColumn("_before", F.coalesce(F.sum(F.col("end") - F.col("start")).over(by), F.lit(0)))
    spread = placed.select("worm", "ord", "_before", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"))
    j = spread.join(samples, ["worm", "t"])
    return j.select("worm", "ord", F.col("t").alias("old_t"), (F.col("_before") + F.col("t") - F.col("start")).alias("t"), "v")


def interleaved(buffers: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Buffer 0, stimulus 0, buffer 1, ... by (worm, i); ord counts the result from 0."""
    both = buffers.withColumn("kind", F.lit(0)).unionByName(stimuli.withColumn("kind", F.lit(1)))
    return both.withColumn("ord", (F.row_number().over(W.partitionBy("worm").orderBy("i", "kind")) - 1).cast("long"))
