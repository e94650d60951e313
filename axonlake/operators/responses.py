"""Population summaries: means, peaks, compounds, normalisation, left/right pairs, set operations on trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .gram import covariances, cross_correlation_peaks  # noqa: F401  these were here first

#: Neurons whose left and right sides differ in function: never merged as a pair.
KEPT_APART = ("ASEL", "ASER")


def mean_sem(long: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Mean, standard error (null for one trial) and number."""
    return long.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))


def cut_to_shortest(trials: DataFrame, keys: list[str], column: str = "dff") -> DataFrame:
    """Every trial of a group cut to the group's shortest."""
    n = F.min(F.size(column)).over(W.partitionBy(*keys))
    return trials.withColumn("_n", n).withColumn(column, F.slice(column, F.lit(1), F.col("_n"))).drop("_n")


def dense(found: DataFrame, rows: str, columns: str, value: str = "v", fill: float = 0.0) -> DataFrame:
    """Every pair of a row name and a column name, fill where nothing was found. Both name sets are dimensions."""
    every = found.select(rows).distinct().crossJoin(found.select(columns).distinct())
    return every.join(found, [rows, columns], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def compound_of(stimulus: Column) -> Column:
    """What stands before the underscore of a stimulus id."""
    return F.split_part(stimulus, F.lit("_"), F.lit(1))


def order_of(stimulus: Column) -> Column:
    """Number behind the underscore of a stimulus id, null if there is none."""
    return F.split_part(stimulus, F.lit("_"), F.lit(2)).try_cast("int")


def compound_means(peaks: DataFrame) -> DataFrame:
    """For each neuron and compound the mean over its stimuli's means (not over trials). peaks: neuron, stimulus, v."""
    return peaks.groupBy("neuron", compound_of(F.col("stimulus")).alias("compound")).agg(F.avg("v").alias("v"))


def max_normalised(matrix: DataFrame, by: str = "neuron", v: str = "v") -> DataFrame:
    """Divided by the largest size in its row of the matrix; rows of zeros stay zero."""
    top = F.max(F.abs(v)).over(W.partitionBy(by))
    return matrix.withColumn("normalised", F.coalesce(F.col(v) / F.nullif(top, F.lit(0.0)), F.lit(0.0)))


def sum_normalised(matrix: DataFrame, by: str = "compound", v: str = "v") -> DataFrame:
    """Divided by the sum of its column; columns that don't sum to more than zero become zero."""
    total = F.sum(v).over(W.partitionBy(by))
    return matrix.withColumn("share", F.when(total > 0, F.col(v) / total).otherwise(0.0))


def base_name(neuron: Column) -> Column:
    """Name without its side, for names of more than one letter that end in L or R."""
    return F.when(neuron.rlike("^.+[LR]$"), F.regexp_replace(neuron, "[LR]$", "")).otherwise(neuron)


def mirrored(neuron: Column) -> Column:
    """The name of the other side, or the name itself if it has no side."""
    stem = F.regexp_replace(neuron, "[LR]$", "")
    return F.when(neuron.endswith("L"), F.concat(stem, F.lit("R"))).when(neuron.endswith("R"), F.concat(stem, F.lit("L"))).otherwise(neuron)


def sides_averaged(matrix: DataFrame, keys: list[str], v: str = "v", apart: tuple[str, ...] = ()) -> DataFrame:
    """Left and right of a neuron averaged under its base name; a side without its partner keeps its own name."""
    base = F.when(F.col("neuron").isin(*apart), F.col("neuron")).otherwise(base_name(F.col("neuron")))
    m = matrix.withColumn("_base", base)
    names = m.groupBy("_base").agg(F.min("neuron").alias("_lo"), F.max("neuron").alias("_hi"))
    m = m.join(names, "_base").withColumn("neuron", F.when(F.col("_lo") != F.col("_hi"), F.col("_base")).otherwise(F.col("neuron")))
    return m.groupBy("neuron", *keys).agg(F.avg(v).alias(v))


def sides_merged(trials: DataFrame, apart: tuple[str, ...] = KEPT_APART, compat: bool = False, column: str = "dff") -> DataFrame:
    """I-th left trial with i-th right trial of a stimulus, cut to the shorter and averaged; what has no partner side goes through.

    Trials beyond the fewer of both sides go. compat leaves out the neurons kept apart altogether, as some
    published results do.
    """
    t = trials.withColumn("side", F.when(~F.col("neuron").isin(*apart) & F.col("neuron").rlike("^.+[LR]$"), F.right("neuron", F.lit(1))))
    t = t.withColumn("base", F.when(F.col("side").isNotNull(), F.regexp_replace("neuron", "[LR]$", "")).otherwise(F.col("neuron")))
    if compat:
        t = t.where(~F.col("neuron").isin(*apart))
    sides = t.groupBy("base", "stimulus").agg(F.min("side").alias("_lo"), F.max("side").alias("_hi"))
    order = W.partitionBy("neuron", "stimulus").orderBy("date", "worm", "segment_index", "trial")
    t = t.join(sides, ["base", "stimulus"]).withColumn("ordinal", F.row_number().over(order))
    two = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))
    left = t.where(two & (F.col("side") == "L")).select("base", "stimulus", "ordinal", F.col(column).alias("_l"))
    right = t.where(two & (F.col("side") == "R")).select("base", "stimulus", "ordinal", F.col(column).alias("_r"))
    n = F.least(F.size("_l"), F.size("_r"))
    pair = left.join(right, ["base", "stimulus", "ordinal"]).select(
        F.col("base").alias("neuron"), "stimulus", "ordinal", F.zip_with(F.slice("_l", F.lit(1), n), F.slice("_r", F.lit(1), n), lambda a, b: (a + b) / 2).alias(column)
    )
    single = t.where(~two).select(F.col("base").alias("neuron"), "stimulus", "ordinal", column)
    return pair.unionByName(single)


def mirror_filled(matrix: DataFrame, zero_is_missing: bool = False, v: str = "v") -> DataFrame:
    """A neuron's missing value (or zero) for a stimulus from the neuron of the other side, else zero."""
    other = matrix.select(F.col("neuron").alias("_mirror"), "stimulus", F.col(v).alias("_other"))
    own = F.nullif(F.col(v), F.lit(0.0)) if zero_is_missing else F.col(v)
    j = matrix.withColumn("_mirror", mirrored(F.col("neuron"))).join(other, ["_mirror", "stimulus"], "left")
    fallback = F.when(F.col("_mirror") != F.col("neuron"), F.col("_other"))
    return j.withColumn("filled", F.coalesce(own, fallback, F.lit(0.0))).drop("_mirror", "_other")


def traces_imputed(traces: DataFrame, v: str = "v") -> DataFrame:
    """Every neuron of the table with a trace for every stimulus: its own, else the other side's, else zeros (missing holds).

    traces: neuron, stimulus, t, v, one row for each time at most. Times that a trace lacks count as zero. The names, stimuli and
    times are dimensions.
    """
    own = traces.select("neuron", "stimulus").distinct()
    every = traces.select("neuron").distinct().crossJoin(traces.select("stimulus").distinct())
    there = own.withColumn("_own", F.lit(True))
    sides = every.join(there, ["neuron", "stimulus"], "left").withColumn("_mirror", mirrored(F.col("neuron")))
    sides = sides.join(there.select(F.col("neuron").alias("_mirror"), "stimulus", F.col("_own").alias("_other")), ["_mirror", "stimulus"], "left")
    source = F.when(F.col("_own"), F.col("neuron")).when(F.col("_other"), F.col("_mirror"))
    grid = sides.select("neuron", "stimulus", source.alias("_source")).crossJoin(traces.select("t").distinct())
    found = traces.select(F.col("neuron").alias("_source"), "stimulus", "t", F.col(v).alias(v))
    out = grid.join(found, ["_source", "stimulus", "t"], "left")
    return out.select("neuron", "stimulus", "t", F.coalesce(v, F.lit(0.0)).alias(v), F.col("_source").isNull().alias("missing"))


def without(trials: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not listed."""
    return trials.join(listed.select(*keys).distinct(), keys, "left_anti")


def only(trials: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are listed."""
    return trials.join(listed.select(*keys).distinct(), keys, "left_semi")


def rekeyed(trials: DataFrame, column: str = "dff") -> DataFrame:
    """(neuron, stimulus, trials), the trials of a neuron and stimulus as structs, ordered by worm, segment, then date; repeated trials each stay."""
    return trials.groupBy("neuron", "stimulus").agg(F.array_sort(F.collect_list(F.struct("worm", "segment_index", "date", column))).alias("trials"))


def trial_id() -> Column:
    """N15."""
    return F.concat_ws("_", "worm", F.col("segment_index").cast("string"), "date")


def identified(trials: DataFrame) -> DataFrame:
    """Without neurons named by a number."""
    return trials.where(~F.col("neuron").rlike("^[0-9]+$"))


def marginals(tensor: DataFrame, v: str = "v") -> DataFrame:
    """The time, stimulus and joint marginals of neuron x stimulus x time, each free of the others' means."""
    n, st, nt = W.partitionBy("neuron"), W.partitionBy("neuron", "stimulus"), W.partitionBy("neuron", "t")
    m = tensor.withColumn("_m", F.avg(v).over(n)).withColumn("_s", F.avg(v).over(st)).withColumn("_t", F.avg(v).over(nt))
    return m.select(
        "neuron", "stimulus", "t", (F.col("_t") - F.col("_m")).alias("m_t"), (F.col("_s") - F.col("_m")).alias("m_s"), (F.col(v) - F.col("_t") - F.col("_s") + F.col("_m")).alias("m_st")
    )


def feature_vectors(tensor: DataFrame, times: int, sample: tuple[str, ...] = ("stimulus",), v: str = "v") -> DataFrame:
    """(sample, feature, v) of a neuron x sample x time table, features neuron-major by neuron name.

    The names, a dimension, are listed in one row; how they are joined is left to the optimiser.
    """
    names = tensor.groupBy().agg(F.array_sort(F.collect_set("neuron")).alias("x")).select(F.posexplode("x").alias("k", "neuron"))
    return tensor.join(names, "neuron").select(*sample, (F.col("k").cast("long") * times + F.col("t")).alias("feature"), v)
