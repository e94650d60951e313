"""Objects in frames: nearest neighbours by a grid of cells, and places of objects that a frame misses."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .series import nearest_in_time

AXES = ("x", "y", "z")
#: Objects that a cell of the first grid would hold if they lay evenly, before it is made finer by FINER halvings.
FILL, FINER = 4, 1


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share, computed once. On one machine, where none is named, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="axonlake-"))
    df = df.persist()
    try:
        return df.checkpoint()
    finally:
        df.unpersist()


def _placed() -> Column:
    """All three coordinates are numbers."""
    return reduce(lambda a, b: a & b, (F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in AXES))


def _grids(points: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corner, width, levels) of each frame: width of the first cells, and the doublings after which a cell takes the whole frame."""
    every = points.select(*keys, *AXES).unionByName(queries.select(*keys, *AXES))
    box = every.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in AXES], *[(F.max(c) - F.min(c)).alias(f"e_{c}") for c in AXES])
    extents = F.filter(F.array(*[F.col(f"e_{c}") for c in AXES]), lambda e: e > 0)
    even = F.exp((F.aggregate(extents, F.lit(0.0), lambda a, e: a + F.log(e)) + F.log(F.lit(float(FILL)) / F.col("n"))) / F.size(extents))
    width = F.when(F.size(extents) > 0, even / 2**FINER).otherwise(F.lit(1.0))
    levels = F.when(F.size(extents) > 0, F.greatest(F.ceil(F.log2(F.array_max(extents) / F.col("width"))), F.lit(0))).otherwise(F.lit(0))
    return box.withColumn("width", width).select(*keys, *[f"lo_{c}" for c in AXES], "width", levels.cast("int").alias("levels"))


def _cell(c: str, level: int) -> Column:
    return F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col("width") * float(2**level)))


def _candidates(queries: DataFrame, points: DataFrame, keys: list[str], item: str, level: int) -> DataFrame:
    """Pairs of a query and the points of the 27 cells around it; both sides have their frame's grid."""
    around = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(AXES, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    asked = queries.withColumn("_by", F.explode(around)).select(*queries.columns, *[(_cell(c, level) + F.col(f"_by.{c}")).alias(f"_{c}") for c in AXES])
    held = points.select(*keys, F.col(item).alias("near"), F.struct(*AXES).alias("q"), *[_cell(c, level).alias(f"_{c}") for c in AXES])
    return asked.join(held, [*keys, *[f"_{c}" for c in AXES]]).where(F.col(item) != F.col("near")).drop(*[f"_{c}" for c in AXES])


def k_nearest(queries: DataFrame, points: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """(keys, item, near, q, dist, rank) of the k points of its frame that are nearest to each query, itself left out.

    queries and points: keys, item, x, y, z, one row for an item in a frame, all coordinates numbers. q is the neighbour's place; of equal distances the smaller
    item comes first. Each frame has a grid of cells by its own density; a query looks at the 27 cells around it, and is answered when its k-th
    neighbour lies within a cell's width. The others look again with cells of twice the width, until a cell takes the whole frame: an equality
    join by cell each time, on fewer queries. A frame of fewer points gives as many as it has; an empty table gives none.
    """
    grids = kept(_grids(points, queries, keys))
    most = grids.agg(F.max("levels")).first()[0]
    if most is None:
        return queries.select(*keys, item, F.col(item).alias("near"), F.struct(*AXES).alias("q"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    held = points.select(*keys, item, *AXES).join(grids, keys)
    left = queries.select(*keys, item, *AXES).join(grids, keys)
    d = F.sqrt(sum((F.col(c) - F.col(f"q.{c}")) ** 2 for c in AXES))
    rank = F.row_number().over(W.partitionBy(*keys, item).orderBy("dist", "near"))
    answers = []
    for level in range(most + 1):
        found = _candidates(left, held, keys, item, level).withColumn("dist", d).withColumn("rank", rank).where(F.col("rank") <= k)
        known = F.count("*").over(W.partitionBy(*keys, item)) >= k
        near_enough = F.max("dist").over(W.partitionBy(*keys, item)) < F.col("width") * (2**level * (1 - 1e-9))
        # a width that takes the frame leaves no point outside of the 27 cells
        told = found.withColumn("_told", (known & near_enough) | (F.col("levels") <= level)).where("_told")
        answers.append(kept(told.select(*keys, item, "near", "q", "dist", "rank")))
        left = left.where(F.col("levels") > level).join(answers[-1].select(*keys, item).distinct(), [*keys, item], "left_anti")
        if level < most:
            left = kept(left)
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, answers)


def imputed_positions(boxes: DataFrame, reference: int | None = None, k: int = 5, step: int = 5, most: int = 20, features: tuple[str, ...] = ()) -> DataFrame:
    """A27 over J15 and J16: (neuron, t, t_ref, x, y, z, n, features) of objects missing at a time.

    boxes: t, neuron, x, y, z and features; an object is missing where a coordinate is null or no number. Its reference is the time nearest to t at which it is
    itself seen, the earlier on ties (or the one given, for all). Its place is its place there plus the mean move since then of its k nearest neighbours
    there that are seen at t; k grows by step up to most while none is seen. Features are those at the reference. Objects that are never seen, or
    without neighbours seen, keep null places and n = 0. Repeated rows of an object and time count once, the smallest that is placed; an
    empty table gives none; other columns are ignored.
    """
    seen = boxes.where(_placed()).groupBy("t", "neuron").agg(F.min(F.struct(*AXES, *features)).alias("s")).select("t", "neuron", "s.*")
    gone = boxes.select("neuron", "t").distinct().join(seen.select("neuron", "t"), ["neuron", "t"], "left_anti")
    if reference is None:
        ref = nearest_in_time(gone, seen.select("neuron", "t"), ["neuron"]).withColumnRenamed("nearest_t", "t_ref")
    else:
        ref = gone.withColumn("t_ref", F.lit(reference).cast(boxes.schema["t"].dataType))
    ref = kept(ref)
    asked = ref.select(F.col("t_ref").alias("t"), "neuron").distinct().join(seen, ["t", "neuron"])
    frames = seen.join(asked.select("t").distinct(), "t", "left_semi")
    near = k_nearest(asked.select("t", "neuron", *AXES), frames, ["t"], "neuron", most).select(F.col("t").alias("t_ref"), "neuron", "near", "q", "rank")
    at = seen.select("t", F.col("neuron").alias("near"), F.struct(*AXES).alias("s"))
    found = ref.join(near, ["t_ref", "neuron"]).join(at, ["t", "near"])
    # The first of k, k + step, ... that reaches a neighbour that is seen.
    first = F.min("rank").over(W.partitionBy("neuron", "t"))
    limit = F.when(first <= k, F.lit(k)).otherwise(F.lit(k) + F.ceil((first - k) / float(step)) * step)
    used = found.withColumn("_limit", limit).where(F.col("rank") <= F.col("_limit"))
    moved = used.groupBy("neuron", "t").agg(*[F.avg(F.col(f"s.{c}") - F.col(f"q.{c}")).alias(f"d{c}") for c in AXES], F.count("*").alias("n"))
    own = asked.select(F.col("t").alias("t_ref"), "neuron", F.struct(*AXES).alias("p"), *features)
    out = ref.join(own, ["t_ref", "neuron"], "left").join(moved, ["neuron", "t"], "left")
    given = [F.when(F.col("n").isNotNull(), F.col(f)).alias(f) for f in features]
    return out.select("neuron", "t", "t_ref", *[(F.col(f"p.{c}") + F.col(f"d{c}")).alias(c) for c in AXES], F.coalesce("n", F.lit(0)).alias("n"), *given)
