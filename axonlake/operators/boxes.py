"""Boxes of objects in volumes: bounds and voxels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(boxes: DataFrame, size: tuple[int, int, int], depth_correction: int = 0) -> DataFrame:
    """Whole-number bounds [lo, hi) of boxes (t, neuron, x, y, z centre; w, h, d): x and y truncated, z rounded up, clamped.

    depth_correction widens z_hi after the clamp. Boxes with a missing number go.
    """
    cols = ("x", "y", "z", "w", "h", "d")
    whole = boxes.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols))
    out = [F.col("t"), F.col("neuron")]
    for c, s, n in (("x", "w", size[0]), ("y", "h", size[1]), ("z", "d", size[2])):
        lo, hi = F.col(c) - F.col(s) / 2, F.col(c) + F.col(s) / 2
        lo, hi = (F.ceil(lo), F.ceil(hi)) if c == "z" else (lo.cast("long"), hi.cast("long"))
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n))
        out += [lo.cast("long").alias(f"{c}_lo"), (hi + (depth_correction if c == "z" else 0)).cast("long").alias(f"{c}_hi")]
    return whole.select(*out)


def voxels(found: DataFrame) -> DataFrame:
    """Label of each voxel that a box covers; where boxes overlap the later neuron wins."""
    rows = found.where("x_hi > x_lo AND y_hi > y_lo AND z_hi > z_lo")
    for c in "xyz":
        rows = rows.withColumn(c, F.explode(F.sequence(F.col(f"{c}_lo"), F.col(f"{c}_hi") - 1)))
    return rows.groupBy("t", "x", "y", "z").agg(F.max("neuron").alias("label"))


def label_runs(found: DataFrame) -> DataFrame:
    """A28 without its voxels: (t, z, y, x_from, x_to, label), the runs [x_from, x_to) of one label on each line; where boxes overlap the later neuron wins.

    A sweep over the edges of the boxes on a line: between two neighbouring edges the same boxes cover all voxels. Rows grow with the lines and edges of boxes, not
    with their widths. Empty boxes and repeated rows change nothing; an empty table gives none.
    """
    rows = found.where("x_hi > x_lo AND y_hi > y_lo AND z_hi > z_lo").distinct()
    for c in "zy":
        rows = rows.withColumn(c, F.explode(F.sequence(F.col(f"{c}_lo"), F.col(f"{c}_hi") - 1)))
    lines = rows.groupBy("t", "z", "y").agg(F.collect_list(F.struct("neuron", "x_lo", "x_hi")).alias("b")).select("t", "z", "y", F.col("b.neuron"), F.col("b.x_lo"), F.col("b.x_hi"))
    kind = found.schema["neuron"].dataType.simpleString()

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, froms, tos, labels = [], [], [], []
            for k, (names, lo, hi) in enumerate(zip(*(batch.column(c) for c in ("neuron", "x_lo", "x_hi")), strict=True)):
                names, lo, hi = (c.values.to_numpy(zero_copy_only=False) for c in (names, lo, hi))
                edges = np.unique(np.concatenate([lo, hi]))
                top = np.full(len(edges), -1)  # box that covers [edge, next edge), -1 for none
                for j in np.argsort(names, kind="stable"):
                    top[np.searchsorted(edges, lo[j]) : np.searchsorted(edges, hi[j])] = j
                label = np.array([names[j] if j >= 0 else None for j in top], object)
                cut = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
                keep = [i for i, c in enumerate(cut[:-1]) if label[c] is not None]  # the last one starts at the last edge
                line += [k] * len(keep)
                froms += [edges[cut[i]] for i in keep]
                tos += [edges[cut[i + 1]] for i in keep]
                labels += [label[cut[i]] for i in keep]
            at = pa.array(line, pa.int64())
            ends = [pa.array(x, batch.column("x_lo").type.value_type) for x in (froms, tos)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("t", "z", "y")), *ends, pa.array(labels, batch.column("neuron").type.value_type)], ["t", "z", "y", "x_from", "x_to", "label"])

    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    edge = found.schema["x_lo"].dataType.simpleString()
    return lines.mapInArrow(swept, f"t {types['t']}, z {types['z']}, y {types['y']}, x_from {edge}, x_to {edge}, label {kind}")


def runs_expanded(runs: DataFrame) -> DataFrame:
    """The voxels (t, x, y, z, label) of label_runs()."""
    return runs.select("t", F.explode(F.sequence(F.col("x_from"), F.col("x_to") - 1)).alias("x"), "y", "z", "label")


def thresholded(v, low: float):
    """Background to zero."""
    return F.when(v < low, F.lit(0)).otherwise(v)


def stretched(v, low: float, high: float):
    """Contrast stretch to 0 .. 255."""
    return F.floor(F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
