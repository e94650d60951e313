"""Sources and sinks: recordings as Parquet, device logs, configurations, image manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

LOG = T.StructType([T.StructField("worm", T.StringType()), T.StructField("file_ord", T.IntegerType()), T.StructField("row_ord", T.LongType()), T.StructField("counter", T.LongType()), T.StructField("state", T.ArrayType(T.ByteType()))])
INTERVALS = "worm string, seq int, state string, start long, end long"
TRACES = "worm string, neuron_idx int, f array<double>, n_seg array<int>"
IDENTITIES = "worm string, digital int, biological string"
TRIALS = "neuron string, stimulus string, worm string, date string, segment_index int, start_time int, end_time int, dff array<double>, z array<double>"


def file_order(path: Column) -> Column:
    """First number in the file's name without its ending, null without one."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")).try_cast("long")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A folder of device logs as Parquet, with the order of their files."""
    df = spark.read.schema(LOG).parquet(path)
    return df.withColumn("file_ord", F.coalesce("file_ord", file_order(F.col("_metadata.file_path")).cast("int")))


def read_intensity(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Traces partitioned by worm; excluded worms are pruned before anything is read."""
    df = spark.read.parquet(path)
    return df.where(~F.col("worm").isin(*exclude)) if exclude else df


def read_single_trial(spark: SparkSession, path: str) -> DataFrame:
    """Traces with an id, the row number within the recording where none is given; an empty table is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no traces in {path}")
    order = W.partitionBy("worm").orderBy("neuron_idx")
    given = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("id", F.coalesce(given, (F.row_number().over(order) - 1).cast("string")))


def write_by_worm(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table partitioned by worm."""
    df.write.mode(mode).partitionBy("worm").parquet(path)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Overwrites the worms that df holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("worm").parquet(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """A workbook, one sheet a worm, where pandas has a reader for it; otherwise use Parquet with a worm column."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("workbooks need openpyxl; store the sheets as Parquet with a worm column") from e
    parts = [p.assign(worm=w, seq=range(len(p))) for w, p in pd.read_excel(path, sheet_name=None).items()]
    return spark.createDataFrame(pd.concat(parts))


def first_frame(spark: SparkSession, path: str) -> int:
    """frame_number of the first row of a CSV file."""
    row = spark.read.csv(path, header=True, schema=None, inferSchema=False).select(F.col("frame_number").cast("long")).first()
    if row is None:
        raise ValueError(f"no rows in {path}")
    return row[0]


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(bits, state_name) of a JSON configuration; its keys are texts of bit lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "state_mapping map<string,string>").alias("c"))
    pairs = raw.select(F.explode("c.state_mapping").alias("key", "state_name"))
    return pairs.select(F.regexp_replace("key", r"[\[\]\s]", "").alias("bits"), "state_name")


def write_config(states: DataFrame, path: str, slices: int = 20) -> None:
    """(bits, state_name) as a JSON configuration that read_config() reads; of repeated bits the last name counts, as in any JSON object.

    A state map is small by nature: it is one object, so one row.
    """
    once = states.groupBy("bits").agg(F.max("state_name").alias("name"))
    key = F.concat(F.lit("["), F.array_join(F.split("bits", r"\s*,\s*"), ", "), F.lit("]"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("name").alias("value")))))
    whole = once.agg(F.to_json(F.struct(F.lit(slices).alias("slice_number"), pairs.alias("state_mapping"))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def unknown_filled(log: DataFrame, states: DataFrame) -> DataFrame:
    """Names of a log's states, Unknown where the map has none."""
    j = log.withColumn("bits", F.concat_ws(",", F.transform("state", lambda b: b.cast("string")))).join(states, "bits", "left")
    return j.withColumn("state_name", F.coalesce("state_name", F.lit("Unknown"))).drop("bits")


def trial_records(nested: DataFrame, worm: str = "w1", date: Column | None = None) -> DataFrame:
    """(neuron, stimulus, trials: arrays of arrays) to a row for each trial; the date is today's unless given."""
    day = F.date_format(F.current_date(), "yyyyMMdd") if date is None else date
    return nested.select("neuron", "stimulus", F.posexplode("trials").alias("segment_index", "dff")).withColumn("worm", F.lit(worm)).withColumn("date", day)


def images(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """Image files, content read only where it is used; frame_no from the name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.withColumn("frame_no", file_order(F.col("path")))


def frame_paths(volumes: DataFrame, per_volume: int = 20, z_from: int = 0, z_to: int = 17, reverse_odd: bool | None = None) -> DataFrame:
    """(volume, place, frame_no, file) for planes z_from to z_to; reverse_odd turns odd (True) or even (False) volumes around."""
    planes = F.sequence(F.lit(z_from).cast("long"), F.lit(z_to).cast("long"))
    if reverse_odd is not None:
        planes = F.when(F.col("volume") % 2 == int(reverse_odd), F.reverse(planes)).otherwise(planes)
    rows = volumes.select("volume", F.posexplode(planes).alias("place", "z"))
    frame = F.col("volume") * per_volume + F.col("z")
    return rows.select("volume", F.col("place").cast("int"), frame.alias("frame_no"), F.format_string("%08d.tif", frame).alias("file"))


def complete_volumes(frames: DataFrame, keys: list[str], per_volume: int = 20) -> DataFrame:
    """Volumes all of whose frames are there."""
    return frames.groupBy(*keys, F.floor(F.col("frame_no") / float(per_volume)).cast("long").alias("volume")).agg(F.countDistinct("frame_no").alias("n")).where(F.col("n") == per_volume).select(*keys, "volume")


def largest_frame(frames: DataFrame, folders: DataFrame) -> DataFrame:
    """Largest frame number of each folder, -1 for an empty one."""
    top = frames.groupBy("folder").agg(F.max("frame_no").alias("top"))
    return folders.join(top, "folder", "left").select("folder", F.coalesce("top", F.lit(-1)).cast("long").alias("top"))


def classified_folders(folders: DataFrame) -> DataFrame:
    """Worm and kind of folders named w1_... (experiment) or W1_... (reference); other names go."""
    f = folders.where(F.col("folder").rlike(r"^[wW]\d+_"))
    return f.withColumn("worm", F.lower(F.split_part("folder", F.lit("_"), F.lit(1)))).withColumn("kind", F.when(F.col("folder").startswith("W"), "ref").otherwise("ex"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def overlapping(volumes: DataFrame, lo: int, hi: int, per_volume: int = 20) -> DataFrame:
    """Volumes that share a frame with [lo, hi]."""
    return volumes.where((F.col("volume") * per_volume <= hi) & ((F.col("volume") + 1) * per_volume - 1 >= lo))


def conversion_manifest(folders: DataFrame, volumes: DataFrame) -> DataFrame:
    """What to convert: of reference folders the first volume, of experiment folders all. volumes: folder, volume."""
    j = classified_folders(folders).join(volumes, "folder")
    first = F.min("volume").over(W.partitionBy("folder"))
    return j.withColumn("_first", first).where((F.col("kind") == "ex") | (F.col("volume") == F.col("_first"))).drop("_first")


def array_summaries(files: DataFrame, schema: str = "path string, shape array<int>, lowest double, highest double, mean double") -> DataFrame:
    """Shape and range of .npy files, or of thresholded_arrays(), from (path, content), decoded on the executors."""

    def decode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x["image"] if isinstance(x, np.lib.npyio.NpzFile) else x
                rows.append((path, list(x.shape), *((float(x.min()), float(x.max()), float(x.mean())) if x.size else (None,) * 3)))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "shape", "lowest", "highest", "mean"])

    return files.select("path", "content").mapInArrow(decode, schema)


def encoded_arrays(arrays: DataFrame, column: str, shape: tuple[int, ...], dtype: str = "float32") -> DataFrame:
    """(path, content) of .npy files from path and an array column of prod(shape) numbers, row by row; other lengths and nulls have no content."""

    def encode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        size = int(np.prod(shape))
        for b in batches:
            out = []
            for values in b.column(1).to_pylist():
                if values is None or len(values) != size:
                    out.append(None)
                    continue
                to = io.BytesIO()
                np.save(to, np.array(values, dtype).reshape(shape), allow_pickle=False)
                out.append(to.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return arrays.select(F.col("path").cast("string"), F.col(column)).mapInArrow(encode, "path string, content binary")


def thresholded_arrays(files: DataFrame, low: float) -> DataFrame:
    """.npy files with values under low set to zero, compressed; (path, content)."""

    def rewrite(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for content in b.column(1).to_pylist():
                x = np.load(io.BytesIO(content), allow_pickle=False)
                to = io.BytesIO()
                np.savez_compressed(to, image=np.where(x < low, 0, x).astype(x.dtype))
                out.append(to.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(rewrite, "path string, content binary")
