"""Finding and reading recordings: file listings, counts by folder, tables of one key, and picks along several axes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from sonarium.sources import tensors


def find_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, name, bytes and changed of the files under a path whose names match; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    cut = F.col("path").substr(F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1)
    return found.select("path", cut.alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def count_by_folder(files: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Files and bytes of each folder and, of a manifest (path, n), frames."""
    if frames is None:
        return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    joined = files.join(frames.select("path", "n"), "path", "left")
    return joined.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("n").alias("frames"))


def key_of(name: str) -> str:
    """A key as tables have it: data/image and image are one, as are scan/... entries kept whole."""
    return name.removeprefix("data/").strip("/")


def pick_axes(cells: DataFrame, index: dict[str, object], renumber: bool = True) -> DataFrame:
    """Cells at an index along each of several axes: all, a number (the axis goes), a list, a range or a slice. Places
    are numbered anew in order, unless told not to."""
    for axis, one in index.items():
        if isinstance(one, str) and one == "all":
            continue
        cells = cells.filter(tensors.frame_condition(F.col(axis), one))
        if isinstance(one, (int, np.integer)):
            cells = cells.drop(axis)
        elif renumber and isinstance(one, slice):
            cells = cells.withColumn(axis, F.floor((F.col(axis) - (one.start or 0)) / (one.step or 1)).cast(cells.schema[axis].dataType))
        elif renumber:
            order = F.array(*(F.lit(int(i)) for i in one))
            cells = cells.withColumn(axis, (F.array_position(order, F.col(axis).cast("int")) - 1).cast(cells.schema[axis].dataType))
    return cells


def load(spark: SparkSession, path: str, key: str, frames: object = "all", transmits: list[int] | None = None, axes: tuple[str, ...] = (), scan: dict | None = None) -> tuple[DataFrame, dict]:
    """Cells of one key of a block table, at some frames and transmits, and the scan's entries, of which those that a
    transmit each has are cut alike."""
    found = tensors.cells(tensors.read(spark, path, key_of(key), frames), list(axes))
    scan = dict(scan or {})
    if transmits is not None:
        if key_of(key) not in ("raw_data", "aligned_data"):
            raise ValueError(f"{key} has no transmits")
        found = pick_axes(found, {"tx": transmits})
        n = scan.get("n_tx")
        scan = {k: [v[t] for t in transmits] if isinstance(v, (list, tuple)) and len(v) == n else v for k, v in scan.items()} | {"selected_transmits": list(transmits), "n_tx": len(transmits)}
    return found, scan


def predicted(df: DataFrame, column: str, make: Callable[[], Callable], out: str = "predicted", kind: DataType | None = None, shape: list[int] | None = None, batch: int = 64) -> DataFrame:
    """df with what a model says of a column of numbers or arrays, batch by batch. make is called once a worker and
    returns a function of NumPy batches; its weights are thus loaded where they are used."""
    udf = predict_batch_udf(make, return_type=kind or ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)
    return df.withColumn(out, udf(F.col(column)))


def inside_polygon(z: Column, x: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a place lies within a polygon (z, x of its corners in turn), by counting the edges to its right."""
    count = F.lit(0)
    for (za, xa), (zb, xb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if za == zb:
            continue
        crosses = ((F.lit(float(za)) > z) != (F.lit(float(zb)) > z)) & (x < (xb - xa) * (z - za) / (zb - za) + xa)
        count = count + crosses.cast("int")
    return count % 2 == 1


def inside_box(z: Column, x: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Whether a place lies in a rectangle, its lower and right edges left out."""
    return (z >= top) & (z < bottom) & (x >= left) & (x < right)
