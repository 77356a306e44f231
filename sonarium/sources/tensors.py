"""Tensor tables: frames as rows (blocks) or cells, read from and written to Parquet and npy files, and checked.

A block table has file_id, event_id, frame, key, shape and data, a row per frame, partitioned by key when written, so
that reading one key or some frames reads nothing else.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "file_id string, event_id int, frame int, key string, shape array<int>, data array<float>"
# Rank of a frame of each kind of data, and the number of channels it may have.
KINDS = {"raw_data": (4, (1, 2)), "aligned_data": (4, (1, 2)), "beamformed_data": (3, (1, 2)), "envelope_data": (2, None), "image": (2, None), "image_sc": (2, None)}
# Scan entries that raw or aligned data need.
REQUIRED = ["n_ax", "n_el", "n_tx", "probe_geometry", "sampling_frequency", "center_frequency", "t0_delays", "n_frames"]


def from_numpy(spark: SparkSession, file_id: str, key: str, array: np.ndarray, event: int | None = None) -> DataFrame:
    """A block table of an array whose first axis counts frames."""
    n, shape = len(array), list(array.shape[1:])
    flat = pa.array(np.ascontiguousarray(array, np.float32).ravel())
    size = len(flat) // n if n else 0
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), flat)
    columns = {"file_id": pa.array([file_id] * n, pa.string()), "event_id": pa.array([event] * n, pa.int32()), "frame": pa.array(range(n), pa.int32()), "key": pa.array([key] * n, pa.string()), "shape": pa.array([shape] * n, pa.list_(pa.int32())), "data": data}
    return spark.createDataFrame(pa.table(columns), BLOCK)


def write(df: DataFrame, path: str) -> None:
    """Writes a block table; a path that exists raises."""
    df.write.mode("errorifexists").partitionBy("key").parquet(path)


def read(spark: SparkSession, path: str, key: str | None = None, frames: object = "all") -> DataFrame:
    """A block table, of one key and some frames; both are conditions on the scan."""
    df = spark.read.schema(BLOCK).parquet(path)
    if key is not None:
        df = df.filter(F.col("key") == key.removeprefix("data/"))
    return df.filter(frame_condition(F.col("frame"), frames))


def frame_condition(frame: Column, index: object) -> Column:
    """all, a number, a list, a range or a slice of frames, as a condition."""
    if isinstance(index, str) and index == "all":
        return F.lit(True)
    if isinstance(index, (int, np.integer)):
        return frame == int(index)
    if isinstance(index, slice):
        step, start = index.step or 1, index.start or 0
        if step < 0 or start < 0 or (index.stop is not None and index.stop < 0):
            raise ValueError("slices count from the start")
        held = (frame >= start) & ((frame - start) % step == 0)
        return held if index.stop is None else held & (frame < index.stop)
    if isinstance(index, (list, tuple, range, np.ndarray)):
        return frame.isin([int(i) for i in index])
    raise ValueError(f"cannot pick frames by {index!r}")


def read_npy(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A block table of npy files, a file_id each; the first axis counts frames. Files are read on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                for i, frame in enumerate(array):
                    row = {"file_id": name, "event_id": None, "frame": i, "key": key, "shape": list(frame.shape), "data": frame.astype(np.float32).ravel()}
                    yield pa.RecordBatch.from_arrays([pa.array([row["file_id"]]), pa.array([None], pa.int32()), pa.array([i], pa.int32()), pa.array([key]), pa.array([row["shape"]], pa.list_(pa.int32())), pa.array([row["data"]], pa.list_(pa.float32()))], list(row))

    return files.mapInArrow(run, BLOCK)


def read_hdf5(*_: object) -> DataFrame:
    raise NotImplementedError("reading HDF5 needs h5py; convert to Parquet or npy first")


def cells(blocks: DataFrame, axes: list[str]) -> DataFrame:
    """A row per value, its coordinates in columns named by the axes."""
    rows = blocks.select("file_id", "frame", "key", "shape", F.posexplode("data").alias("__pos", "value"))
    left = F.col("__pos")
    for i in reversed(range(len(axes))):
        n = F.get("shape", F.lit(i))
        rows = rows.withColumn(axes[i], (left % n).cast("int"))
        left = F.floor(left / n)
    return rows.drop("__pos", "shape").withColumn("value", F.col("value").cast("double"))


def blocks(cell: DataFrame, axes: list[str], value: str = "value") -> DataFrame:
    """Rows of whole frames again: shape and data, values in order of their coordinates."""
    shape = F.array(*((F.max(a) + 1).cast("int") for a in axes))
    values = F.transform(F.sort_array(F.collect_list(F.struct(*axes, F.col(value).cast("float").alias("v")))), lambda r: r["v"])
    return cell.groupBy("file_id", "frame", "key").agg(shape.alias("shape"), values.alias("data")).withColumn("event_id", F.lit(None).cast("int")).select("file_id", "event_id", "frame", "key", "shape", "data")


def manifest(df: DataFrame) -> DataFrame:
    """A row per file and key: number of frames and shape of one."""
    return df.groupBy("file_id", "key").agg(F.countDistinct("frame").alias("n"), F.first("shape").alias("shape"))


def violations(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """A row per broken rule: file_id, key, rule. scans: file_id and the names of the entries it has (array)."""
    known = F.create_map(*(x for k, (rank, _) in KINDS.items() for x in (F.lit(k), F.lit(rank))))
    rank = F.try_element_at(known, F.col("key"))
    size = F.aggregate("shape", F.lit(1), lambda a, n: a * n)
    channels = F.when(rank >= 3, ~F.element_at("shape", -1).isin(1, 2)).otherwise(False)
    rules = F.array(
        F.when(rank.isNull(), "unknown key"),
        F.when(rank != F.size("shape"), "wrong rank"),
        F.when(rank.isNotNull() & channels, "channels are neither 1 nor 2"),
        F.when(size != F.size("data"), "shape and data disagree"),
    )
    found = df.select("file_id", "key", F.explode(F.array_compact(rules)).alias("rule")).distinct()
    if scans is None:
        return found
    needing = df.filter(F.col("key").isin("raw_data", "aligned_data")).select("file_id", "key").distinct()
    missing = F.explode(F.array_except(F.array(*(F.lit(r) for r in REQUIRED)), F.coalesce("entries", F.array().cast("array<string>"))))
    return found.unionByName(needing.join(scans, "file_id", "left").select("file_id", "key", missing.alias("__m")).select("file_id", "key", F.concat(F.lit("no scan entry "), "__m").alias("rule")))


def verasonics_raw(buffer: DataFrame, n_ax: int, n_tx: int, iq: bool = False) -> DataFrame:
    """file_id, frame, el, k, value of a receive buffer as file_id, frame, tx, ax, el, ch, value: k runs over samples,
    then transmits. Of baseband buffers even samples are the real part, odd ones the negated imaginary part."""
    cut = buffer.filter(F.col("k") < n_ax * n_tx).withColumns({"tx": F.floor(F.col("k") / n_ax).cast("int"), "ax": (F.col("k") % n_ax).cast("int")}).drop("k")
    if not iq:
        return cut.withColumn("ch", F.lit(0))
    ch = (F.col("ax") % 2).cast("int")
    return cut.withColumns({"ch": ch, "value": F.when(F.col("ax") % 2 == 1, -F.col("value")).otherwise(F.col("value")), "ax": F.floor(F.col("ax") / 2).cast("int")})


def to_metres(value: Column, unit: Column, wavelength: Column) -> Column:
    """Lengths given in mm, or in wavelengths."""
    return F.when(unit == "mm", value / 1000).otherwise(value * wavelength)


def index_json(index: object) -> str:
    """An index with ranges and slices as JSON."""

    def plain(x: object) -> object:
        if isinstance(x, range):
            return {"__type__": "range", "start": x.start, "stop": x.stop, "step": x.step}
        if isinstance(x, slice):
            return {"__type__": "slice", "start": x.start, "stop": x.stop, "step": x.step}
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        return x.tolist() if isinstance(x, np.ndarray) else x

    return json.dumps(plain(index))


def index_from_json(text: str) -> object:
    def back(x: object) -> object:
        if isinstance(x, dict) and x.get("__type__") in ("range", "slice"):
            return (range if x["__type__"] == "range" else slice)(x["start"], x["stop"], x["step"])
        return [back(y) for y in x] if isinstance(x, list) else x

    return back(json.loads(text))


def line_hash(text: Column, omit: str | None = None) -> Column:
    """sha256 of a text's lines, those left out that hold a string."""
    lines = F.split(text, "\n")
    return F.sha2(F.array_join(lines if omit is None else F.filter(lines, lambda x: ~x.contains(omit)), "\n"), 256)
