"""Preparing images for training: resizing and cropping, frame stacks, masks, and the loader's chain of steps, on cells.

Images are rows of ids, z, x and value. Every operator is filters, small joined tables and aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.functions import columns as C
from sonarium.operators import cells, datasets


def _taps(old: int, new: int) -> list[tuple[int, int, float]]:
    """New place, old place and weight of linear interpolation between the middles of cells; beyond the ends theirs."""
    out = []
    for i in range(new):
        p = min(max((i + 0.5) * old / new - 0.5, 0.0), old - 1.0)
        low = min(int(p), old - 1)
        out.append((i, low, 1 - (p - low)))
        if p > low:
            out.append((i, low + 1, p - low))
    return out


def resize(df: DataFrame, ids: list[str], shape: tuple[int, int], size: tuple[int, int], value: str = "value") -> DataFrame:
    """Images of a shape resampled to a size, bilinear, by two tables of weights (twice the size's rows) and one
    aggregation. Columns but ids, z, x and value are left out."""
    made = df.select(*ids, "z", "x", value)
    for axis, old, new in (("z", shape[0], size[0]), ("x", shape[1], size[1])):
        table = df.sparkSession.createDataFrame(_taps(old, new), f"__to_{axis} int, {axis} int, __w_{axis} double")
        made = made.join(F.broadcast(table), axis)
    summed = F.sum(F.col("__w_z") * F.col("__w_x") * F.col(value)).alias(value)
    return made.groupBy(*ids, F.col("__to_z").alias("z"), F.col("__to_x").alias("x")).agg(summed)


def random_crop(df: DataFrame, image: str, shape: tuple[int, int], size: tuple[int, int], seed: int = 0) -> DataFrame:
    """A part of every image, its place following from seed and image."""
    for axis, old, new in (("z", shape[0], size[0]), ("x", shape[1], size[1])):
        if new > old:
            raise ValueError(f"axis {axis}: {new} is more than {old}")
        start = F.floor(C.uniform(str(seed), f"crop-{axis}", F.col(image)) * (old - new + 1)).cast("int")
        df = df.withColumn("__start", start).filter(F.col(axis).between(F.col("__start"), F.col("__start") + new - 1)).withColumn(axis, F.col(axis) - F.col("__start")).drop("__start")
    return df


def crop_or_pad(df: DataFrame, groups: DataFrame, shape: tuple[int, int], size: tuple[int, int], value: str = "value", fill: float = 0.0) -> DataFrame:
    """The middle of every image (groups: a row for each), padded evenly along an axis that is too short."""
    wide = {axis: (old, max(old, new)) for axis, old, new in (("z", shape[0], size[0]), ("x", shape[1], size[1]))}
    padded = cells.pad(df.select(*groups.columns, "z", "x", value), groups, wide, value, fill)
    return cells.crop(padded, {axis: (n, new) for (axis, (_, n)), new in zip(wide.items(), size, strict=True)})


def resized(df: DataFrame, how: str, image: str, shape: tuple[int, int], size: tuple[int, int], seed: int = 0, value: str = "value") -> DataFrame:
    """resize, center_crop, random_crop or crop_or_pad of images told apart by one column."""
    if how == "resize":
        return resize(df, [image], shape, size, value)
    if how == "center_crop":
        return cells.crop(df, {"z": (shape[0], size[0]), "x": (shape[1], size[1])})
    if how == "random_crop":
        return random_crop(df, image, shape, size, seed)
    if how == "crop_or_pad":
        return crop_or_pad(df, df.select(image).distinct(), shape, size, value)
    raise ValueError(f"unknown way of resizing {how!r}")


def cut_or_fill(df: DataFrame, groups: DataFrame, sizes: dict[str, tuple[int, int]], value: str = "value", fill: float = 0.0) -> DataFrame:
    """Axes cut or filled at their ends: sizes maps an axis to its old and new length."""
    for axis, (_, new) in sizes.items():
        df = df.filter(F.col(axis) < new)
    return cells.pad(df, groups, {a: (min(n), n[1]) for a, n in sizes.items()}, value, fill, centred=False)


def pad_to_multiple(df: DataFrame, groups: DataFrame, axis: str, length: int, of: int, others: dict[str, int], value: str = "value", fill: float = 0.0) -> DataFrame:
    """An axis filled at its end up to a multiple of a number; others: lengths of the other axes."""
    new = -(-length // of) * of
    return cells.pad(df, groups, {a: (n, n) for a, n in others.items()} | {axis: (length, new)}, value, fill, centred=False)


def stacked_frames(frames: DataFrame, windows: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """Cells of blocks of frames: windows (key, block, slot, frame) say which; a new axis slot tells frames apart."""
    return windows.select(key, "block", "slot", F.col("frame").alias(frame)).join(frames, [key, frame])


def joined_frames(frames: DataFrame, windows: DataFrame, key: str, axis: str, length: int, frame: str = "frame") -> DataFrame:
    """The same along an axis that there is: the frames of a block one after another."""
    made = stacked_frames(frames, windows, key, frame)
    return made.withColumn(axis, F.col("slot") * length + F.col(axis)).drop("slot", frame)


def masked(observed: DataFrame, masks: DataFrame, keys: list[str], value: str = "value", hot: str = "hot") -> DataFrame:
    """Cells times the mask of an action (keys, hot)."""
    return observed.join(masks.select(*keys, hot), keys).withColumn(value, F.col(value) * F.col(hot)).drop(hot)


def without_constant_lines(df: DataFrame, ids: list[str], of: float = 0.0, value: str = "value") -> DataFrame:
    """Images without the rows, then the columns, that hold one value only; what is left is numbered anew."""
    for axis in ("z", "x"):
        some = df.filter(F.col(value) != of).select(*ids, axis).distinct()
        place = F.row_number().over(Window.partitionBy(*ids).orderBy(axis)) - 1  # of an image's lines
        numbered = some.withColumn("__place", place)
        df = df.join(numbered, [*ids, axis]).withColumn(axis, F.col("__place")).drop("__place")
    return df


def accepted(df: DataFrame, ids: list[str], value: str = "value", least: float = 0.1, least_right: float = 5.0, leave: int = 100) -> DataFrame:
    """ids and accepted: whether a scan of 112 by 112 has values in its lower left corner, and in its lower right one
    beside the largest `leave`, which may be artefacts."""
    # Rows between which the corners lie, from their first to their last column.
    left = (range(21), (67, 47), (78, 47))
    right = (range(70, 112), (17, 57), (17, 80))

    def corner(columns: range, start: tuple[int, int], stop: tuple[int, int]) -> Column:
        line = lambda ends: F.floor((F.col("x") - columns[0]) * ((ends[1] - ends[0]) / (len(columns) - 1)) + ends[0])
        return F.col("x").between(columns[0], columns[-1]) & (F.col("z") >= line(start)) & (F.col("z") < line(stop))

    own = df.select(*ids, F.when(corner(*left), F.col(value)).alias("l"), F.when(corner(*right), F.col(value)).alias("r"))
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.col("r").desc_nulls_last()))
    sums = own.withColumn("k", rank).groupBy(*ids).agg(F.coalesce(F.sum("l"), F.lit(0.0)).alias("l"), F.coalesce(F.sum(F.when(F.col("k") > leave, F.col("r"))), F.lit(0.0)).alias("r"))
    return sums.select(*ids, ((F.col("l") >= least) & (F.col("r") >= least_right)).alias("accepted"))


def cropped_cone(df: DataFrame, cones: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Images cut to their cone's box (crop_left, crop_right, crop_top, crop_bottom, apex_x), the apex moved to the middle
    by zeros on one side, and zeros on top where the box begins above the image."""
    box = cones.select(key, *(F.col(c).cast("int").alias(c) for c in ("crop_left", "crop_right", "crop_top", "crop_bottom")), F.col("apex_x").cast("double").alias("apex_x"))
    off = (F.col("crop_right") - F.col("crop_left")) / 2 - (F.col("apex_x") - F.col("crop_left"))
    box = box.withColumns({"__l": F.greatest(F.lit(0), off.cast("int")), "__r": F.greatest(F.lit(0), (-off).cast("int"))})
    wide, high = F.col("crop_right") - F.col("crop_left") + F.col("__l") + F.col("__r"), F.col("crop_bottom") - F.col("crop_top")
    grid = box.withColumn("z", F.explode(F.sequence(F.lit(0), high - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), wide - 1)))
    moved = df.join(box, key).filter((F.col("x") >= F.col("crop_left")) & (F.col("x") < F.col("crop_right")) & (F.col("z") < F.col("crop_bottom")) & (F.col("z") >= F.col("crop_top")))
    moved = moved.select(key, (F.col("z") - F.col("crop_top")).alias("z"), (F.col("x") - F.col("crop_left") + F.col("__l")).alias("x"), value)
    return grid.select(key, "z", "x").join(moved, [key, "z", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def grouped_paths(df: DataFrame, path: str, pattern: str, number: str = r"(\d+)", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with group, what a pattern's first part finds in the path, and the place in it, by the number in the name's end.
    Rows of equal paths go by the columns ties; without them their order isn't fixed."""
    name = F.element_at(F.split(path, "/"), -1)
    order = F.regexp_extract(name, number, 1).try_cast("bigint")
    df = df.withColumns({"group": F.regexp_extract(path, pattern, 1), "__n": order})
    return df.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.col("__n").asc_nulls_last(), path, *ties)) - 1).drop("__n")


def picked(df: DataFrame, wanted: list[int], axis: str, length: int | None = None) -> DataFrame:
    """Cells of some places of an axis, numbered anew in the order wanted. Negative places count from the end; those out
    of range are left out (an axis of unknown length takes none that are negative)."""
    places = [i + length if i < 0 and length is not None else i for i in wanted]
    kept = [i for i in places if i >= 0 and (length is None or i < length)]
    table = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(kept)], f"{axis} long, __place long")
    return df.join(F.broadcast(table), axis).withColumn(axis, F.col("__place").cast(df.schema[axis].dataType)).drop("__place")


def load_transmits(df: DataFrame, selected: list[int], key: str = "key") -> DataFrame:
    """Raw or aligned cells of some transmits, numbered anew; of other data an error."""
    kinds = {r[key] for r in df.select(key).distinct().limit(8).collect()} if key in df.columns else set()
    if kinds - {"raw_data", "aligned_data"}:
        raise ValueError(f"{sorted(kinds)} have no transmits")
    return picked(df, selected, "tx")


def text_of(codes: Column) -> Column:
    """The text that an array of character codes stands for."""
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def batches(
    df: DataFrame, image: str, shape: tuple[int, int], seed: int = 0, epoch: int = 0, limit: int | None = None, shards: int = 1, shard: int = 0, clip: tuple[float, float] | None = None, given: tuple[float, float] | None = None,
    size: tuple[int, int] | None = None, how: str = "center_crop", repeat: int = 1, batch: int = 16, drop_remainder: bool = False, output: tuple[float, float] | None = None, value: str = "value",
) -> DataFrame:
    """The loader's chain: images (the first `limit` by id), shuffled by seed and epoch, of one shard, clipped, checked to
    lie in their given range, resized, repeated, dealt to batches in that order, and moved to the output range.

    Columns: image, place, repeat, batch, z, x, value. Order and batches are worked out on a row an image; the cells are
    joined to it once.
    """
    images = df.select(image).distinct()
    if limit is not None:
        images = images.orderBy(image).limit(limit)
    order = datasets.placed(images, [image], seed, epoch)
    order = order.filter(F.col("place") % shards == shard).withColumn("place", F.floor(F.col("place") / shards))
    total = order.count()
    order = datasets.repeated(order, repeat).withColumn("place", F.col("repeat") * total + F.col("place")).withColumn("batch", F.floor(F.col("place") / batch))
    if drop_remainder:
        order = order.filter(F.col("batch") < total * repeat // batch)
    made = df
    if clip:
        made = made.withColumn(value, C.clip(F.col(value), *clip))
    if given:
        made = datasets.in_range(made, value, *given)
    if size:
        made = resized(made, how, image, shape, size, seed + epoch, value)
    if output:
        made = made.withColumn(value, C.rescale(F.col(value), given or (0.0, 1.0), output))
    return made.select(image, "z", "x", value).join(order, image)


def wavelength_times(delay: Column, wavelength: Column | float, speed: Column | float) -> Column:
    """Delays counted in wavelengths, in seconds."""
    return delay * wavelength / speed


def initial_time(start_depth: Column, wavelength: Column | float, speed: Column | float) -> Column:
    """The time at which a record begins whose first sample lies at a depth in wavelengths: there and back."""
    return 2 * start_depth * wavelength / speed


def sampling_rate(decimated: Column, skip: Column | None = None) -> Column:
    """Samples a second, from MHz and the number of channels' samples that are skipped, if there is one."""
    return decimated / (F.coalesce(skip, F.lit(1.0)) if skip is not None else F.lit(1.0)) * 1e6


def resolution_of(rho: tuple[float, float], theta: tuple[float, float], n_rho: int, n_theta: int) -> float:
    """The default step of a scan converted grid: the mean of the arc at a quarter of the depth and the radial step."""
    return (0.25 * (rho[0] + rho[1]) * (theta[1] - theta[0]) / (n_theta - 1) + (rho[1] - rho[0]) / (n_rho - 1)) / 2


def padding(length: int, of: int) -> int:
    """Cells that are missing from a length to a multiple."""
    return math.ceil(length / of) * of - length
