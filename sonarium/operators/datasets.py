"""Dataset operators: block windows, order, splits, shards, batches, and joins of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.functions.columns import order_key
from sonarium.storage import stored


def number_frames(df: DataFrame, key: str, order: list[str], name: str = "frame") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def block_windows(files: DataFrame, n_frames: int, stride: int = 1, overlapping: bool = False, initial: int = 0, n: str = "n") -> DataFrame:
    """A row for each frame of each block: files' columns, block, slot, frame.

    A block spans n_frames * stride frames; blocks follow one another, or begin at every frame. Files that are too
    short for one are left out. files: a row a file, with its number of frames in n.
    """
    span = n_frames * stride
    last = F.col(n) - span
    starts = F.explode(F.sequence(F.lit(initial), last.cast("int"), F.lit(1 if overlapping else span)))
    blocks = files.filter(last >= initial).withColumn("__start", starts)
    blocks = blocks.withColumn("block", F.floor((F.col("__start") - initial) / (1 if overlapping else span)).cast("int"))
    slots = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    return slots.withColumn("frame", F.col("__start") + F.col("slot") * stride).drop("__start")


def path_number(path: Column) -> Column:
    """The last but one whole number in a path, null if there are fewer than two."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"(\d+)"), 1), F.lit(-2)).cast("bigint")


def sort_files(df: DataFrame, path: str) -> DataFrame:
    """Files by the last but one number in their path, those without by path after the others."""
    return df.orderBy(path_number(F.col(path)).asc_nulls_last(), path)


def shuffled(df: DataFrame, ids: list[str], seed: int, epoch: int = 0, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows in an order that follows from seed, epoch and ids; a limit is taken of the given order, before."""
    if limit is not None:
        df = df.orderBy(*(order or ids)).limit(limit)
    return df.orderBy(order_key(seed, F.lit(epoch), *(F.col(i) for i in ids)), *ids)


def placed(df: DataFrame, ids: list[str], seed: int, epoch: int = 0, name: str = "place") -> DataFrame:
    """Rows with their place in the order of shuffled(): ranges of it are sorted in tasks of their own, and a row's place
    is its place in the range after the rows of the ranges before; one number a range comes to the driver."""
    ordered = df.withColumn("__order", order_key(seed, F.lit(epoch), *(F.col(i) for i in ids)))
    ranges = ordered.repartitionByRange("__order", *ids).sortWithinPartitions("__order", *ids).withColumn("__at", F.monotonically_increasing_id()).drop("__order")
    ranges = stored(ranges, "placed")
    part = F.shiftright("__at", 33)
    before, starts = 0, []
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    found = ranges.join(F.broadcast(starts), part == F.col("__part"))
    return found.withColumn(name, F.col("__start") + F.col("__at") - F.shiftleft(part, 33)).drop("__at", "__part", "__start")


def shard(df: DataFrame, index: str, count: int, which: int) -> DataFrame:
    return df.filter(F.col(index) % count == which)


def batched(df: DataFrame, index: str, size: int, drop_remainder: bool = False) -> DataFrame:
    """Rows with the number of their batch; the last one may be short, or dropped."""
    df = df.withColumn("batch", F.floor(F.col(index) / size))
    if not drop_remainder:
        return df
    whole = df.groupBy("batch").agg(F.count("*").alias("__n")).filter(F.col("__n") == size).drop("__n")
    return df.join(whole, "batch", "left_semi")


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def split_by_group(df: DataFrame, group: str, order: list[str], shares: dict[str, float]) -> DataFrame:
    """Rows with a split: of each group the first whole part of its share, then of the next; the rest have none."""
    w = Window.partitionBy(group)
    place, total = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    chain, upto = None, F.lit(0)
    for name, share in shares.items():
        upto = upto + F.floor(share * total)
        chain = F.when(place <= upto, name) if chain is None else chain.when(place <= upto, name)
    return df.withColumn("split", chain)


def split_by_range(value: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """The name of the half-open range that holds a number; null if none does."""
    chain = None
    for name, (low, high) in ranges.items():
        here = (value >= low) & (value < high)
        chain = F.when(here, name) if chain is None else chain.when(here, name)
    return chain


def split_in_order(df: DataFrame, order: list[str], sizes: dict[str, int], rest: str) -> DataFrame:
    """The first rows to one split, the next to another, the others to the rest.

    Only as many rows as the splits take are put in order; ids have to be unique.
    """
    total = sum(sizes.values())
    head = df.orderBy(*order).limit(total).select(*order)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # of `total` rows
    bounds, at = {}, 0
    for name, n in sizes.items():
        bounds[name], at = (at, at + n), at + n
    named = head.withColumn("split", split_by_range(place, bounds))
    return df.join(named, order, "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def first_split(files: DataFrame, splits: DataFrame, name: str = "file", rejected: str = "rejected") -> DataFrame:
    """Files with the first split (rank, split) that lists them."""
    first = splits.groupBy(name).agg(F.min(F.struct("rank", "split"))["split"].alias("split"))
    return files.join(first, name, "left").withColumn("split", F.coalesce("split", F.lit(rejected)))


def shift_measurements(measures: DataFrame, cones: DataFrame, key: list[str], x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Measurements moved into a crop (crop_left, crop_top, status), and those whose file has no good one."""
    good = cones.filter(F.col("status") == "success")
    moved = measures.join(good, key).withColumns({x: F.col(x) - F.col("crop_left"), y: F.col(y) - F.col("crop_top")})
    return moved, measures.join(good, key, "left_anti")


def in_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """df, which fails when a value is out of range."""
    held = F.when(F.col(value).between(low, high) | F.col(value).isNull(), F.col(value))
    return df.withColumn(value, F.coalesce(held, F.when(F.col(value).isNotNull(), F.raise_error(F.concat(F.lit("out of range: "), F.col(value).cast("string"))).cast("double"))))


#: Points of a control curve, at most, that go to every task.
CURVE_POINTS = 10_000


def gain_at(samples: DataFrame, curve: DataFrame, place: str = "ax") -> DataFrame:
    """Samples with gain: 10 ^ (dB / 20) of a control curve (at, code), code / 1023 * 40 dB, between its points; before
    the first and after the last point theirs. No points: null.

    The curve is small, and its size checked: it becomes intervals that go to every task, and samples stay where they
    are, each finding its interval among those in order of place.
    """
    points = sorted((float(r["at"]), r["code"] / 1023 * 40) for r in curve.limit(CURVE_POINTS + 1).collect())
    if len(points) > CURVE_POINTS:
        raise ValueError(f"a control curve of more than {CURVE_POINTS} points")
    if not points:
        return samples.withColumn("gain", F.lit(None).cast("double"))
    at, db = (F.array(*(F.lit(p[k]) for p in points)) for k in (0, 1))
    x = F.col(place).cast("double")
    after = F.lit(0)
    step = 1 << (len(points)).bit_length()
    while step:  # a binary search, written out
        after = F.when((after + step <= len(points)) & (F.get(at, after + (step - 1)) <= x), after + step).otherwise(after)
        step //= 2
        samples, after = samples.withColumn("__after", after), F.col("__after")
    i = F.greatest(F.col("__after") - 1, F.lit(0))
    j = F.least(F.col("__after"), F.lit(len(points) - 1))
    share = F.coalesce(F.try_divide(x - F.get(at, i), F.get(at, j) - F.get(at, i)), F.lit(0.0))
    found = F.get(db, i) + share * (F.get(db, j) - F.get(db, i))
    return samples.withColumn("gain", F.pow(F.lit(10.0), found / 20)).drop("__after")


def planewave_focus(delays: DataFrame, keys: list[str]) -> DataFrame:
    """Per transmit whether its delays (el, t0_delay, apodization) step evenly over two or more active elements."""
    on = delays.filter(F.col("apodization") != 0)
    step = F.col("t0_delay") - F.lag("t0_delay").over(Window.partitionBy(*keys).orderBy("el"))
    return on.withColumn("__step", step).groupBy(*keys).agg((F.coalesce(F.stddev_pop("__step") < 1e-16, F.lit(False)) & (F.count("*") >= 2)).alias("planewave"))
