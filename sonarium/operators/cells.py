"""Operators on cells: one row per array element, its coordinates in columns and its value in another.

Everything is joins, windows and aggregates on coordinates, so it runs at any size and in any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.functions import columns as C


def from_arrays(df: DataFrame, values: str, keep: list[str], width: int | None = None, value: str = "value") -> DataFrame:
    """Cells of an array column: pos, or z and x if a width is given."""
    cells = df.select(*keep, F.posexplode(values).alias("pos", value))
    if width is None:
        return cells
    return cells.select(*keep, F.floor(F.col("pos") / width).cast("int").alias("z"), (F.col("pos") % width).alias("x"), value)


def to_arrays(cells: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """An array a group, its values in order of the coordinates."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return cells.groupBy(*by).agg(F.transform(rows, lambda r: r[value]).alias(value))


def with_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """df with aggregates of its groups, or of all of it, beside every row: one aggregation, one small join."""
    found = df.groupBy(*by).agg(*(c.alias(n) for n, c in stats.items()))
    if by:
        return df.join(found, by)
    row = found.first()
    return df.withColumns({n: F.lit(row[n]) for n in stats})


def normalize(df: DataFrame, value: str, output: tuple[float, float] = (0.0, 1.0), given: tuple[float, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """value mapped from its range, given or found (over all rows, or each group), onto another; also minval, maxval."""
    if given:
        df = df.withColumns({"minval": F.lit(float(given[0])), "maxval": F.lit(float(given[1]))})
    else:
        df = with_stats(df, list(by), minval=F.min(value), maxval=F.max(value))
    held = C.clip(F.col(value), F.col("minval"), F.col("maxval"))
    return df.withColumn(value, C.rescale(held, (F.col("minval"), F.col("maxval")), output))


def threshold(df: DataFrame, value: str, kind: str = "hard", below: bool = True, fill: str | float = "min", at: float | None = None, percentile: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Values below (or above) a threshold replaced (hard) or all moved by it (soft); fill: min, max, threshold, number."""
    if (at is None) == (percentile is None):
        raise ValueError("give either a threshold or a percentile")
    if kind not in ("hard", "soft"):
        raise ValueError(f"unknown kind {kind!r}")
    stats = {"__min": F.min(value), "__max": F.max(value)}
    if percentile is not None and by:
        stats["__at"] = F.percentile(value, F.lit(percentile / 100))
    elif percentile is not None:
        at = quantile(df, value, percentile / 100)
    df = with_stats(df, list(by), **stats)
    t = F.col("__at") if "__at" in stats else F.lit(at).cast("double")
    filled = {"min": F.col("__min"), "max": F.col("__max"), "threshold": t}.get(fill) if isinstance(fill, str) else F.lit(float(fill))
    v = F.col(value)
    if kind == "hard":
        made = F.when(v < t if below else v > t, filled).otherwise(v)
    else:
        made = (F.greatest(v - t, F.lit(0.0)) if below else F.least(v - t, F.lit(0.0))) + filled
    return df.withColumn(value, made).drop(*stats)


def reduce_axis(df: DataFrame, axes: list[str], value: str, how: str | tuple[str, ...] = "sum") -> DataFrame:
    """Sum, mean, min, max or l2 (the root of the sum of squares) over the axes that aren't named, as value; of several
    ways a column each, named by them, in one aggregation."""
    made = {"sum": F.sum(value), "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "l2": F.sqrt(F.sum(F.col(value) * F.col(value)))}
    if isinstance(how, str):
        return df.groupBy(*axes).agg(made[how].alias(value))
    return df.groupBy(*axes).agg(*(made[h].alias(h) for h in how))


def delay_and_sum(df: DataFrame, axes: list[str], value: str, *weights: str) -> DataFrame:
    """The sum of the values times their weights, over elements and transmits."""
    made = F.col(value)
    for w in weights:
        made = made * F.col(w)
    return df.groupBy(*axes).agg(F.sum(made).alias(value))


def stack(frames: dict[str, DataFrame], axis: str = "source") -> DataFrame:
    """Equal cells of several tensors, told apart by a new axis."""
    parts = [df.withColumn(axis, F.lit(i)) for i, df in enumerate(frames.values())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Columns of both by id; of a column that both have, the right one's, where it is not null."""
    both = [c for c in left.columns if c in right.columns and c not in ids]
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in both})
    joined = left.join(renamed, ids, "full")
    for c in both:
        joined = joined.withColumn(c, F.coalesce(f"__right_{c}", c))
    return joined.drop(*(f"__right_{c}" for c in both))


def downsample(df: DataFrame, axis: str, factor: int = 1, phase: int = 0) -> DataFrame:
    """Every factor-th sample from the phase on, renumbered."""
    a = F.col(axis)
    return df.filter((a >= phase) & ((a - phase) % factor == 0)).withColumn(axis, F.floor((a - phase) / factor).cast(df.schema[axis].dataType))


def pad(df: DataFrame, groups: DataFrame, shape: dict[str, tuple[int, int]], value: str = "value", fill: float = 0.0, centred: bool = True) -> DataFrame:
    """Cells of a larger array: shape maps an axis to its old and new length; what is over half goes after.

    groups: a row for each array. A new length below the old one raises.
    """
    grid, moved = groups, df
    for axis, (old, new) in shape.items():
        if new < old:
            raise ValueError(f"axis {axis}: {new} is less than {old}")
        before = (new - old) // 2 if centred else 0
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(new - 1))))
        moved = moved.withColumn(axis, F.col(axis) + before)
    keys = [*groups.columns, *shape]
    return grid.join(moved.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def crop(df: DataFrame, shape: dict[str, tuple[int, int]]) -> DataFrame:
    """The middle of an array: shape maps an axis to its old and new length."""
    for axis, (old, new) in shape.items():
        start = (old - new) // 2
        df = df.filter(F.col(axis).between(start, start + new - 1)).withColumn(axis, F.col(axis) - start)
    return df


def roll(df: DataFrame, axis: str, length: int, by: int) -> DataFrame:
    return df.withColumn(axis, F.pmod(F.col(axis) + by, F.lit(length)))


def _starts(axis: str, length: int, size: int, overlap: int) -> Column:
    """Numbers of the patches that a coordinate lies in."""
    step = size - overlap
    last = (length - size) // step
    low = F.greatest(F.lit(0), F.ceil((F.col(axis) - size + 1) / step).cast("int"))
    high = F.least(F.lit(last), F.floor(F.col(axis) / step).cast("int"))
    return F.when(low <= high, F.sequence(low, high))


def to_patches(df: DataFrame, shape: tuple[int, int], size: tuple[int, int], overlap: tuple[int, int] = (0, 0)) -> DataFrame:
    """Cells of patches i, j (from the top, from the left), with places pz, px in them; what doesn't fit is left out."""
    df = df.withColumn("i", F.explode(_starts("z", shape[0], size[0], overlap[0]))).withColumn("j", F.explode(_starts("x", shape[1], size[1], overlap[1])))
    return df.withColumns({"pz": F.col("z") - F.col("i") * (size[0] - overlap[0]), "px": F.col("x") - F.col("j") * (size[1] - overlap[1])}).drop("z", "x")


def from_patches(patches: DataFrame, keep: list[str], size: tuple[int, int], overlap: tuple[int, int] = (0, 0), value: str = "value", how: str = "average") -> DataFrame:
    """The array that patches make: where they overlap their average, or the last one's value."""
    placed = patches.withColumns({"z": F.col("pz") + F.col("i") * (size[0] - overlap[0]), "x": F.col("px") + F.col("j") * (size[1] - overlap[1])})
    if how == "average":
        return placed.groupBy(*keep, "z", "x").agg(F.avg(value).alias(value))
    last = F.max(F.struct("i", "j", value))[value]
    return placed.groupBy(*keep, "z", "x").agg(last.alias(value))


def patch_overlap(length: int, size: int, count: int) -> float:
    """The overlap with which a number of patches just fill a length."""
    return size - (length - size) / (count - 1) if count > 1 else 0.0


def patches_fit(length: int, size: int, overlap: int) -> bool:
    return (length - size) % (size - overlap) == 0


def fold_axis(df: DataFrame, outer: str, inner: str, length: int, into: str) -> DataFrame:
    """Two axes made one."""
    return df.withColumn(into, F.col(outer) * length + F.col(inner)).drop(*({outer, inner} - {into}))


def unfold_axis(df: DataFrame, axis: str, length: int, outer: str, inner: str) -> DataFrame:
    return df.withColumns({outer: F.floor(F.col(axis) / length).cast("int"), inner: (F.col(axis) % length).cast("int")}).drop(*({axis} - {outer, inner}))


def resample(df: DataFrame, groups: DataFrame, axis: str, old: int, new: int, value: str = "value") -> DataFrame:
    """Values at new evenly spaced places along an axis, by linear interpolation between neighbours."""
    step = (old - 1) / (new - 1) if new > 1 else 0.0
    places = groups.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(new - 1)))).withColumn("__p", F.col("__k") * step)
    low = F.least(F.floor("__p"), F.lit(old - 1)).cast("int")
    places = places.withColumns({"__i": low, "__f": F.col("__p") - low})
    return interpolate(places, df, groups.columns, axis, "__i", "__f", old, value).withColumn(axis, F.col("__k")).select(*groups.columns, axis, value)


def interpolate(places: DataFrame, df: DataFrame, keys: list[str], axis: str, at: str, share: str, length: int, value: str) -> DataFrame:
    """places with the value between a cell and the next one, in proportion to a share: two joins on whole places."""
    one = df.select(*keys, F.col(axis).alias(at), F.col(value).alias("__a"))
    two = df.select(*keys, F.col(axis).alias("__next"), F.col(value).alias("__b"))
    found = places.withColumn("__next", F.least(F.col(at) + 1, F.lit(length - 1))).join(one, [*keys, at]).join(two, [*keys, "__next"])
    return found.withColumn(value, (1 - F.col(share)) * F.col("__a") + F.col(share) * F.col("__b")).drop("__a", "__b", "__next")


def gaussian_kernel(sigma: float, truncate: float = 4.0, order: int = 0) -> list[float]:
    """Weights from -r to r of a normalised Gaussian, or of its first derivative."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(raw)
    return [w / total * (1 if order == 0 else k / sigma**2) for k, w in zip(range(-r, r + 1), raw, strict=True)]


def filter_axis(df: DataFrame, keys: list[str], axis: str, length: str, kernel: list[float], value: str = "value") -> DataFrame:
    """Values correlated with a kernel along an axis, mirrored at both ends; length names a column with the axis's.

    One window holds a cell's neighbours, among which its mirrored ones are, too: one sort by the keys, no join.
    """
    r = len(kernel) // 2
    near = F.collect_list(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys).orderBy(axis).rowsBetween(-r, r))
    n, at, first = F.col(length), F.col(axis), F.col(axis) - F.least(F.col(axis), F.lit(r))
    df = df.withColumn("__near", near)

    def tap(k: int, w: float) -> Column:
        place = F.pmod(at + k, 2 * n)
        source = F.when(place < n, place).otherwise(2 * n - 1 - place)
        return w * F.get("__near", (source - first).cast("int"))["v"]

    total = tap(-r, kernel[0])
    for k in range(-r + 1, r + 1):
        total = total + tap(k, kernel[k + r])
    return df.select(*keys, axis, total.alias(value))


def quantile(df: DataFrame, value: str, share: float, ranges: int = 4096, few: int = 50_000) -> float | None:
    """The exact quantile, between ranks by proportion, of a column; null and NaN left out, of none nothing.

    Ranges of values are counted, then those of the range that holds the rank, until few rows are left: what a task or
    the driver holds doesn't grow with the rows.
    """
    v = F.col(value).cast("double")
    inner = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    row = inner.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not row["n"]:
        return None
    rank, n, low, high, least = share * (row["n"] - 1), row["n"], row["low"], row["high"], 0
    while n > few and high > low:
        at = F.least(F.floor((F.col("v") - low) / (high - low) * ranges), F.lit(ranges - 1))
        ranged = inner.withColumn("r", at)
        counts = sorted((x["r"], x["n"], x["low"], x["high"]) for x in ranged.groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for i, (r, n, low, high) in enumerate(counts):
            if least + n > rank:
                break
            least += n
        if rank - least > n - 1 and i + 1 < len(counts):  # between this range's last and the next one's first
            return high + (rank - least - (n - 1)) * (counts[i + 1][2] - high)
        inner = ranged.filter(F.col("r") == r).select("v")
    if low == high:
        return low
    held = sorted(x["v"] for x in inner.collect())
    k = min(int(rank - least), len(held) - 1)
    return held[k] + (rank - least - k) * (held[min(k + 1, len(held) - 1)] - held[k])


def gradient(df: DataFrame, keys: list[str], axis: str, value: str = "value") -> Column:
    """The slope along an axis as a column: central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def fill_lines(df: DataFrame, keys: list[str], axis: str, value: str = "value") -> DataFrame:
    """Null values filled between the known ones on either side, in proportion; beyond the last, with it."""
    before = Window.partitionBy(*keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(axis).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(axis))
    df = df.withColumns({"__l": F.last(value, True).over(before), "__la": F.last(at, True).over(before), "__r": F.first(value, True).over(after), "__ra": F.first(at, True).over(after)})
    share = F.try_divide(F.col(axis) - F.col("__la"), F.col("__ra") - F.col("__la"))
    made = F.coalesce(F.col("__l") + F.coalesce(share, F.lit(0.0)) * (F.col("__r") - F.col("__l")), "__l", "__r")
    return df.withColumn(value, made).drop("__l", "__la", "__r", "__ra")


def unwrap(df: DataFrame, keys: list[str], axis: str, value: str = "value") -> DataFrame:
    """Phases made continuous: jumps of more than pi are taken back from there on."""
    w = Window.partitionBy(*keys).orderBy(axis)
    jump = F.col(value) - F.lag(value).over(w)
    turns = F.coalesce(-F.floor((jump + math.pi) / (2 * math.pi)), F.lit(0))
    df = df.withColumn("__turns", turns)
    return df.withColumn(value, F.col(value) + 2 * math.pi * F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turns")


def covariance(df: DataFrame, keys: list[str], observation: str, variable: str, value: str = "value", ddof: int = 1) -> DataFrame:
    """Covariances of all pairs of variables i, j over the observations they share."""
    left = df.select(*keys, observation, F.col(variable).alias("i"), F.col(value).alias("__a"))
    right = df.select(*keys, observation, F.col(variable).alias("j"), F.col(value).alias("__b"))
    made = F.covar_samp("__a", "__b") if ddof == 1 else F.covar_pop("__a", "__b")
    return left.join(right, [*keys, observation]).groupBy(*keys, "i", "j").agg(made.alias("cov"))


def first_nonzero(df: DataFrame, keys: list[str], axis: str, value: str = "value", invalid: int = -1) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(value) != 0, F.col(axis))), F.lit(invalid)).alias("first"))


def is_monotonic(df: DataFrame, keys: list[str], axis: str, value: str = "value", increasing: bool = True) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(axis)
    step = F.col(value) - F.lag(value).over(w)
    held = F.coalesce(step >= 0 if increasing else step <= 0, F.lit(True))
    return df.withColumn("__held", held).groupBy(*keys).agg(F.bool_and("__held").alias("monotonic"))


def scan_convert(df: DataFrame, groups: DataFrame, rows: int, cols: int, rho: tuple[float, float], theta: tuple[float, float], resolution: float | None = None, fill: float = 0.0, value: str = "value") -> DataFrame:
    """A polar image (z: rho, x: theta) on a cartesian grid iz, ix, by bilinear interpolation; outside it, the fill.

    The default resolution is the mean of the arc at a quarter of the depth and the radial step. The grid is made on
    the executors and dealt with the images; corners are joined by place.
    """
    d_rho, d_theta = (rho[1] - rho[0]) / (rows - 1), (theta[1] - theta[0]) / (cols - 1)
    resolution = resolution or (0.25 * (rho[0] + rho[1]) * d_theta + d_rho) / 2
    corners = [(r, t) for r in rho for t in [theta[0] + k * d_theta for k in range(cols)]]
    xs, zs = [r * math.sin(t) for r, t in corners], [r * math.cos(t) for r, t in corners]
    nx, nz = (math.ceil((max(v) - min(v)) / resolution) for v in (xs, zs))
    grid = groups.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))))
    x, z = min(xs) + F.col("ix") * resolution, min(zs) + F.col("iz") * resolution
    r, t, _ = C.xyz_to_rtp(x, F.lit(0.0), z, theta)
    grid = grid.withColumns({"__r": (r - rho[0]) / (rho[1] - rho[0]) * (rows - 1), "__t": (t - theta[0]) / (theta[1] - theta[0]) * (cols - 1)})
    grid = grid.withColumns({"__r0": F.floor("__r").cast("int"), "__t0": F.floor("__t").cast("int")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    grid = grid.withColumn("__c", corner).withColumns({"z": F.col("__r0") + F.col("__c.a"), "x": F.col("__t0") + F.col("__c.b")})
    near = lambda p, k: 1 - F.abs(F.col(p) - F.col(k))
    joined = grid.join(df.select(*groups.columns, "z", "x", value), [*groups.columns, "z", "x"], "left")
    weighted = F.sum(near("__r", "z") * near("__t", "x") * F.coalesce(value, F.lit(fill)))
    return joined.groupBy(*groups.columns, "iz", "ix").agg(weighted.alias(value))


def extents(df: DataFrame, keys: list[str], value: str = "value", above: float = 15.0, least: int = 5) -> DataFrame:
    """The left and right edge of each row of an image: first and last x above a level, of rows wider than least."""
    found = df.filter(F.col(value) > above).groupBy(*keys, "z").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    return found.filter(F.col("right") - F.col("left") > least)


def fit_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares lines of both edges of a scan cone, x over z, and where they meet (the apex)."""
    fits = {f"{side}_{what}": f(side, "z") for side in ("left", "right") for what, f in (("slope", F.regr_slope), ("offset", F.regr_intercept))}
    found = edges.groupBy(*keys).agg(*(c.alias(n) for n, c in fits.items()))
    apex = F.try_divide(F.col("right_offset") - F.col("left_offset"), F.col("left_slope") - F.col("right_slope"))
    return found.withColumns({"apex_z": apex, "apex_x": F.col("left_offset") + F.col("left_slope") * apex})


def circle_inclusion(df: DataFrame, image: str, shape: tuple[int, int], radius: int, fill: float, seed: int = 0, value: str = "value") -> DataFrame:
    """A filled circle in every image, its centre following from seed and image; also in_circle."""
    centre = lambda n, axis: radius + F.floor(C.uniform(str(seed), axis, F.col(image)) * (n - 2 * radius))
    dz, dx = F.col("z") - centre(shape[0], "z"), F.col("x") - centre(shape[1], "x")
    inside = dz * dz + dx * dx <= radius * radius
    return df.withColumn("in_circle", inside).withColumn(value, F.when(inside, fill).otherwise(F.col(value)))


def salt_and_pepper(df: DataFrame, ids: list[str], salt: float, pepper: float, seed: int, value: str = "value") -> DataFrame:
    """Some values set to 1, then some to 0, as seed and ids have it."""
    u = C.uniform(str(seed), *(F.col(i) for i in ids))
    return df.withColumn(value, F.when(u < pepper, 0.0).when(u < salt, 1.0).otherwise(F.col(value)))
