"""Delay-and-sum reconstruction on cells.

Pixels, elements and transmits are small tables next to the samples. Silent elements go before anything is paired,
delays are columns, and samples are fetched by two joins on whole places. `deal` spreads pixels over partitions, which
bounds what a task holds and leaves the result as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.functions import columns as C


def linear_probe(spark: SparkSession, n_el: int, pitch: float) -> DataFrame:
    """el, ex, ey, ez of a centred row of elements."""
    return spark.range(n_el).select(F.col("id").cast("int").alias("el"), ((F.col("id") - (n_el - 1) / 2) * pitch).alias("ex"), F.lit(0.0).alias("ey"), F.lit(0.0).alias("ez"))


def pixel_grid(spark: SparkSession, xlims: tuple[float, float], zlims: tuple[float, float], nx: int, nz: int) -> DataFrame:
    """pix (z-major), iz, ix, x, y, z of a cartesian grid with both limits."""
    step = lambda lims, n: (lims[1] - lims[0]) / max(1, n - 1)
    ids = spark.range(nx * nz).select(F.col("id").alias("pix"), F.floor(F.col("id") / nx).cast("int").alias("iz"), (F.col("id") % nx).cast("int").alias("ix"))
    return ids.withColumns({"x": xlims[0] + F.col("ix") * step(xlims, nx), "y": F.lit(0.0), "z": zlims[0] + F.col("iz") * step(zlims, nz)})


def radial_grid(spark: SparkSession, rho: tuple[float, float], theta: tuple[float, float], n_rho: int, n_theta: int) -> DataFrame:
    """The same for a polar grid."""
    grid = pixel_grid(spark, theta, rho, n_theta, n_rho)
    x, _, z = C.rtp_to_xyz(F.col("z"), F.col("x"))
    return grid.withColumns({"x": x, "z": z})


def planewave_delays(tx: DataFrame, probe: DataFrame, speed: float) -> DataFrame:
    """tx, el, t0_delay of plane waves (polar_angle, azimuth_angle): projections over the speed, the least one zero."""
    polar, azimuth = F.col("polar_angle"), F.col("azimuth_angle")
    path = F.col("ex") * F.sin(polar) * F.cos(azimuth) + F.col("ey") * F.sin(polar) * F.sin(azimuth) + F.col("ez") * F.cos(polar)
    return _from_zero(tx, probe, path / speed)


def focused_delays(tx: DataFrame, probe: DataFrame, speed: float) -> DataFrame:
    """The same for waves that meet at focus_distance; behind the probe (negative) they diverge."""
    polar, azimuth, focus = F.col("polar_angle"), F.col("azimuth_angle"), F.col("focus_distance")
    at = (focus * F.sin(polar) * F.cos(azimuth), focus * F.sin(polar) * F.sin(azimuth), focus * F.cos(polar))
    return _from_zero(tx, probe, -F.signum(focus) * C.distance(*zip((F.col("ex"), F.col("ey"), F.col("ez")), at, strict=True)) / speed)


def _from_zero(tx: DataFrame, probe: DataFrame, delay: Column) -> DataFrame:
    pairs = tx.join(F.broadcast(probe))  # transmits by elements: the scheme itself, a few thousand rows
    w = Window.partitionBy("tx")
    return pairs.withColumn("__d", delay).select("tx", "el", (F.col("__d") - F.min("__d").over(w)).alias("t0_delay"))


def deal(pixels: DataFrame, patches: int) -> DataFrame:
    """Pixels in so many partitions."""
    return pixels.repartition(patches, "pix")


def transmit_delays(geometry: DataFrame, firing: DataFrame, speed: float) -> DataFrame:
    """pix, tx, tx_dist: the path of a transmit's wave to a pixel, of first arrival before its focus, of last beyond.

    firing: tx, el, t0_delay, apodization, polar_angle, focus_distance; elements that don't fire are left out first.
    """
    on = firing.filter(F.col("apodization") != 0)
    path = F.col("t0_delay") * speed + F.col("dist")
    side = F.signum(F.col("focus_distance")) * (F.col("z") - F.cos("polar_angle") * F.col("focus_distance"))
    sums = geometry.join(F.broadcast(on), "el").groupBy("pix", "tx").agg(F.min(path).alias("__least"), F.max(path).alias("__most"), F.first(side).alias("__side"))
    return sums.select("pix", "tx", F.when(F.col("__side") <= 0, F.col("__least")).otherwise(F.col("__most")).alias("tx_dist"))


def paths(pixels: DataFrame, probe: DataFrame) -> DataFrame:
    """pix, el and their distance; the probe is small and goes to every pixel."""
    d = C.distance((F.col("x"), F.col("ex")), (F.col("y"), F.col("ey")), (F.col("z"), F.col("ez")))
    return pixels.join(F.broadcast(probe)).withColumn("dist", d)


def time_of_flight(samples: DataFrame, pixels: DataFrame, probe: DataFrame, firing: DataFrame, timing: DataFrame, speed: float, fs: float, n_ax: int, f_number: float = 1.0, window: str = "rect", demodulation: float = 0.0, keys: tuple[str, ...] = (), lens: tuple[float, float] | None = None) -> DataFrame:
    """Aligned cells: keys, tx, pix, el, value (and, of samples with an imaginary part im, im).

    samples: keys, tx, el, ax, value; timing: tx, initial_time. Samples off the record count as zero, so their cells
    are left out. lens is (thickness, speed): then travel times go through it and the initial times are added.
    """
    geometry = paths(pixels, probe)
    if lens is None:
        sent = transmit_delays(geometry, firing, speed).join(F.broadcast(timing), "tx")
        at = geometry.join(sent, "pix").withColumn("s", F.col("dist") / speed * fs + (F.col("tx_dist") / speed - F.col("initial_time")) * fs)
    else:
        across = F.sqrt((F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey")))
        own = C.with_lens_time(geometry, "dist", across, F.col("z") - F.col("ez"), lens[0], lens[1], speed)
        on = firing.filter(F.col("apodization") != 0)
        sent = own.join(F.broadcast(on), "el").groupBy("pix", "tx").agg(F.min(F.col("t0_delay") + F.col("dist")).alias("tx_time"))
        at = own.join(sent, "pix").join(F.broadcast(timing), "tx").withColumn("s", (F.col("dist") + F.col("tx_time") + F.col("initial_time")) * fs)
    at = at.filter((F.col("s") >= 0) & (F.col("s") < n_ax - 1)).withColumn("ax", F.floor("s").cast("int"))
    at = at.withColumn("weight", C.aperture_weight(F.col("x") - F.col("ex"), F.col("z") - F.col("ez"), f_number, window, F.col("y") - F.col("ey"))).filter("weight <> 0")
    at = at.select("pix", "tx", "el", "ax", (F.col("ax") + 1).alias("ax1"), (F.col("s") - F.col("ax")).alias("share"), "weight", (F.col("s") / fs).alias("time"))
    parts = [c for c in ("value", "im") if c in samples.columns]
    one = samples.select(*keys, "tx", "el", "ax", *(F.col(c).alias(f"{c}0") for c in parts))
    two = samples.select(*keys, "tx", "el", F.col("ax").alias("ax1"), *(F.col(c).alias(f"{c}1") for c in parts))
    joined = at.join(one, ["tx", "el", "ax"]).join(two, [*keys, "tx", "el", "ax1"])
    made = {c: F.col("weight") * ((1 - F.col("share")) * F.col(f"{c}0") + F.col("share") * F.col(f"{c}1")) for c in parts}
    joined = joined.withColumns(made)
    if demodulation and "im" in parts:  # a carrier that was mixed out comes back as a turn; real samples have none
        re, im = C.rotate(F.col("value"), F.col("im"), 2 * math.pi * demodulation * F.col("time"))
        joined = joined.withColumns({"value": re, "im": im})
    return joined.select(*keys, "tx", "pix", "el", *parts)


def pfield_weighting(aligned: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Aligned cells times a weight (pix, tx, weight) of the transmit's field; None leaves them."""
    if weights is None:
        return aligned
    joined = aligned.join(weights, ["pix", "tx"])
    return joined.withColumns({c: F.col(c) * F.col("weight") for c in ("value", "im") if c in aligned.columns}).drop("weight")


def normalize_pressure(field: DataFrame, alpha: float = 1.0, percentile: float = 10.0) -> DataFrame:
    """pix, tx, weight of pressures (pix, tx, p): what is under a transmit's percentile is zero, the rest is raised to
    a power and divided by the pixel's sum over transmits."""
    cut = field.groupBy("tx").agg(F.percentile("p", F.lit(percentile / 100)).alias("__cut"))
    held = field.join(F.broadcast(cut), "tx").withColumn("p", F.pow(F.when(F.col("p") < F.col("__cut"), 0.0).otherwise(F.col("p")), F.lit(alpha)))
    return held.select("pix", "tx", (F.col("p") / (2.220446049250313e-16 + F.sum("p").over(Window.partitionBy("pix")))).alias("weight"))


def delay_and_sum(aligned: DataFrame, pixels: DataFrame, keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """Pixels with the sum of their aligned cells over elements and transmits; zero where there is none."""
    parts = [c for c in ("value", "im") if c in aligned.columns]
    sums = aligned.groupBy(*keys, "pix").agg(*(F.sum(c).alias(c) for c in parts))
    grid = pixels if groups is None else groups.crossJoin(pixels)  # a frame's pixels, for each frame: the result's own rows
    return grid.join(sums, [*keys, "pix"], "left").na.fill(0.0, parts)


def aliased(grid_steps: tuple[float, ...], wavelength: float) -> list[int]:
    """The axes of a grid along which a pixel is larger than half a wavelength."""
    return [i for i, step in enumerate(grid_steps) if step > wavelength / 2]
