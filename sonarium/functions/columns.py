"""Column functions: range maps, companding, masks, geometry and travel times, all inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    """v held between two bounds; NaN stays NaN, null stays null."""
    held = F.greatest(lit(low), F.least(lit(high), v))
    return F.when(v.isNull() | F.isnan(v), v).otherwise(held)


def rescale(v: Column, old: tuple, new: tuple = (0.0, 255.0)) -> Column:
    """The affine map of one range onto another; null where the old range is empty."""
    a, b, c, d = (lit(x) for x in (*old, *new))
    return c + F.try_divide((v - a) * (d - c), b - a)


def log_compress(v: Column, low: float = -60.0, high: float = 0.0) -> Column:
    """Decibels, zeros counted as 1e-16, held within the dynamic range; null for negative values."""
    return clip(20 * F.log10(F.when(v == 0, 1e-16).otherwise(v)), low, high)


def inpaint(v: Column, mask: Column, fill: float = 0.0) -> Column:
    """v where the mask holds, else the fill."""
    return F.when(mask, v).otherwise(fill)


def soft_inpaint(v: Column, mask: Column, image_range: tuple, mask_range: tuple = (0.0, 1.0)) -> Column:
    """v moved from its range to the mask's, times the mask, and back."""
    return rescale(rescale(v, image_range, mask_range) * mask, mask_range, image_range)


def to_8bit(v: Column, low: float = -60.0, high: float = 0.0) -> Column:
    return F.floor(rescale(clip(v, low, high), (low, high), (0, 255))).cast("short")


def mu_compress(v: Column, mu: float = 255.0, held: bool = True) -> Column:
    """Values are held in [-1, 1] first, or else follow the law's curve beyond; so do those of mu_expand and the A-law."""
    x = clip(v, -1, 1) if held else v
    return F.signum(x) * F.ln(1 + mu * F.abs(x)) / math.log1p(mu)


def mu_expand(v: Column, mu: float = 255.0, held: bool = True) -> Column:
    x = clip(v, -1, 1) if held else v
    return F.signum(x) * (F.pow(F.lit(1.0 + mu), F.abs(x)) - 1) / mu


def a_compress(v: Column, a: float = 87.6, held: bool = True) -> Column:
    x = clip(v, -1, 1) if held else v
    size, scale = F.abs(x), 1 + math.log(a)
    return F.signum(x) * F.when(size < 1 / a, a * size / scale).otherwise((1 + F.ln(F.greatest(a * size, F.lit(1e-300)))) / scale)


def a_expand(v: Column, a: float = 87.6, held: bool = True) -> Column:
    x = clip(v, -1, 1) if held else v
    size, scale = F.abs(x), 1 + math.log(a)
    return F.signum(x) * F.when(size < 1 / scale, size * scale / a).otherwise(F.exp(size * scale - 1) / a)


def uniform(*what: Column | str) -> Column:
    """A number in [0, 1) that follows from a key alone: the first 32 bits of its md5."""
    text = F.concat_ws(":", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in what))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def order_key(seed: int, *what: Column) -> Column:
    """A key to shuffle by, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(w.cast("string") for w in what)))


def rotate(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """A complex number turned by an angle."""
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def sinc(x: Column, eps: float = 1e-9) -> Column:
    """sin(x) / x, unnormalised, with an offset that keeps it defined at zero."""
    return F.sin(x + eps) / (x + eps)


def window_weight(x: Column, kind: str = "rect", alpha: float = 0.5) -> Column:
    """Weight of an angle that is 1 at the edge of the aperture: rect, hann or tukey; 0 beyond."""
    size = F.abs(x)
    if kind == "rect":
        return F.when(size <= 1, 1.0).otherwise(0.0)
    if kind == "hann":
        return F.when(size <= 1, 0.5 * (1 + F.cos(math.pi * size))).otherwise(0.0)
    if kind == "tukey":
        edge = 0.5 * (1 + F.cos(math.pi / alpha * (size - (1 - alpha))))
        return F.when(size < 1 - alpha, 1.0).when(size <= 1, edge).otherwise(0.0)
    raise ValueError(f"unknown window {kind!r}")


def rtp_to_xyz(rho: Column, theta: Column, phi: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Frustum to cartesian coordinates."""
    t, p = F.tan(theta), F.tan(lit(phi))
    z = rho / F.sqrt(1 + t * t + p * p)
    return z * t, z * p, z


def xyz_to_rtp(x: Column, y: Column, z: Column, theta_limits: tuple | None = None, phi_limits: tuple | None = None) -> tuple[Column, Column, Column]:
    """Cartesian to frustum coordinates; rho is -1 outside the limits."""
    rho, theta, phi = F.sqrt(x * x + y * y + z * z), F.atan2(x, z), F.atan2(y, z)
    for angle, limits in ((theta, theta_limits), (phi, phi_limits)):
        if limits:
            rho = F.when((angle < limits[0]) | (angle > limits[1]), -1.0).otherwise(rho)
    return rho, theta, phi


def cart_to_pol(x: Column, y: Column) -> tuple[Column, Column]:
    """Radius and angle, the angle from the negative y axis, in [0, 2 pi)."""
    return F.sqrt(x * x + y * y), F.pmod(F.atan2(x, -y), F.lit(2 * math.pi))


def turn(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    a = math.radians(degrees)
    return x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def aperture_weight(dx: Column, dz: Column, f_number: float, kind: str = "rect", dy: Column | None = None) -> Column:
    """Receive weight of an element for a pixel: the angle between its axis and the way to the pixel, in all three
    dimensions, over the largest that the f-number allows; f 0: no mask."""
    if f_number == 0:
        return F.lit(1.0)
    dy = F.lit(0.0) if dy is None else dy
    angle = F.acos(dz / (F.sqrt(dx * dx + dy * dy + dz * dz) + 1e-6))
    return window_weight(angle / math.atan(1 / (2 * f_number)), kind)


def with_lens_time(df: DataFrame, out: str, across: Column, depth: Column, thickness: float, c_lens: float, c_medium: float, steps: int = 2) -> DataFrame:
    """df with the travel time from an element at the origin through a lens to a point (across, depth).

    Fermat's crossing of the lens is found by Newton steps of at most 10 mm, held between element and point. Each step
    is a projection of its own: written as one expression it would grow with the power of the steps.
    """
    eps = 1e-6
    x, a, rest = F.col("__x"), F.col("__a"), F.col("__rest")
    df = df.withColumns({"__a": across, "__rest": depth - thickness, "__x": thickness * across / depth})
    for _ in range(steps):
        df = df.withColumns({"__n": F.sqrt(x * x + thickness * thickness), "__f": F.sqrt((a - x) * (a - x) + rest * rest)})
        near, far = F.col("__n"), F.col("__f")
        slope = x / (c_lens * near) + (x - a) / (c_medium * far) + eps
        bend = 1 / (c_lens * near) - x * x / (c_lens * near * near * near + eps) + 1 / (c_medium * far + eps) - (a - x) * (a - x) / (c_medium * far * far * far + eps)
        df = df.withColumn("__d", F.nanvl(-slope / (bend + eps), F.lit(0.0)))
        df = df.withColumn("__x", x + F.greatest(F.lit(-10e-3), F.least(F.lit(10e-3), F.col("__d"))))
        df = df.withColumn("__x", F.greatest(F.least(a, F.lit(0.0)), F.least(F.greatest(a, F.lit(0.0)), x)))
    time = F.sqrt(x * x + thickness * thickness) / c_lens + F.sqrt((a - x) * (a - x) + rest * rest) / c_medium
    return df.withColumn(out, time).drop("__a", "__rest", "__x", "__n", "__f", "__d")


def directivity(f: Column, theta: Column, width: float, speed: float, rigid: bool = True) -> Column:
    """Of a strip element of a width, at a frequency and angle; a soft baffle takes the angle's cosine on top."""
    x = math.pi * width / speed * f * F.sin(theta)
    size = F.abs(x) + 1e-9
    made = F.sin(size) / size
    return made if rigid else made * F.cos(theta)


def attenuation(f: Column, coefficient: float, path: Column) -> Column:
    """Amplitude left after a path in metres, for a coefficient in dB / cm / MHz."""
    return F.exp(-math.log(10) * coefficient / 20 * path * 100 * F.abs(f) * 1e-6)


def spreading(path: Column) -> Column:
    return 1e-4 / F.greatest(path, F.lit(1e-4))


def sector_weight(row: Column, degrees: float) -> Column:
    """Length of a sector's arc at a row."""
    return degrees / 360 * 2 * math.pi * (row + 0.5)


def k_hot(indices: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(indices, i).cast("int"))


def hot_indices(hot: Column, size: int, fill: int = -1) -> Column:
    """Places of the ones, filled up to a size."""
    found = F.filter(F.transform(hot, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.slice(F.concat(found, F.array_repeat(F.lit(fill), size)), 1, size)


def sinusoidal_embedding(x: Column, size: int = 32, low: float = 1.0, high: float = 1000.0) -> Column:
    """Sines, then cosines, of x at frequencies spaced by ratio."""
    half = size // 2
    speeds = [2 * math.pi * math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / max(1, half - 1)) for i in range(half)]
    return F.array(*(F.sin(x * s) for s in speeds), *(F.cos(x * s) for s in speeds))


def once(value: Column, use) -> Column:
    """use(value), the value worked out once a row even where use has it inside a lambda of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rectified_pair(v: Column) -> Column:
    """An array centred, scaled to unit length, and split into its positive and negative parts. Nulls count neither for
    the mean nor for the length, and give 0.

    Mean and length are bound once: written into the lambdas they would be worked out for every number, and the time
    grow with the cube of an array's size.
    """

    def parts(d: Column, norm: Column) -> Column:
        unit = F.transform(d, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
        return once(unit, lambda u: F.concat(F.transform(u, lambda x: F.greatest(x, F.lit(0.0))), F.transform(u, lambda x: F.greatest(-x, F.lit(0.0)))))

    known = F.filter(v, lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    length = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    return once(mean, lambda m: once(F.transform(v, lambda x: x - m), lambda d: once(length(d), lambda n: parts(d, n))))
