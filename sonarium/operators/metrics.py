"""Image quality metrics as aggregates over cells; statistics are those of the population."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.operators.cells import gradient


def _decibel(x: Column) -> Column:
    return 20 * F.log10(F.when(x > 0, x))


def _of(mask: str, inside: bool, v: Column) -> Column:
    return F.when(F.col(mask) if inside else ~F.col(mask), v)


def cnr(value: str, mask: str) -> Column:
    """Contrast to noise between where a mask holds and where it doesn't."""
    a, b = (_of(mask, m, F.col(value)) for m in (True, False))
    return _decibel(F.try_divide(F.abs(F.avg(a) - F.avg(b)), F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)))


def contrast(value: str, mask: str) -> Column:
    return _decibel(F.try_divide(F.avg(_of(mask, True, F.col(value))), F.avg(_of(mask, False, F.col(value)))))


def snr(value: str) -> Column:
    return F.try_divide(F.avg(value), F.stddev_pop(value))


def wopt_mae(ref: str, img: str) -> Column:
    """The factor with the least absolute error: the median ratio."""
    return F.percentile(F.try_divide(F.col(ref), F.col(img)), F.lit(0.5))


def wopt_mse(ref: str, img: str) -> Column:
    return F.try_divide(F.sum(F.col(ref) * F.col(img)), F.sum(F.col(img) * F.col(img)))


def l1loss(a: str, b: str) -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def l2loss(a: str, b: str) -> Column:
    """The root of the mean square."""
    return F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))


def psnr(a: str, b: str) -> Column:
    span = F.greatest(F.max(a), F.max(b)) - F.least(F.min(a), F.min(b))
    return _decibel(F.try_divide(span, l2loss(a, b)))


def ncc(a: str, b: str) -> Column:
    return F.try_divide(F.sum(F.col(a) * F.col(b)), F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b))))


def fwhm(value: str, place: str, half: str) -> Column:
    """The width of what is at least half of the maximum; half names a column with that level."""
    at = F.when(F.col(value) >= F.col(half), F.col(place))
    return F.max(at) - F.min(at)


def smsle(a: str, b: str, dynamic_range: float = 60.0, eps: float = 1e-7) -> Column:
    """Mean squared error of clipped decibels, of positive and negative parts, half each."""

    def part(sign: int) -> Column:
        db = lambda v: F.greatest(F.lit(-dynamic_range), 20 * F.log10(F.greatest(sign * F.col(v), F.lit(eps))))
        return F.avg((db(a) - db(b)) * (db(a) - db(b)))

    return (part(1) + part(-1)) / 2


def circle_recovery(value: str, inside: str, fill: float, within: float) -> Column:
    hit = F.when(F.col(inside) & (F.abs(F.col(value) - fill) <= within), 1.0).otherwise(0.0)
    return F.sum(hit) / (F.sum(F.when(F.col(inside), 1.0).otherwise(0.0)) + 1e-8)


def _bucket(value: str, low: str, high: str, bins: int) -> Column:
    """Number of the equal-width bin, the last one closed; the first, where the range is empty."""
    share = F.try_divide((F.col(value) - F.col(low)) * bins, F.col(high) - F.col(low))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(bins - 1))


def _binned(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    spans = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    joined = df.join(spans, keys) if keys else df.crossJoin(F.broadcast(spans))  # one row
    return joined.withColumn("__bin", _bucket(value, "__low", "__high", bins))


def gcnr(df: DataFrame, keys: list[str], value: str, mask: str, bins: int = 256) -> DataFrame:
    """One less the overlap of two histograms over their common range."""
    share = lambda m: F.count(F.when(m, 1))
    counts = _binned(df, keys, value, bins).groupBy(*keys, "__bin").agg(share(F.col(mask)).alias("f"), share(~F.col(mask)).alias("g"))
    totals = df.groupBy(*keys).agg(share(F.col(mask)).alias("nf"), share(~F.col(mask)).alias("ng"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))  # one row
    overlap = F.sum(F.least(F.try_divide(F.col("f"), F.col("nf")), F.try_divide(F.col("g"), F.col("ng"))))
    return joined.groupBy(*keys).agg((1 - overlap).alias("gcnr"))


def entropy(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Bits of the histogram over the value's range."""
    counts = _binned(df, keys, value, bins).groupBy(*keys, "__bin").agg(F.count("*").alias("n"))
    # -sum(p log2 p) with p = n / N is log2 N - sum(n log2 n) / N
    return counts.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def sharpness(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The mean size of the slopes along both axes."""
    slopes = df.select(*keys, F.abs(gradient(df, [*keys, "x"], "z", value)).alias("gz"), F.abs(gradient(df, [*keys, "z"], "x", value)).alias("gx"))
    return slopes.groupBy(*keys).agg(((F.avg("gz") + F.avg("gx")) / 2).alias("sharpness"))


def speckle_res(*_: object) -> Column:
    raise NotImplementedError("speckle resolution has no definition")


def lpips(*_: object) -> Column:
    raise NotImplementedError("needs a network's weights, which are not part of this library")


#: Name, function, and whether it compares two regions or images.
METRICS: dict[str, tuple[Callable, bool]] = {
    "cnr": (cnr, True), "contrast": (contrast, True), "gcnr": (gcnr, True), "fwhm": (fwhm, False), "speckle_res": (speckle_res, False), "snr": (snr, False),
    "wopt_mae": (wopt_mae, True), "wopt_mse": (wopt_mse, True), "l1loss": (l1loss, True), "l2loss": (l2loss, True), "psnr": (psnr, True), "ncc": (ncc, True),
    "image_entropy": (entropy, False), "image_sharpness": (sharpness, False), "smsle": (smsle, True), "lpips": (lpips, True),
}
