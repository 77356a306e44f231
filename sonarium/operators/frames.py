"""Whole-frame numerics on blocks: a row per frame, with its shape and its values (row-major).

Functions take and return NumPy arrays; `on_frames` runs a chain of them over Arrow batches, all in one pass, so that
neighbouring steps share one trip to the Python workers. Frames don't depend on one another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[np.ndarray], np.ndarray]


def on_frames(df: DataFrame, steps: list[Step], shape: str = "shape", data: str = "data") -> DataFrame:
    """df with every frame taken through the steps; rows with a null frame stay as they are."""
    places = df.columns.index(shape), df.columns.index(data)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            shapes, values = columns[places[0]], columns[places[1]]
            new_shapes, new_values = [], []
            for i in range(batch.num_rows):
                dims = shapes[i].as_py()
                if dims is None or not values[i].is_valid:
                    new_shapes.append(dims)
                    new_values.append(None)
                    continue
                frame = values[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(dims)
                for step in steps:
                    frame = step(frame)
                new_shapes.append(list(frame.shape))
                new_values.append(np.ascontiguousarray(frame).ravel())
            columns[places[0]], columns[places[1]] = pa.array(new_shapes, shapes.type), pa.array(new_values, values.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def as_complex(x: np.ndarray) -> np.ndarray:
    """Two channels, last, to complex numbers."""
    return x[..., 0] + 1j * x[..., 1]


def as_channels(x: np.ndarray) -> np.ndarray:
    return np.stack((x.real, x.imag), axis=-1)


def analytic(x: np.ndarray, n: int | None = None, axis: int = -1) -> np.ndarray:
    """The analytic signal, its spectrum taken over n samples (zeros after the signal's own)."""
    own = x.shape[axis]
    n = own if n is None else n
    if n < own:
        raise ValueError("n is less than the number of samples")
    spectrum = np.fft.fft(x, n, axis=axis)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(spectrum * gain.reshape([-1 if i == axis % x.ndim else 1 for i in range(x.ndim)]), axis=axis)


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def envelope(x: np.ndarray, axis: int = 0) -> np.ndarray:
    """Of real samples (1 channel, last) by the analytic signal, of complex ones (2 channels) by their size."""
    if x.shape[-1] == 2:
        return np.hypot(x[..., 0], x[..., 1])
    own = x[..., 0]
    return np.abs(np.take(analytic(own, power_of_two(own.shape[axis]), axis), range(own.shape[axis]), axis))


def _along(x: np.ndarray, axis: int, v: np.ndarray) -> np.ndarray:
    return v.reshape([-1 if i == axis % x.ndim else 1 for i in range(x.ndim)])


def demodulate(x: np.ndarray, fs: float, fc: float, axis: int = 0) -> np.ndarray:
    """Real samples (1 channel) to baseband (2 channels)."""
    own = x[..., 0]
    turn = np.exp(-2j * math.pi * fc / fs * np.arange(own.shape[axis]))
    return as_channels(analytic(own, axis=axis) * _along(own, axis, turn))


def upmix(x: np.ndarray, fs: float, fc: float, rate: int = 6, axis: int = 0) -> np.ndarray:
    """Baseband (2 channels) back on its carrier, resampled to a rate; real samples pass."""
    if x.shape[-1] == 1:
        return x
    own = resample(as_complex(x), x.shape[axis] * rate, axis)
    turn = np.exp(2j * math.pi * fc / (fs * rate) * np.arange(own.shape[axis]))
    return (own * _along(own, axis, turn)).real[..., None] * math.sqrt(2)


def resample(x: np.ndarray, n: int, axis: int = 0) -> np.ndarray:
    """Values at n evenly spaced places, the ends included, by linear interpolation."""
    at = np.linspace(0, x.shape[axis] - 1, n)
    low = np.minimum(at.astype(int), x.shape[axis] - 1)
    high = np.minimum(low + 1, x.shape[axis] - 1)
    share = _along(x, axis, at - low)
    return np.take(x, low, axis) * (1 - share) + np.take(x, high, axis) * share


def fir_band(taps: int, fs: float, low: float, high: float) -> np.ndarray:
    """Windowed-sinc band pass, unit gain in the middle of its band."""
    n = np.arange(taps) - (taps - 1) / 2
    ideal = lambda f: 2 * f / fs * np.sinc(2 * f / fs * n)
    h = (ideal(high) - ideal(low)) * np.hamming(taps)
    middle = (low + high) / 2 if low else 0.0
    return h / np.sum(h * np.cos(2 * math.pi * middle / fs * n))


def fir_low_iq(taps: int, fs: float, cutoff: float, f: float) -> np.ndarray:
    """A low pass moved to a frequency: complex taps for baseband samples."""
    return fir_band(taps, fs, 0.0, cutoff) * np.exp(2j * math.pi * f / fs * np.arange(taps))


def convolved(x: np.ndarray, taps: np.ndarray, axis: int = 0) -> np.ndarray:
    """A filter's output of the samples' own length, centred."""
    return np.apply_along_axis(lambda v: np.convolve(v, taps, "same"), axis, x)


def gaussian(x: np.ndarray, sigma: float, axis: int, order: int = 0, truncate: float = 4.0, mode: str = "symmetric", cval: float = 0.0) -> np.ndarray:
    """Correlation with a Gaussian (order 0) or its first derivative along an axis."""
    from sonarium.operators.cells import gaussian_kernel

    kernel = np.array(gaussian_kernel(sigma, truncate, order))
    r = len(kernel) // 2
    widths = [(r, r) if i == axis % x.ndim else (0, 0) for i in range(x.ndim)]
    wide = np.pad(x, widths, mode=mode, **({"constant_values": cval} if mode == "constant" else {}))
    return sum(w * np.take(wide, range(k, k + x.shape[axis]), axis) for k, w in enumerate(kernel))


def gaussian_blur(x: np.ndarray, sigma: float, truncate: float = 4.0, mode: str = "symmetric") -> np.ndarray:
    """Blurred along both image axes, the first two; channels, if any, each for itself."""
    return gaussian(gaussian(x, sigma, 0, 0, truncate, mode), sigma, 1, 0, truncate, mode)


def lee_filter(x: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Smoothed where the local variance is small next to the image's."""
    mean = gaussian_blur(x, sigma)
    local = gaussian_blur(x * x, sigma) - mean * mean
    share = local / (local + x.var(axis=(0, 1), keepdims=True) + 1e-30)
    return mean + share * (x - mean)


def anisotropic_diffusion(x: np.ndarray, steps: int = 100, rate: float = 0.1, rect: tuple[int, int, int, int] | None = None, eps: float = 1e-6) -> np.ndarray:
    """Speckle-reducing diffusion of an image in log scale; rect marks a homogeneous region (rows x1:x2, columns y1:y2).

    Without rect the conductance follows from the denominator of the speckle index alone.
    """
    u = np.exp(x)
    for _ in range(steps):
        wide = np.pad(u, 1)
        down, up, right, left = wide[2:, 1:-1] - u, wide[:-2, 1:-1] - u, wide[1:-1, 2:] - u, wide[1:-1, :-2] - u
        pull = (down + up + right + left) / (u + eps)
        index = (1 + pull / 4) ** 2
        if rect is not None:
            part = u[rect[0] : rect[2], rect[1] : rect[3]]
            calm = (part.std() / (part.mean() + eps)) ** 2
            energy = (down**2 + up**2 + right**2 + left**2) / (u * u + eps)
            index = ((0.5 * energy - pull * pull / 16) / (index + eps) - calm) / (calm * (1 + calm) + eps)
        c = 1 / (1 + index)
        before = np.pad(c, 1)
        flow = c * (down + right) + before[:-2, 1:-1] * up + before[1:-1, :-2] * left
        u = u + rate / 4 * flow
    return np.log(u)


def sample_at(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """Values of an image at places between its cells, nearest (0) or bilinear (1); cells outside count as the fill."""
    if order not in (0, 1):
        raise NotImplementedError("splines of higher order are not supported")
    if order == 0:
        r, c = np.rint(rows).astype(int), np.rint(cols).astype(int)
        inside = (r >= 0) & (r < x.shape[0]) & (c >= 0) & (c < x.shape[1])
        return np.where(inside, x[np.clip(r, 0, x.shape[0] - 1), np.clip(c, 0, x.shape[1] - 1)], fill)
    wide = np.pad(x, 1, constant_values=fill)
    rows, cols = np.clip(rows + 1, 0, wide.shape[0] - 1.0), np.clip(cols + 1, 0, wide.shape[1] - 1.0)
    r, c = np.minimum(rows.astype(int), wide.shape[0] - 2), np.minimum(cols.astype(int), wide.shape[1] - 2)
    a, b = rows - r, cols - c
    return (1 - a) * ((1 - b) * wide[r, c] + b * wide[r, c + 1]) + a * ((1 - b) * wide[r + 1, c] + b * wide[r + 1, c + 1])


def scan_convert(x: np.ndarray, rho: tuple[float, float], theta: tuple[float, float], resolution: float | None = None, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """A polar image (rho, theta) on a cartesian grid (z, x)."""
    r, t = np.linspace(*rho, x.shape[0]), np.linspace(*theta, x.shape[1])
    resolution = resolution or (0.25 * (r[0] + r[-1]) * (t[1] - t[0]) + r[1] - r[0]) / 2
    xs, zs = np.outer(r, np.sin(t)), np.outer(r, np.cos(t))
    z, x_ = np.meshgrid(np.arange(zs.min(), zs.max(), resolution), np.arange(xs.min(), xs.max(), resolution), indexing="ij")
    size, angle = np.hypot(x_, z), np.arctan2(x_, z)
    size = np.where((angle < theta[0]) | (angle > theta[1]), -1.0, size)
    return sample_at(x, (size - rho[0]) / (rho[1] - rho[0]) * (x.shape[0] - 1), (angle - theta[0]) / (theta[1] - theta[0]) * (x.shape[1] - 1), order, fill)


def sample_linear(x: np.ndarray, places: np.ndarray, fill: float = 0.0, order: int = 1) -> np.ndarray:
    """Values of an array of any rank at places between its cells (rank first), linear or nearest; outside the fill."""
    if order not in (0, 1):
        raise NotImplementedError("splines of higher order are not supported")
    wide = np.pad(x, 1, constant_values=fill)
    held = [np.clip(p + 1, 0, n - 1.0) for p, n in zip(places, wide.shape, strict=True)]
    if order == 0:
        return wide[tuple(np.rint(p).astype(int) for p in held)]
    low = [np.minimum(p.astype(int), n - 2) for p, n in zip(held, wide.shape, strict=True)]
    out = np.zeros(held[0].shape)
    for corner in range(1 << x.ndim):
        up = [corner >> i & 1 for i in range(x.ndim)]
        weight = np.prod([p - k if u else 1 - (p - k) for p, k, u in zip(held, low, up, strict=True)], axis=0)
        out += weight * wide[tuple(k + u for k, u in zip(low, up, strict=True))]
    return out


def scan_convert_volume(x: np.ndarray, rho: tuple[float, float], theta: tuple[float, float], phi: tuple[float, float], resolution: float | None = None, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """A volume in frustum coordinates (rho, theta, phi) on a cartesian grid (z, x, y)."""
    r, t, p = (np.linspace(*lims, n) for lims, n in zip((rho, theta, phi), x.shape, strict=True))
    tan_t, tan_p = np.tan(t)[None, :, None], np.tan(p)[None, None, :]
    depth = r[:, None, None] / np.sqrt(1 + tan_t**2 + tan_p**2)
    zs, xs, ys = depth, depth * tan_t, depth * tan_p
    middle = 0.25 * (r[0] + r[-1])
    step = resolution or (middle * (t[1] - t[0]) + middle * (p[1] - p[0]) + r[1] - r[0]) / 3
    z, x_, y = np.meshgrid(*(np.arange(v.min(), v.max(), step) for v in (zs, xs, ys)), indexing="ij")
    size, a, b = np.sqrt(z * z + x_ * x_ + y * y), np.arctan2(x_, z), np.arctan2(y, z)
    size = np.where((a < theta[0]) | (a > theta[1]) | (b < phi[0]) | (b > phi[1]), -1.0, size)
    places = [(v - lims[0]) / (lims[1] - lims[0]) * (n - 1) for v, lims, n in zip((size, a, b), (rho, theta, phi), x.shape, strict=True)]
    return sample_linear(x, np.stack(places), fill, order)


def gaussian_filter(x: np.ndarray, sigma: float | tuple[float, ...], order: int | tuple[int, ...] = 0, truncate: float = 4.0, mode: str = "symmetric", cval: float = 0.0, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Correlation with Gaussians or their derivatives along several axes, one after another; mode as in NumPy's pad, of
    which constant takes cval."""
    axes = tuple(range(x.ndim)) if axes is None else axes
    for k, axis in enumerate(axes):
        s, o = (v[k] if isinstance(v, (tuple, list)) else v for v in (sigma, order))
        if s > 0:
            x = gaussian(x, s, axis, o, truncate, mode, cval)
    return x


def inverse_scan_convert(x: np.ndarray, extent: tuple[float, float, float, float], rho: tuple[float, float], theta: tuple[float, float], shape: tuple[int, int], order: int = 1, fill: float = 0.0) -> np.ndarray:
    """A cartesian image (z, x), over extent (x0, x1, z0, z1), on a polar grid (rho, theta)."""
    r, t = np.meshgrid(np.linspace(*rho, shape[0]), np.linspace(*theta, shape[1]), indexing="ij")
    x_, z = r * np.sin(t), r * np.cos(t)
    return sample_at(x, (z - extent[2]) / (extent[3] - extent[2]) * (x.shape[0] - 1), (x_ - extent[0]) / (extent[1] - extent[0]) * (x.shape[1] - 1), order, fill)


def simulate_rf(scatterers: np.ndarray, magnitudes: np.ndarray, probe: np.ndarray, delays: np.ndarray, apodization: np.ndarray, initial_time: float | np.ndarray, n_ax: int, fs: float, fc: float, speed: float = 1540.0, width: float = 0.2e-3, attenuation: float = 0.0, periods: float = 4.0, lens: tuple[float, float] | None = None) -> np.ndarray:
    """Samples (ax, el) of one transmit, or (tx, ax, el) of several (delays and apodization by transmit): spectra of all
    scatterers and firing elements, summed, back in time.

    The pulse is a sine in a Hann window. lens is (thickness, speed): then ways are the times through it, by Fermat's
    crossing, times the medium's speed. Scatterers are taken one after another, so memory follows elements and
    frequencies only.
    """
    if np.ndim(delays) == 2:
        times = np.broadcast_to(initial_time, len(delays))
        return np.stack([simulate_rf(scatterers, magnitudes, probe, d, w, float(t), n_ax, fs, fc, speed, width, attenuation, periods, lens) for d, w, t in zip(delays, apodization, times, strict=True)])
    n = power_of_two(n_ax)
    f = np.arange(n // 2 + 1) / n * fs
    pulse = (hann_spectrum(f - fc, periods / fc) + hann_spectrum(f + fc, periods / fc)) / 2
    on = np.flatnonzero(apodization)
    out = np.zeros((len(probe), len(f)), complex)
    for at, size in zip(scatterers, magnitudes, strict=True):
        gap = at - probe
        d = np.linalg.norm(gap, axis=1) if lens is None else lens_time(np.hypot(gap[:, 0], gap[:, 1]), gap[:, 2], lens[0], lens[1], speed, 3) * speed
        side = strip_response(f, np.arctan2(gap[:, 0], gap[:, 2]), width, speed) * strip_response(f, np.arctan2(gap[:, 1], gap[:, 2]), width, speed)
        for e in on:
            path = d + d[e]
            tau = path / speed + delays[e] - initial_time
            phase = np.where((tau < n / fs)[:, None], np.exp(-2j * math.pi * tau[:, None] * f), 0)
            loss = np.exp(-math.log(10) * attenuation / 20 * path[:, None] * 100 * np.abs(f) * 1e-6) * 1e-4 / np.maximum(path, 1e-4)[:, None]
            out += size * apodization[e] * side * side[e] * loss * phase
    return np.fft.irfft(out * pulse, n, axis=1)[:, :n_ax].T


def lens_time(across: np.ndarray, depth: np.ndarray, thickness: float, c_lens: float, c_medium: float, steps: int = 2) -> np.ndarray:
    """Travel times through a lens: the crossing that takes least, by Newton steps of at most 10 mm, held between the
    element and the point. The NumPy form of columns.with_lens_time."""
    x, rest, eps = thickness * across / depth, depth - thickness, 1e-6
    for _ in range(steps):
        near, far = np.hypot(x, thickness), np.hypot(across - x, rest)
        slope = x / (c_lens * near) + (x - across) / (c_medium * far) + eps
        bend = 1 / (c_lens * near) - x * x / (c_lens * near**3 + eps) + 1 / (c_medium * far + eps) - (across - x) ** 2 / (c_medium * far**3 + eps)
        x = np.clip(x + np.clip(np.nan_to_num(-slope / (bend + eps)), -10e-3, 10e-3), np.minimum(across, 0), np.maximum(across, 0))
    return np.hypot(x, thickness) / c_lens + np.hypot(across - x, rest) / c_medium


def strip_response(f: np.ndarray, theta: np.ndarray, width: float, speed: float) -> np.ndarray:
    """Directivity of strip elements, angles by frequencies."""
    x = np.abs(math.pi * width / speed * f * np.sin(theta)[:, None]) + 1e-9
    return np.sin(x) / x


def hann_spectrum(f: np.ndarray, width: float) -> np.ndarray:
    """Spectrum of a squared-cosine window of a width in seconds."""
    x = f * width
    with np.errstate(divide="ignore", invalid="ignore"):
        made = 0.5 * np.sinc(x) / (1 - x * x)
    return np.where(np.abs(np.abs(x) - 1) < 1e-9, 0.25, made)


def hann_window(x: np.ndarray, width: float) -> np.ndarray:
    """A squared cosine of a whole width, one at its middle."""
    return np.where(np.abs(x) < width / 2, np.cos(math.pi * x / width) ** 2, 0.0)


def pressure_field(points: np.ndarray, probe: np.ndarray, delays: np.ndarray, apodization: np.ndarray, fc: float, speed: float = 1540.0, width: float = 0.2e-3, bandwidth: float = 0.75, n_freq: int = 16) -> np.ndarray:
    """Root mean square over frequencies of one transmit's pressure at points, by sums over its elements."""
    out = np.zeros(len(points))
    gap = points[:, None] - probe[None]
    d = np.maximum(np.linalg.norm(gap, axis=2), 1e-4)
    theta = np.arctan2(gap[..., 0], gap[..., 2])
    for f in np.linspace(fc * (1 - bandwidth / 2), fc * (1 + bandwidth / 2), n_freq):
        x = np.abs(math.pi * width / speed * f * np.sin(theta)) + 1e-9
        p = (apodization * np.sin(x) / x / d * np.exp(-2j * math.pi * f * (d / speed + delays))).sum(axis=1)
        out += np.abs(hann_spectrum(np.array([f - fc]), 4 / fc)[0] * p) ** 2
    return np.sqrt(out / n_freq)


def square_wave(n: int, block: int) -> np.ndarray:
    """Apodization of +1 and -1 in turn by blocks, the last element the other way."""
    signs = np.where(np.arange(n) // block % 2 == 0, 1.0, -1.0)
    signs[-1] *= -1
    return signs
