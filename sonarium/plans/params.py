"""Probes and scans: typed parameters, and values that follow from them, worked out when they are asked for."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Probes by name (elements, pitch in m, centre and sampling frequency in Hz, lateral and depth limits in m).
PROBES = {
    "verasonics_l11_4v": (128, 0.3e-3, 6.25e6, 25e6, (-19.05e-3, 19.05e-3), (0.965e-3, 63.58375e-3)),
    "verasonics_l11_5v": (128, 0.3e-3, 6.25e6, 25e6, (-19.05e-3, 19.05e-3), (0.965e-3, 63.58375e-3)),
    "esaote_sll1543": (192, 0.245e-3, 8e6, 65e6, (-15e-3, 15e-3), (0.0, 40e-3)),
}

# Defaults of a scan.
DEFAULTS = {
    "sound_speed": 1540.0, "f_number": 1.0, "bandwidth_percent": 200.0, "element_width": 0.2e-3, "attenuation_coef": 0.0, "pixels_per_wavelength": 4,
    "downsample": 1, "fill_value": 0.0, "apply_lens_correction": False,
}


@dataclass
class Probe:
    """Geometry (n_el, 3) and frequencies; type linear or phased."""

    geometry: np.ndarray | None = None
    center_frequency: float | None = None
    sampling_frequency: float | None = None
    xlims: tuple[float, float] | None = None
    zlims: tuple[float, float] | None = None
    kind: str = "linear"

    def __post_init__(self) -> None:
        if self.kind.lower() not in ("linear", "phased"):
            raise ValueError("a probe is linear or phased")

    @classmethod
    def from_name(cls, name: str, fallback: bool = True) -> Probe:
        """A probe by its name; an unknown one gives a generic probe, or raises."""
        if name.lower() in PROBES:
            n, pitch, fc, fs, xlims, zlims = PROBES[name.lower()]
            return cls(linear_geometry(n, pitch), fc, fs, xlims, zlims)
        if not fallback and name != "generic":
            raise NotImplementedError(f"no probe named {name!r}")
        return cls()

    def parameters(self) -> dict:
        return {"probe_geometry": self.geometry, "center_frequency": self.center_frequency, "sampling_frequency": self.sampling_frequency, "xlims": self.xlims, "zlims": self.zlims}


def linear_geometry(n_el: int, pitch: float) -> np.ndarray:
    """A centred row of elements along x."""
    return np.stack([(np.arange(n_el) - (n_el - 1) / 2) * pitch, np.zeros(n_el), np.zeros(n_el)], axis=1)


def select_transmits(n: int, which: object) -> list[int]:
    """None or all: all; center: the middle one; a number: so many, evenly spread; a list or range: these."""
    if which is None or which == "all":
        return list(range(n))
    if which == "center":
        return [n // 2]
    if isinstance(which, int):
        if not 1 <= which <= n:
            raise ValueError(f"cannot select {which} of {n} transmits")
        return [n // 2] if which == 1 else [int(np.rint(k)) for k in np.linspace(0, n - 1, which)]
    if isinstance(which, (list, tuple, range, np.ndarray)):
        chosen = [int(k) for k in which]
        if any(not 0 <= k < n for k in chosen):
            raise ValueError(f"transmits out of range 0..{n - 1}")
        return chosen
    raise ValueError(f"cannot select transmits by {which!r}")


@dataclass
class Scan:
    """Given parameters, and derived ones computed once and forgotten when anything they need is set anew."""

    given: dict = field(default_factory=dict)
    selected: object = None
    _known: dict = field(default_factory=dict, repr=False)

    def __getitem__(self, name: str) -> object:
        if name in self.given and self.given[name] is not None:
            return self._of_selected(name, self.given[name])
        if name in DERIVED:
            if name not in self._known:
                self._known[name] = DERIVED[name](self)
            return self._known[name]
        if name in DEFAULTS:
            return DEFAULTS[name]
        raise KeyError(f"the scan has no {name!r}, and it doesn't follow from what it has")

    def __setitem__(self, name: str, value: object) -> None:
        if name in DERIVED and name not in SETTABLE:
            raise AttributeError(f"{name!r} follows from other parameters")
        self.given[name] = value
        self._known.clear()

    def select(self, which: object) -> None:
        self.selected = select_transmits(int(self["n_tx_all"]), which)
        self._known.clear()

    def _of_selected(self, name: str, value: object) -> object:
        if self.selected is None or name not in PER_TRANSMIT:
            return value
        return np.asarray(value)[:, self.selected] if name == "time_to_next_transmit" else np.asarray(value)[self.selected]


def _extent(scan: Scan, lims: str) -> int:
    low, high = scan[lims]
    return max(1, math.ceil((high - low) / (scan["wavelength"] / 2)))


def _grid(scan: Scan) -> np.ndarray:
    (x0, x1), (z0, z1) = scan["xlims"], scan["zlims"]
    z, x = np.meshgrid(np.linspace(z0, z1 + 1e-10, scan["Nz"]), np.linspace(x0, x1 + 1e-10, scan["Nx"]), indexing="ij")
    return np.stack((x, np.zeros_like(x), z), axis=-1)


PER_TRANSMIT = {"polar_angles", "azimuth_angles", "focus_distances", "initial_times", "t0_delays", "tx_apodizations", "time_to_next_transmit"}
SETTABLE = {"Nx", "Nz", "zlims", "xlims", "demodulation_frequency", "n_el"} | PER_TRANSMIT
_zeros = lambda scan: np.zeros(len(scan["t0_delays"]))
DERIVED: dict[str, Callable[[Scan], object]] = {
    "wavelength": lambda s: s["sound_speed"] / s["center_frequency"],
    "n_el": lambda s: len(s["probe_geometry"]),
    "n_tx_all": lambda s: len(s.given["t0_delays"]) if "t0_delays" in s.given else s["n_tx"],
    "xlims": lambda s: (float(np.min(s["probe_geometry"][:, 0])), float(np.max(s["probe_geometry"][:, 0]))),
    "zlims": lambda s: (0.0, s["sound_speed"] * s["n_ax"] / s["sampling_frequency"] / 2),
    "Nx": lambda s: _extent(s, "xlims"),
    "Nz": lambda s: _extent(s, "zlims"),
    "z_axis": lambda s: np.linspace(*s["zlims"], s["n_ax"]),
    "grid": _grid,
    "flatgrid": lambda s: s["grid"].reshape(-1, 3),
    "demodulation_frequency": lambda s: s["center_frequency"] if s["n_ch"] == 2 else 0.0,
    "polar_angles": _zeros,
    "azimuth_angles": _zeros,
    "focus_distances": _zeros,
    "initial_times": _zeros,
    "tx_apodizations": lambda s: np.ones_like(s["t0_delays"]),
    "frames_per_second": lambda s: 1 / float(np.mean(np.sum(s["time_to_next_transmit"], axis=1))),
}


def prepared(probe: Probe | None = None, scan: Scan | None = None, config: dict | None = None, needed: set[str] = frozenset(), **given: object) -> dict:
    """What a pipeline is called with: given before config before scan before probe; of the scan only what is needed."""
    out = {k: v for k, v in (probe.parameters() if probe else {}).items() if v is not None}
    if scan:
        for name in needed or set(scan.given):
            try:
                out[name] = scan[name]
            except KeyError:
                continue
    return out | (config or {}) | given
