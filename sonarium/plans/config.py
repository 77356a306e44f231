"""Configurations: typed entries with defaults, checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from sonarium.plans.pipeline import Pipeline


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


@dataclass
class Scan:
    """Entries of a scan that a configuration may set; None is left to the recording."""

    selected_transmits: int | str | list | None = None
    sampling_frequency: float | None = None
    center_frequency: float | None = None
    demodulation_frequency: float | None = None
    sound_speed: float | None = None
    xlims: list | None = None
    zlims: list | None = None
    n_ax: int | None = None
    f_number: float | None = None
    apply_lens_correction: bool = False
    lens_thickness: float = 1e-3
    lens_sound_speed: float = 1000.0
    rho_range: list | None = None
    theta_range: list | None = None
    dynamic_range: list = field(default_factory=lambda: [-60, 0])

    def __post_init__(self) -> None:
        for name in ("xlims", "zlims", "rho_range", "theta_range", "dynamic_range"):
            pair = getattr(self, name)
            if pair is not None and not (isinstance(pair, (list, tuple)) and len(pair) == 2 and pair[0] < pair[1]):
                raise ConfigError(f"scan.{name}: two rising numbers, not {pair!r}")
        for name in ("sampling_frequency", "center_frequency", "sound_speed", "lens_thickness", "lens_sound_speed"):
            value = getattr(self, name)
            if value is not None and not (isinstance(value, (int, float)) and value > 0):
                raise ConfigError(f"scan.{name}: a positive number, not {value!r}")
        if self.n_ax is not None and not (isinstance(self.n_ax, int) and self.n_ax > 0):
            raise ConfigError(f"scan.n_ax: a positive whole number, not {self.n_ax!r}")


@dataclass
class Data:
    """What is read: a table's path, the key and the frames."""

    path: str | None = None
    dtype: str = "raw_data"
    frame_no: int | str | list | None = None


@dataclass
class Config:
    """A whole configuration: data, scan and pipeline."""

    data: Data
    scan: Scan
    pipeline: Pipeline | None

    @staticmethod
    def of(given: dict) -> Config:
        """From a dict; unknown entries, wrong types and operations that there aren't raise."""
        unknown = set(given) - {"data", "scan", "pipeline", "plot", "device", "git"}
        if unknown:
            raise ConfigError(f"unknown parts {sorted(unknown)}")
        made = []
        for name, kind in (("data", Data), ("scan", Scan)):
            part = given.get(name) or {}
            wrong = set(part) - {f.name for f in fields(kind)}
            if wrong:
                raise ConfigError(f"{name}: unknown entries {sorted(wrong)}")
            made.append(kind(**part))
        steps = given.get("pipeline")
        try:
            pipeline = None if steps is None else Pipeline.from_config(steps)
        except (KeyError, ValueError, TypeError) as wrong:
            raise ConfigError(f"pipeline: {wrong}") from wrong
        return Config(*made, pipeline)

    @staticmethod
    def load(path: str) -> Config:
        """From a JSON or YAML file."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith(".json"):
            return Config.of(json.loads(text))
        import yaml

        return Config.of(yaml.safe_load(text))
