"""Pipelines: named operations in order, made from lists, dicts, JSON or YAML, checked, and run on a DataFrame.

An operation takes a DataFrame and parameters and returns a DataFrame. Neighbouring whole-frame operations are joined
into one pass over the Python workers; all others are columns, joins and aggregates for the optimizer.

Data have one of two forms: blocks, a row per frame with its shape and an array of values, or cells, a row per value
(and im, the imaginary part). Operations that only change values work on both; before any other the form it needs is
made, if the data aren't in it.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sonarium.functions import columns as C
from sonarium.operators import beamform, cells, frames

Run = Callable[..., DataFrame]


@dataclass
class Kind:
    """What the registry holds: how to run an operation, what data it takes and makes, whether it works on frames,
    whether it only changes its column and leaves the rows as they are, and the axes of the cells it takes and makes."""

    name: str
    run: Callable
    takes: str | None = None
    makes: str | None = None
    framed: bool = False
    columnar: bool = False
    axes: tuple[str, ...] | None = None
    out_axes: tuple[str, ...] | None = None

    def accepts(self) -> set[str]:
        return {p for p in inspect.signature(self.run).parameters if p not in ("df", "key", "x", "kw")}

    def open(self) -> bool:
        return any(p.kind is p.VAR_KEYWORD for p in inspect.signature(self.run).parameters.values())


KINDS: dict[str, Kind] = {}


def register(name: str, takes: str | None = None, makes: str | None = None, framed: bool = False, columnar: bool = False, axes: tuple[str, ...] | None = None, out_axes: tuple[str, ...] | None = None) -> Callable:
    """Adds a function to the registry under a name, whatever its case; a name is taken once."""

    def add(run: Callable) -> Callable:
        if name.lower() in KINDS:
            raise ValueError(f"there is an operation {name!r} already")
        KINDS[name.lower()] = Kind(name.lower(), run, takes, makes, framed, columnar, axes, out_axes)
        return run

    return add


@dataclass
class Op:
    """An operation with its own parameters; key is the column it works on, output_key the one it fills."""

    name: str
    params: dict = field(default_factory=dict)
    key: str = "data"
    output_key: str | None = None
    branches: list[Pipeline] | None = None
    cache: bool = False

    def __post_init__(self) -> None:
        if self.name.lower() not in KINDS:
            raise KeyError(f"no operation {self.name!r}; there are {', '.join(sorted(KINDS))}")
        self.name = self.name.lower()

    @property
    def kind(self) -> Kind:
        return KINDS[self.name]

    def bound(self, given: dict) -> dict:
        """The parameters that the operation takes: its own before the pipeline's."""
        both = given | self.params
        return both if self.kind.open() else {k: v for k, v in both.items() if k in self.kind.accepts()}

    def apply(self, df: DataFrame, given: dict) -> DataFrame:
        if self.key not in df.columns and not self.branches:
            raise KeyError(f"{self.name} works on {self.key!r}, but the columns are {df.columns}")
        if self.branches is not None:
            return branched(df, self.branches, given, **self.params)
        out = self.output_key or self.key
        if out != self.key:
            df = df.withColumn(out, F.col(self.key))
        return self.kind.run(df, out, **self.bound(given))

    def spec(self) -> dict:
        made: dict = {"name": self.name}
        if self.params:
            made["params"] = self.params
        if self.key != "data":
            made["key"] = self.key
        if self.output_key:
            made["output_key"] = self.output_key
        if self.branches is not None:
            made["branches"] = [b.spec()["operations"] for b in self.branches]
        if self.cache:
            made["cache"] = True
        return made


def make(spec: str | dict | Op) -> Op:
    """An operation from its name, or from a dict of name, params, key, output_key, branches or operations."""
    if isinstance(spec, Op):
        return spec
    if isinstance(spec, str):
        return Op(spec)
    rest = dict(spec)
    nested = rest.pop("branches", None)
    inner = rest.pop("operations", None)
    if inner is not None:  # a pipeline in a pipeline, patched or not, is one branch
        return Op(rest["name"], dict(rest.get("params") or {}), branches=[Pipeline(inner)], cache=bool(rest.get("cache")))
    return Op(rest["name"], dict(rest.get("params") or {}), rest.get("key", "data"), rest.get("output_key"), [Pipeline(b) for b in nested] if nested is not None else None, bool(rest.get("cache")))


class Pipeline:
    """Operations in order. An operation with cache set keeps its result in memory or on disk for the next use of it."""

    def __init__(self, operations: list, validate: bool = True, **params: object) -> None:
        self.operations = [make(o) for o in operations]
        self.params = dict(params)
        if validate:
            self.validate()

    def validate(self) -> None:
        """Neighbours that say what they make and take have to agree."""
        if not self.operations:
            raise ValueError("a pipeline needs an operation")
        for a, b in zip(self.operations, self.operations[1:], strict=False):
            if a.kind.makes and b.kind.takes and a.kind.makes != b.kind.takes:
                raise ValueError(f"{a.name} makes {a.kind.makes}, but {b.name} takes {b.kind.takes}")

    def needs(self) -> set[str]:
        """Names of all parameters that an operation takes."""
        return set().union(*(o.kind.accepts() for o in self.operations))

    def set_params(self, **params: object) -> None:
        self.params |= params

    def get_params(self) -> dict:
        return dict(self.params)

    def append(self, op: str | dict | Op) -> None:
        self.operations.append(make(op))

    def prepend(self, op: str | dict | Op) -> None:
        self.operations.insert(0, make(op))

    def __call__(self, df: DataFrame, **given: object) -> DataFrame:
        given = self.params | given
        waiting: list[frames.Step] = []
        axes: tuple[str, ...] | None = None  # of the cells that the data are, where an operation has said so
        for op in self.operations:
            if op.kind.framed and not op.branches:
                if axes and not _is_block(df, op.key):
                    df, axes = as_blocks(df, op.key, axes), None
                waiting.append(_step(op, given))
                if op.cache:
                    df, waiting = frames.on_frames(df, waiting).persist(), []
                if op.name == "demodulate":  # what comes after knows the carrier that is gone
                    given = {"demodulation_frequency": op.bound(given)["center_frequency"]} | given
                continue
            if waiting:
                df, waiting = frames.on_frames(df, waiting), []
            if op.branches is None and op.kind.axes and _is_block(df, op.key):
                df = as_cells(df, op.key, op.kind.axes)
            df = op.apply(df, given)
            if op.cache:
                df = df.persist()
            axes = op.kind.out_axes or (_made(op.branches) if op.branches else None) or axes
        return frames.on_frames(df, waiting) if waiting else df

    def spec(self) -> dict:
        return {"operations": [o.spec() for o in self.operations]}

    def to_json(self) -> str:
        return json.dumps(self.spec())

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.spec(), sort_keys=False)

    @classmethod
    def from_config(cls, config: dict, **params: object) -> Pipeline:
        """From a dict with operations at its top or under pipeline."""
        inner = config.get("pipeline", config)
        return cls(inner["operations"], **(inner.get("params") or {}) | params)

    @classmethod
    def load(cls, path: str, **params: object) -> Pipeline:
        """From a JSON or YAML file."""
        with open(path, encoding="utf-8") as file:
            return (cls.from_json if path.endswith(".json") else cls.from_yaml)(file.read(), **params)

    def save(self, path: str) -> None:
        """As a JSON or YAML file, which must not exist."""
        with open(path, "x", encoding="utf-8") as file:
            file.write(self.to_json() if path.endswith(".json") else self.to_yaml())

    @classmethod
    def from_json(cls, text: str, **params: object) -> Pipeline:
        return cls.from_config(json.loads(text), **params)

    @classmethod
    def from_yaml(cls, text: str, **params: object) -> Pipeline:
        import yaml

        return cls.from_config(yaml.safe_load(text), **params)

    @classmethod
    def default(cls, baseband: bool = False, pfield: bool = False, num_patches: int = 100) -> Pipeline:
        """From raw samples to a compressed image."""
        inner = ["tof_correction", *(["pfield_weighting"] if pfield else []), "delay_and_sum"]
        first = [] if baseband else ["demodulate"]
        return cls([*first, {"name": "patched_grid", "params": {"num_patches": num_patches}, "operations": inner}, "envelope_detect", "normalize", "log_compress"])


def _made(branches: list[Pipeline]) -> tuple[str, ...] | None:
    """The axes of the cells that a single branch makes."""
    return next((o.kind.out_axes for o in reversed(branches[0].operations) if o.kind.out_axes), None) if len(branches) == 1 else None


def _is_block(df: DataFrame, key: str) -> bool:
    return "shape" in df.columns and key in df.columns and isinstance(df.schema[key].dataType, ArrayType)


def as_cells(df: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """Blocks as cells: the other columns, the axes, key, and im if the frames have two channels (of a first one, as all
    frames of a table have as many). Frames have the axes and, last, the channels; null ones have no cells."""
    first = df.filter(F.col("shape").isNotNull()).select("shape").first()
    channels = 1 if first is None or len(first["shape"]) == len(axes) else first["shape"][-1]
    if channels > 2:
        raise ValueError(f"{channels} channels; a cell has a value and an imaginary part")
    rest = [c for c in df.columns if c not in ("shape", key)]
    n = F.floor(F.size(key) / channels).cast("int")
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(*(F.get(key, k * channels + c).alias(name) for c, name in enumerate(("value", "im")[:channels]))))
    rows = df.filter(F.size(key) > 0).select(*rest, "shape", F.posexplode(values).alias("__at", "__v"))
    left = F.col("__at")
    for i in reversed(range(len(axes))):
        size = F.get("shape", F.lit(i))
        rows = rows.withColumn(f"__axis{i}", (left % size).cast("int"))
        left = F.floor(left / size)
    return rows.select(*rest, *(F.col(f"__axis{i}").alias(a) for i, a in enumerate(axes)), F.col("__v.value").alias(key), *([F.col("__v.im").alias("im")] if channels == 2 else []))


def as_blocks(df: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """Cells as blocks: a row for each of the other columns' values, with shape (axes, then channels) and key. Columns
    that only say where a cell lies (pix, x, y, z) go. A frame's cells have to be whole; they come to one task."""
    parts = [c for c in (key, "im") if c in df.columns]
    rest = [c for c in df.columns if c not in (*parts, *axes, "pix", "x", "y", "z")]
    if not rest:
        df, rest = df.withColumn("frame", F.lit(0)), ["frame"]
    cells_of = F.sort_array(F.collect_list(F.struct(*axes, *(F.col(p).cast("double").alias(f"__{i}") for i, p in enumerate(parts)))))
    values = F.flatten(F.transform(cells_of, lambda c: F.array(*(c[f"__{i}"] for i in range(len(parts))))))
    shape = F.array(*((F.max(a) + 1).cast("int") for a in axes), F.lit(len(parts)))
    return df.groupBy(*rest).agg(shape.alias("shape"), values.alias(key))


def _each(df: DataFrame, key: str, made: Callable[[Column], Column]) -> DataFrame:
    """df with a function of every value, be it a cell's or one of a block."""
    if isinstance(df.schema[key].dataType, ArrayType):
        return df.withColumn(key, F.transform(key, lambda v: made(v.cast("double"))))
    return df.withColumn(key, made(F.col(key)))


def _step(op: Op, given: dict) -> frames.Step:
    bound = op.bound(given)
    return lambda x: op.kind.run(x, **bound)


def branched(df: DataFrame, branches: list[Pipeline], given: dict, merge_strategy: str | Callable = "nested", key: str = "data", ids: list[str] | None = None, num_patches: int | None = None) -> DataFrame:
    """Every branch run on df. nested: a struct a branch; flatten: branch_i_column; suffix: column_branch_i; or a
    function of the branches' DataFrames.

    Branches of operations that only change their column are columns side by side. Others are joined by id columns,
    those but the key unless named, which have to tell rows apart.
    """
    if num_patches and isinstance(given.get("pixels"), DataFrame):  # pixels in so many partitions: the same result
        given = given | {"pixels": beamform.deal(given["pixels"], num_patches)}
    if len(branches) == 1 and merge_strategy == "nested":
        return branches[0](df, **given)
    if callable(merge_strategy):
        return merge_strategy(*(b(df, **given) for b in branches))
    if merge_strategy not in ("nested", "flatten", "suffix"):
        raise ValueError(f"unknown merge strategy {merge_strategy!r}")

    def named(values: list[str], i: int, of: Callable[[str], str]) -> list:
        if merge_strategy == "nested":
            return [F.struct(*(F.col(of(c)).alias(c) for c in values)).alias(f"branch_{i}")]
        return [F.col(of(c)).alias(f"branch_{i}_{c}" if merge_strategy == "flatten" else f"{c}_branch_{i}") for c in values]

    if all(o.kind.columnar and o.key == key and not o.output_key for b in branches for o in b.operations):
        rest = [c for c in df.columns if c != key]
        for i, b in enumerate(branches):
            df = df.withColumn(f"__{i}_{key}", F.col(key))
            for o in b.operations:
                df = o.kind.run(df, f"__{i}_{key}", **o.bound(b.params | given))
        return df.select(*rest, *(c for i in range(len(branches)) for c in named([key], i, lambda c, i=i: f"__{i}_{c}")))
    ids = ids or [c for c in df.columns if c != key]
    out = None
    for i, b in enumerate(branches):
        made = b(df, **given)
        part = made.select(*ids, *named([c for c in made.columns if c not in ids], i, lambda c: c))
        out = part if out is None else out.join(part, ids)
    return out


@register("identity", columnar=True)
def _identity(df: DataFrame, key: str) -> DataFrame:
    return df


@register("clip", columnar=True)
def _clip(df: DataFrame, key: str, min_value: float = float("-inf"), max_value: float = float("inf")) -> DataFrame:
    return _each(df, key, lambda v: C.clip(v, min_value, max_value))


@register("normalize", columnar=True)
def _normalize(df: DataFrame, key: str, output_range: tuple = (0.0, 1.0), input_range: tuple | None = None, minval: float | None = None, maxval: float | None = None, scope: tuple = ()) -> DataFrame:
    given = input_range or ((minval, maxval) if minval is not None and maxval is not None else None)
    if isinstance(df.schema[key].dataType, ArrayType):  # of all blocks, or of those alike in the scope
        if given:
            df = df.withColumns({"minval": F.lit(float(given[0])), "maxval": F.lit(float(given[1]))})
        else:
            df = cells.with_stats(df, list(scope), minval=F.min(F.array_min(key)).cast("double"), maxval=F.max(F.array_max(key)).cast("double"))
        low, high = F.col("minval"), F.col("maxval")
        return _each(df, key, lambda v: C.rescale(C.clip(v, low, high), (low, high), tuple(output_range)))
    return cells.normalize(df, key, tuple(output_range), given, tuple(scope))


@register("log_compress", makes="image", columnar=True)
def _log_compress(df: DataFrame, key: str, dynamic_range: tuple = (-60.0, 0.0)) -> DataFrame:
    return _each(df, key, lambda v: C.log_compress(v, *dynamic_range))


@register("companding", columnar=True)
def _companding(df: DataFrame, key: str, expand: bool = False, comp_type: str = "mu", mu: float = 255.0, A: float = 87.6) -> DataFrame:  # noqa: N803
    if comp_type not in ("mu", "a"):
        raise ValueError(f"unknown companding {comp_type!r}")
    made = {("mu", False): C.mu_compress, ("mu", True): C.mu_expand, ("a", False): C.a_compress, ("a", True): C.a_expand}[(comp_type, expand)]
    return _each(df, key, lambda v: made(v, mu if comp_type == "mu" else A))


@register("threshold", columnar=True)
def _threshold(df: DataFrame, key: str, threshold_type: str = "hard", below_threshold: bool = True, fill_value: str | float = "min", threshold: float | None = None, percentile: float | None = None) -> DataFrame:
    return cells.threshold(df, key, threshold_type, below_threshold, fill_value, threshold, percentile)


@register("sum")
def _sum(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    return cells.reduce_axis(df, list(axes), key, "sum")


@register("mean")
def _mean(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    return cells.reduce_axis(df, list(axes), key, "mean")


@register("transpose")
def _transpose(df: DataFrame, key: str, axes: dict[str, str]) -> DataFrame:
    """axes: new names of coordinates by old ones."""
    return df.select(*(F.col(c).alias(axes.get(c, c)) for c in df.columns))


@register("downsample")
def _downsample(df: DataFrame, key: str, axis: str = "ax", factor: int = 1, phase: int = 0) -> DataFrame:
    return cells.downsample(df, axis, factor, phase)


@register("pad")
def _pad(df: DataFrame, key: str, target_shape: dict, ids: list[str], pad_value: float = 0.0, uniform: bool = True) -> DataFrame:
    """target_shape: old and new length by axis."""
    return cells.pad(df, df.select(*ids).distinct(), {a: tuple(n) for a, n in target_shape.items()}, key, pad_value, uniform)


@register("stack")
def _stack(df: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """One array column of several columns."""
    return df.withColumn(key, F.array(*keys)).drop(*(k for k in keys if k != key))


@register("split")
def _split(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """Every row n times, told apart by copy."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


@register("merge")
def _merge(df: DataFrame, key: str, other: DataFrame, ids: list[str]) -> DataFrame:
    return cells.merge(df, other, list(ids))


@register("lambda", columnar=True)
def _lambda(df: DataFrame, key: str, func: Callable, func_kwargs: dict | None = None) -> DataFrame:
    """A function of the column, or a pandas UDF; of a block's column, its array."""
    return df.withColumn(key, func(F.col(key), **(func_kwargs or {})))


@register("pipeline")
def _pipeline(df: DataFrame, key: str) -> DataFrame:
    raise TypeError("a pipeline in a pipeline needs operations")


@register("patched_grid")
def _patched_grid(df: DataFrame, key: str, num_patches: int = 100) -> DataFrame:
    raise TypeError("patched_grid needs operations")


@register("branched_pipeline")
def _branched(df: DataFrame, key: str) -> DataFrame:
    raise TypeError("branched_pipeline needs branches")


def _as_value(df: DataFrame, key: str) -> DataFrame:
    return df if key == "value" else df.withColumnRenamed(key, "value")


@register("tof_correction", takes="raw_data", makes="aligned_data", axes=("ax", "el"))
def _tof(df: DataFrame, key: str, pixels: DataFrame, probe: DataFrame, firing: DataFrame, timing: DataFrame, sound_speed: float, sampling_frequency: float, n_ax: int, f_number: float = 1.0, demodulation_frequency: float = 0.0, ids: tuple = (), lens: tuple | None = None) -> DataFrame:
    made = beamform.time_of_flight(_as_value(df, key), pixels, probe, firing, timing, sound_speed, sampling_frequency, n_ax, f_number, demodulation=demodulation_frequency, keys=tuple(ids), lens=lens)
    return made.withColumnRenamed("value", key)


@register("pfield_weighting", takes="aligned_data", makes="aligned_data")
def _pfield(df: DataFrame, key: str, flat_pfield: DataFrame | None = None) -> DataFrame:
    return beamform.pfield_weighting(_as_value(df, key), flat_pfield).withColumnRenamed("value", key)


@register("delay_and_sum", takes="aligned_data", makes="beamformed_data", out_axes=("iz", "ix"))
def _das(df: DataFrame, key: str, pixels: DataFrame, ids: tuple = (), groups: DataFrame | None = None) -> DataFrame:
    aligned = _as_value(df, key)
    if ids and groups is None:  # every frame has all pixels, also where no sample is heard
        groups = aligned.select(*ids).distinct()
    return beamform.delay_and_sum(aligned, pixels, tuple(ids), groups).withColumnRenamed("value", key)


@register("envelope_detect", makes="envelope_data", framed=True)
def _envelope(x, axis: int = 0):  # noqa: ANN001, ANN202
    return frames.envelope(x, axis)


@register("demodulate", takes="raw_data", makes="raw_data", framed=True)
def _demodulate(x, sampling_frequency: float, center_frequency: float, axis: int = 0):  # noqa: ANN001, ANN202
    return frames.demodulate(x, sampling_frequency, center_frequency, axis)


@register("upmix", framed=True)
def _upmix(x, sampling_frequency: float, center_frequency: float, upsampling_rate: int = 1, axis: int = 0):  # noqa: ANN001, ANN202
    return frames.upmix(x, sampling_frequency, center_frequency, upsampling_rate, axis)


@register("gaussian_blur", framed=True)
def _blur(x, sigma: float = 1.0, truncate: float = 4.0, pad_mode: str = "symmetric"):  # noqa: ANN001, ANN202
    return frames.gaussian_blur(x, sigma, truncate, pad_mode)


@register("lee_filter", framed=True)
def _lee(x, sigma: float = 3.0):  # noqa: ANN001, ANN202
    return frames.lee_filter(x, sigma)


@register("anisotropic_diffusion", framed=True)
def _diffusion(x, niter: int = 100, lmbda: float = 0.1, rect: tuple | None = None, eps: float = 1e-6):  # noqa: ANN001, ANN202
    return frames.anisotropic_diffusion(x, niter, lmbda, rect, eps)


@register("scan_convert", takes="image", makes="image_sc", framed=True)
def _scan(x, rho_range: tuple, theta_range: tuple, phi_range: tuple | None = None, resolution: float | None = None, order: int = 1, fill_value: float = float("nan")):  # noqa: ANN001, ANN202
    if phi_range is not None:
        return frames.scan_convert_volume(x, tuple(rho_range), tuple(theta_range), tuple(phi_range), resolution, order, fill_value)
    return frames.scan_convert(x, tuple(rho_range), tuple(theta_range), resolution, order, fill_value)


@register("simulate_rf", makes="raw_data", framed=True)
def _simulate(x, probe_geometry, t0_delays, tx_apodizations, initial_time: float, n_ax: int, sampling_frequency: float, center_frequency: float, sound_speed: float = 1540.0, element_width: float = 0.2e-3, attenuation_coef: float = 0.0, apply_lens_correction: bool = False, lens_thickness: float = 1e-3, lens_sound_speed: float = 1000.0):  # noqa: ANN001, ANN202
    """x: a frame of scatterers, x, y, z and magnitude a row; the result has (transmits, if there are several,) samples,
    elements and one channel."""
    lens = (lens_thickness, lens_sound_speed) if apply_lens_correction else None
    made = frames.simulate_rf(x[:, :3], x[:, 3], probe_geometry, t0_delays, tx_apodizations, initial_time, n_ax, sampling_frequency, center_frequency, sound_speed, element_width, attenuation_coef, lens=lens)
    return made[..., None]
