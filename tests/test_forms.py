"""Pipelines over both data forms, exact quantiles, whole-frame numerics against NumPy, and acceptance of scans."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.functions import columns as C
from sonarium.operators import cells, datasets, frames, loader
from sonarium.plans.pipeline import Pipeline, as_blocks, as_cells
from sonarium.sources import tensors


def blocks(spark, arrays):
    return spark.createDataFrame([(i, list(a.shape), a.ravel().tolist()) for i, a in enumerate(arrays)], "frame int, shape array<int>, data array<double>")


def test_columnar_operations_work_on_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (3, 4, 5, 2))
    df = blocks(spark, x)
    made = Pipeline(["envelope_detect", "normalize", {"name": "log_compress", "params": {"dynamic_range": (-40, 0)}}])(df)
    env = np.hypot(x[..., 0], x[..., 1])
    n = (env - env.min()) / (env.max() - env.min())
    want = np.clip(20 * np.log10(np.where(n == 0, 1e-16, n)), -40, 0)
    for r in made.collect():
        assert r["data"] == pytest.approx(want[r["frame"]].ravel().tolist())
    clipped = Pipeline([{"name": "clip", "params": {"min_value": -1, "max_value": 1}}, {"name": "companding", "params": {"comp_type": "a"}}, {"name": "companding", "params": {"comp_type": "a", "expand": True}}])(df)
    assert clipped.filter("frame = 1").first()["data"] == pytest.approx(np.clip(x[1], -1, 1).ravel().tolist())


def test_blocks_and_cells_are_the_same(spark):
    x = np.random.default_rng(1).normal(0, 1, (2, 3, 4, 2))
    df = blocks(spark, x)
    made = as_cells(df, "data", ("ax", "el"))
    assert made.count() == 24 and set(made.columns) == {"frame", "ax", "el", "data", "im"}
    back = as_blocks(made, "data", ("ax", "el"))
    assert {r["frame"]: (r["shape"], r["data"]) for r in back.collect()} == {r["frame"]: (r["shape"], r["data"]) for r in df.collect()}
    real = blocks(spark, x[..., :1])
    assert "im" not in as_cells(real, "data", ("ax", "el")).columns
    with pytest.raises(ValueError, match="3 channels"):
        as_cells(blocks(spark, np.zeros((1, 2, 2, 3))), "data", ("ax", "el"))


@pytest.mark.parametrize("few", [5, 50_000])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(2)
    for x in (rng.normal(0, 1, 1000), np.repeat([1.0, 5.0], 300), np.concatenate((rng.normal(0, 1e-9, 500), [1e9, -1e9]))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double")
        for share in (0, 0.1, 0.5, 0.777, 1):
            assert cells.quantile(df, "v", share, 16, few) == pytest.approx(np.quantile(x, share), rel=1e-12, abs=1e-15)
    assert cells.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_gain_beyond_the_curve(spark):
    samples = spark.range(0, 60, 5).select(F.col("id").alias("ax"))
    curve = spark.createDataFrame([(40.0, 1023.0), (10.0, 300.0), (20.0, 650.0)], "at double, code double")
    got = {r["ax"]: r["gain"] for r in datasets.gain_at(samples, curve).collect()}
    for ax, gain in got.items():
        assert gain == pytest.approx(10 ** (np.interp(ax, [10, 20, 40], np.array([300, 650, 1023]) / 1023 * 40) / 20))
    assert datasets.gain_at(samples, curve.limit(0)).filter("gain IS NOT NULL").count() == 0


def test_scan_converted_volume():
    x = np.random.default_rng(3).normal(0, 1, (9, 7, 5))
    made = frames.scan_convert_volume(x, (1.0, 9.0), (-0.4, 0.4), (-0.3, 0.3), 0.5, 1, -99.0)
    r, t, p = np.linspace(1, 9, 9), np.linspace(-0.4, 0.4, 7), np.linspace(-0.3, 0.3, 5)
    depth = np.array([[[a / np.sqrt(1 + np.tan(b) ** 2 + np.tan(c) ** 2) for c in p] for b in t] for a in r])
    zs = depth.min() + 0.5 * np.arange(made.shape[0])
    xs = (depth * np.tan(t)[None, :, None]).min() + 0.5 * np.arange(made.shape[1])
    ys = (depth * np.tan(p)).min() + 0.5 * np.arange(made.shape[2])
    for k, i, j in itertools.product(range(0, made.shape[0], 3), range(made.shape[1]), range(made.shape[2])):
        a, b, c = (math.sqrt(zs[k] ** 2 + xs[i] ** 2 + ys[j] ** 2) - 1), (math.atan2(xs[i], zs[k]) + 0.4) / 0.8 * 6, (math.atan2(ys[j], zs[k]) + 0.3) / 0.6 * 4
        if 0 <= a <= 8 and 0 <= b <= 6 and 0 <= c <= 4:
            want = sum((1 - abs(a - u)) * (1 - abs(b - v)) * (1 - abs(c - w)) * x[u, v, w] for u in range(9) for v in range(7) for w in range(5) if abs(a - u) < 1 and abs(b - v) < 1 and abs(c - w) < 1)
            assert made[k, i, j] == pytest.approx(want)
        elif b < -1 or b > 7 or c < -1 or c > 5:
            assert made[k, i, j] == -99


def test_gaussian_filters_of_any_rank():
    x = np.random.default_rng(4).normal(0, 1, (6, 7, 5))
    kernel = np.array(cells.gaussian_kernel(0.7))
    r = len(kernel) // 2
    wide = np.pad(x, [(0, 0), (r, r), (0, 0)], mode="constant", constant_values=2.0)
    want = sum(w * wide[:, k : k + 7] for k, w in enumerate(kernel))
    assert frames.gaussian_filter(x, 0.7, mode="constant", cval=2.0, axes=(1,)) == pytest.approx(want)
    assert frames.gaussian_filter(np.ones((4, 5, 6)), 1.3) == pytest.approx(np.ones((4, 5, 6)))


def test_simulated_transmits_and_lens(spark):
    probe = np.stack([(np.arange(4) - 1.5) * 3e-4, np.zeros(4), np.zeros(4)], axis=1)
    points, size = np.array([[0.0, 0.0, 5e-3], [1e-3, 0.0, 7e-3]]), np.array([1.0, 0.5])
    args = (0.0, 512, 25e6, 6.25e6)
    one = frames.simulate_rf(points, size, probe, np.zeros(4), np.ones(4), *args)
    two = frames.simulate_rf(points, size, probe, np.stack([np.zeros(4), np.arange(4) * 1e-7]), np.ones((2, 4)), *args)
    assert two.shape == (2, 512, 4) and two[0] == pytest.approx(one) and not np.allclose(two[1], one)
    assert np.argmax(np.abs(one[:, 1])) == pytest.approx(2 * 5e-3 / 1540 * 25e6, abs=6)
    thick = frames.simulate_rf(points, size, probe, np.zeros(4), np.ones(4), *args, lens=(1e-3, 1000.0))
    late = np.argmax(np.abs(thick[:, 1])) - np.argmax(np.abs(one[:, 1]))
    assert late == pytest.approx(2 * 1e-3 * (1 / 1000 - 1 / 1540) * 25e6, abs=2)
    df = spark.createDataFrame([(1.0e-3, 5e-3), (0.0, 6e-3), (-2e-3, 9e-3)], "a double, z double")
    got = [r["t"] for r in C.with_lens_time(df, "t", F.col("a"), F.col("z"), 1e-3, 1000.0, 1540.0).collect()]
    assert got == pytest.approx(frames.lens_time(np.array([1e-3, 0.0, -2e-3]), np.array([5e-3, 6e-3, 9e-3]), 1e-3, 1000.0, 1540.0).tolist())


def test_accepted_scans(spark):
    rng = np.random.default_rng(5)
    scans = [rng.random((112, 112)), np.zeros((112, 112)), rng.random((112, 112)) * (np.arange(112) > 30), rng.random((112, 112)) * (np.arange(112) < 72)]
    rows = [(i, z, x, float(s[z, x])) for i, s in enumerate(scans) for z in range(112) for x in range(112) if s[z, x] or i == 1 and (z, x) == (0, 0)]
    got = {r["i"]: r["accepted"] for r in loader.accepted(spark.createDataFrame(rows, "i int, z int, x int, value double"), ["i"]).collect()}
    for i, s in enumerate(scans):
        low, high = (np.linspace(a, 47, 21).astype(int) for a in (67, 78))
        left = sum(s[a:b, k].sum() for k, (a, b) in enumerate(zip(low, high, strict=True)))
        low, high = (np.linspace(17, a, 42).astype(int) for a in (57, 80))
        right = sorted(np.concatenate([s[a:b, 70 + k] for k, (a, b) in enumerate(zip(low, high, strict=True))]), reverse=True)
        assert got[i] == (left >= 0.1 and sum(right[100:]) >= 5), i


def test_numpy_recordings_become_blocks(spark):
    x = np.arange(24, dtype=float).reshape(2, 3, 4)
    rows = tensors.from_numpy(spark, "f", "image", x, 7).orderBy("frame").collect()
    assert [(r["shape"], r["data"], r["event_id"]) for r in rows] == [([3, 4], x[i].ravel().tolist(), 7) for i in (0, 1)]


def test_transmits_and_places(spark):
    df = spark.createDataFrame([("raw_data", t, t * 1.0) for t in range(5)], "key string, tx int, value double")
    assert sorted(map(tuple, loader.load_transmits(df, [4, 1]).select("tx", "value").collect())) == [(0, 4.0), (1, 1.0)]
    with pytest.raises(ValueError, match="no transmits"):
        loader.load_transmits(df.withColumn("key", F.lit("image")), [0])
    assert loader.padding(10, 4) == 2 and loader.padding(8, 4) == 0


def test_rectified_pairs_of_long_arrays(spark):
    """The time grows with an array's size, not with its cube; nulls are left out; constant and empty arrays are whole."""
    import time

    x = np.random.default_rng(5).normal(3, 2, 600)
    arrays = [x.tolist(), [1.0, None, 3.0, 5.0], [2.0, 2.0], [], None]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, v array<double>")
    df.select(C.rectified_pair(F.slice("v", 1, 3))).collect()  # the session's start doesn't count
    began = time.monotonic()
    made = {r["i"]: r["p"] for r in df.select("i", C.rectified_pair(F.col("v")).alias("p")).collect()}
    assert time.monotonic() - began < 15
    unit = (x - x.mean()) / np.linalg.norm(x - x.mean())
    assert made[0] == pytest.approx(np.maximum(np.concatenate((unit, -unit)), 0).tolist())
    assert made[1] == pytest.approx([0, 0, 0, 2 / math.sqrt(8), 2 / math.sqrt(8), 0, 0, 0])
    assert made[2] == [0] * 4 and made[3] == [] and made[4] is None
