"""Pipelines, parameters, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import agents, beamform, cells, datasets, metrics, mixture
from sonarium.plans.params import Probe, Scan, prepared, select_transmits
from sonarium.plans.pipeline import KINDS, Op, Pipeline, register
from sonarium.sources import tensors
from sonarium.streaming import frames as streaming

# The names a pipeline may use.
NAMES = """anisotropic_diffusion branched_pipeline clip companding delay_and_sum demodulate downsample envelope_detect gaussian_blur identity lambda lee_filter
log_compress mean merge normalize pad patched_grid pfield_weighting pipeline scan_convert simulate_rf split stack sum threshold tof_correction transpose upmix""".split()


def test_all_names_are_registered():
    assert sorted(KINDS) == sorted(NAMES)
    with pytest.raises(ValueError):
        register("Clip")(lambda df, key: df)
    with pytest.raises(KeyError):
        Op("unknown")


def test_pipelines_from_text_run_alike(spark):
    made = Pipeline([{"name": "normalize", "params": {"output_range": [0, 2]}}, "log_compress"])
    df = spark.range(10).select("id", F.col("id").cast("double").alias("data"))
    want = made(df).collect()
    assert Pipeline.from_json(made.to_json())(df).collect() == want
    assert Pipeline.from_yaml(made.to_yaml())(df).collect() == want
    assert Pipeline.from_config({"pipeline": made.spec()})(df).collect() == want


def test_pipelines_are_checked(spark):
    with pytest.raises(ValueError):
        Pipeline(["scan_convert", "delay_and_sum"])
    with pytest.raises(ValueError):
        Pipeline([])
    with pytest.raises(KeyError, match="columns"):
        Pipeline(["clip"])(spark.range(1))
    assert [o.name for o in Pipeline.default().operations][-1] == "log_compress"


def test_lambda_and_output_key(spark):
    df = spark.createDataFrame([(1.0,)], "data double")
    got = Pipeline([{"name": "lambda", "params": {"func": lambda c, k: c * k, "func_kwargs": {"k": 3}}, "output_key": "out"}])(df).first()
    assert (got["data"], got["out"]) == (1.0, 3.0)


def test_branches_joined_by_id(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0)], "id int, data double")
    made = Pipeline([{"name": "branched_pipeline", "params": {"merge_strategy": "flatten", "ids": ["id"]}, "branches": [[{"name": "sum", "params": {"axes": ["id"]}}], [{"name": "mean", "params": {"axes": ["id"]}}]]}])
    assert sorted(map(tuple, made(df).collect())) == [(1, 6.0, 3.0), (2, 9.0, 9.0)]


def test_normalize_of_a_flat_or_empty_input(spark):
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,)], "data double")
    assert [r["data"] for r in cells.normalize(flat, "data").collect()] == [None, None, None]
    assert cells.normalize(flat.limit(0), "data").count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    values = lambda **k: [r["v"] for r in cells.threshold(df, "v", **k).collect()]
    assert values(percentile=50) == [0, 0, 2, 3, 4]
    assert values(kind="soft", at=2.0, fill=1.0) == [1, 1, 1, 2, 3]
    assert values(at=2.0, below=False, fill="max") == [0, 1, 2, 4, 4]
    with pytest.raises(ValueError):
        cells.threshold(df, "v")


def test_pad_refuses_to_shrink(spark):
    with pytest.raises(ValueError):
        cells.pad(spark.createDataFrame([(0, 0, 1.0)], "k int, z int, value double"), spark.createDataFrame([(0,)], "k int"), {"z": (4, 2)})


def test_scan_values_follow_and_are_forgotten():
    scan = Scan({"center_frequency": 7e6, "sampling_frequency": 28e6, "n_ax": 3328, "n_ch": 1, "probe_geometry": Probe.from_name("verasonics_l11_4v").geometry, "t0_delays": np.zeros((10, 128)), "polar_angles": np.arange(10.0)})
    assert scan["wavelength"] == pytest.approx(1540 / 7e6) and scan["Nx"] == 347 and scan["demodulation_frequency"] == 0
    assert scan["grid"].shape == (scan["Nz"], 347, 3)
    scan["sound_speed"] = 3080.0
    assert scan["Nx"] == 174
    with pytest.raises(AttributeError):
        scan["wavelength"] = 1.0
    with pytest.raises(KeyError):
        scan["nothing"]
    scan.select(3)
    assert scan["polar_angles"].tolist() == [0, 4, 9] and scan["focus_distances"].tolist() == [0, 0, 0]


def test_transmit_selection():
    assert select_transmits(5, None) == [0, 1, 2, 3, 4] and select_transmits(5, "center") == [2] and select_transmits(5, 1) == [2] and select_transmits(5, [1, 3]) == [1, 3]
    for bad in (6, [7], "some"):
        with pytest.raises(ValueError):
            select_transmits(5, bad)


def test_parameters_come_in_order():
    scan, probe = Scan({"sound_speed": 1500.0, "center_frequency": 1e6}), Probe(center_frequency=2e6)
    got = prepared(probe, scan, {"f_number": 2}, {"sound_speed", "center_frequency"}, sound_speed=1480.0)
    assert (got["sound_speed"], got["center_frequency"], got["f_number"]) == (1480.0, 1e6, 2)
    assert Probe.from_name("unheard").geometry is None
    with pytest.raises(NotImplementedError):
        Probe.from_name("unheard", fallback=False)


def test_tensor_tables_round_trip(spark, tmp_path):
    array = np.arange(48, dtype=np.float32).reshape(4, 3, 4)
    blocks = tensors.from_numpy(spark, "f", "image", array)
    tensors.write(blocks, f"{tmp_path}/t")
    with pytest.raises(Exception, match="exist"):
        tensors.write(blocks, f"{tmp_path}/t")
    back = tensors.read(spark, f"{tmp_path}/t", "data/image", slice(1, 4, 2))
    assert sorted(r["frame"] for r in back.collect()) == [1, 3]
    cell = tensors.cells(blocks, ["z", "x"])
    again = sorted(tensors.blocks(cell, ["z", "x"]).collect(), key=lambda r: r["frame"])
    assert [r["data"] for r in again] == [f.ravel().tolist() for f in array] and again[0]["shape"] == [3, 4]
    np.save(tmp_path / "a.npy", array)
    assert tensors.read_npy(spark, f"{tmp_path}/a.npy", "image").count() == 4
    assert tensors.manifest(blocks).first()["n"] == 4


def test_frame_conditions():
    for bad in (1.5, slice(-3, None), {"a": 1}):
        with pytest.raises(ValueError):
            tensors.frame_condition(F.lit(1), bad)
    for index in (range(2, 9, 3), slice(1, 5, None), [1, 2]):
        assert tensors.index_from_json(tensors.index_json(index)) == index


def test_violations(spark):
    rows = [("a", None, 0, "image", [2, 2], [1.0] * 4), ("b", None, 0, "image", [4], [1.0] * 4), ("c", None, 0, "odd", [1], [1.0]), ("d", None, 0, "raw_data", [1, 1, 1, 3], [1.0] * 3), ("e", None, 0, "image", [2, 2], [1.0])]
    df = spark.createDataFrame(rows, tensors.BLOCK)
    got = {(r["file_id"], r["rule"]) for r in tensors.violations(df).collect()}
    assert got == {("b", "wrong rank"), ("c", "unknown key"), ("d", "channels are neither 1 nor 2"), ("e", "shape and data disagree")}
    scans = spark.createDataFrame([("d", tensors.REQUIRED[1:])], "file_id string, entries array<string>")
    assert ("d", "no scan entry n_ax") in {(r["file_id"], r["rule"]) for r in tensors.violations(df, scans).collect()}


def test_das_finds_a_scatterer(spark):
    from sonarium.operators import frames

    probe_xyz = np.stack([(np.arange(16) - 7.5) * 3e-4, np.zeros(16), np.zeros(16)], axis=1)
    fs, speed, n_ax = 25e6, 1540.0, 512
    rf = frames.simulate_rf(np.array([[5e-4, 0, 8e-3]]), np.ones(1), probe_xyz, np.zeros(16), np.ones(16), 0.0, n_ax, fs, 5e6, speed)
    rows = [(0, e, a, float(rf[a, e])) for e in range(16) for a in range(n_ax)]
    samples = spark.createDataFrame(rows, "tx int, el int, ax int, value double")
    probe = beamform.linear_probe(spark, 16, 3e-4)
    pixels = beamform.pixel_grid(spark, (-2e-3, 2e-3), (6e-3, 10e-3), 9, 41)
    tx = spark.createDataFrame([(0, 0.0, 0.0, float("inf"), 0.0)], "tx int, polar_angle double, azimuth_angle double, focus_distance double, initial_time double")
    firing = beamform.planewave_delays(tx, probe, speed).join(tx, "tx").withColumn("apodization", F.lit(1.0))
    one = beamform.time_of_flight(samples, pixels, probe, firing, tx.select("tx", "initial_time"), speed, fs, n_ax)
    image = beamform.delay_and_sum(one, pixels).toPandas()
    assert len(image) == 9 * 41
    best = image.iloc[image["value"].abs().argmax()]
    assert abs(best["x"] - 5e-4) <= 5.1e-4 and abs(best["z"] - 8e-3) <= 4e-4
    dealt = beamform.delay_and_sum(beamform.time_of_flight(samples, beamform.deal(pixels, 5), probe, firing, tx.select("tx", "initial_time"), speed, fs, n_ax), pixels).toPandas()
    assert np.allclose(dealt.sort_values("pix")["value"], image.sort_values("pix")["value"], atol=1e-12)


def test_agents():
    assert agents.equispaced_lines(5, 10) == [0, 2, 4, 6, 8] and agents.equispaced_lines(5, 10, 1) == [1, 3, 5, 7, 9]


def test_line_mask(spark):
    lines = spark.createDataFrame([(1,)], "line int")
    assert sorted(r["x"] for r in agents.line_mask(lines, 1, 8, 4).collect()) == [2, 3]
    with pytest.raises(ValueError):
        agents.line_mask(lines, 1, 9, 4)


def test_greedy_lines_damp_their_neighbours(spark):
    entropy = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 9.0, 8.5, 1.0, 1.0, 5.0])], "b int, line int, entropy double")
    assert [r["line"] for r in sorted(agents.greedy_lines(entropy, ["b"], 2, 6).collect(), key=lambda r: r["step"])] == [1, 5]


def test_mixture_finds_its_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.5, (100, 2)) for c in ((0, 0), (8, 8))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double")
    mix = mixture.fit(df, ["a", "b"], 2, "id")
    assert sorted(round(m[0]) for m in mix.means) == [0, 8] and mixture.sample(mix, 7).shape == (7, 2)
    assert mixture.match_greedy([[1, 2, 3], [2, 1, 3], [3, 2, 1]]) == [0, 1, 2]


def test_metrics_without_a_definition():
    for metric in (metrics.speckle_res, metrics.lpips):
        with pytest.raises(NotImplementedError):
            metric()


def test_out_of_range_fails(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "v double")
    assert datasets.in_range(df, "v", 0, 1).count() == 2
    with pytest.raises(Exception, match="out of range"):
        datasets.in_range(spark.createDataFrame([(2.0,)], "v double"), "v", 0, 1).collect()


def test_short_files_have_no_block(spark):
    files = spark.createDataFrame([("a", 5), ("b", 6)], "f string, n int")
    assert {r["f"] for r in datasets.block_windows(files, 3, 2).collect()} == {"b"}


def test_stream_of_frames(spark, tmp_path):
    blocks = tensors.from_numpy(spark, "f", "image", np.ones((5, 2, 2), np.float32))
    blocks.write.parquet(f"{tmp_path}/in")
    made = streaming.framed(streaming.block_stream(spark, f"{tmp_path}/in"), [lambda x: x * 2])
    run = made.writeStream.format("memory").queryName("frames_out").start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("SELECT * FROM frames_out").collect()
    assert len(got) == 5 and got[0]["data"] == [2.0] * 4


def test_stream_of_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, 'a' AS kind, CAST(id AS DOUBLE) AS value FROM range(30)")
    df.write.parquet(f"{tmp_path}/in")
    made = streaming.windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "value", ["kind"])
    run = made.writeStream.format("memory").queryName("windows_out").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = sorted(spark.sql("SELECT n, total FROM windows_out").collect())
    assert got[:1] == [(6, 15.0)]
