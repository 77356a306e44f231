"""Files, loading, models in batches, configurations, and pipelines on disk."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.plans.config import Config, ConfigError
from sonarium.plans.pipeline import Pipeline
from sonarium.sources import files, tensors


def test_files_are_found_and_counted(spark, tmp_path):
    for name, size in (("a/x.npy", 3), ("a/y.npy", 5), ("b/c/z.npy", 7), ("b/other.txt", 9)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = files.find_files(spark, str(tmp_path), "*.npy")
    assert sorted((r["name"], r["bytes"]) for r in found.collect()) == [("x.npy", 3), ("y.npy", 5), ("z.npy", 7)]
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    frames = found.select("path", F.lit(2).alias("n"))
    counts = {r["folder"].rsplit("/", 1)[1]: (r["files"], r["bytes"], r["frames"]) for r in files.count_by_folder(found, frames).collect()}
    assert counts == {"a": (2, 8, 4), "c": (1, 7, 2)}


def test_a_recording_is_loaded_in_part(spark, tmp_path):
    x = np.arange(2 * 3 * 4 * 5).reshape(2, 3, 4, 5).astype(float)
    path = str(tmp_path / "table")
    tensors.write(tensors.from_numpy(spark, "f", "raw_data", x), path)
    cells, scan = files.load(spark, path, "data/raw_data", [1], [2, 0], ("tx", "ax", "el"), {"n_tx": 3, "angles": [0.1, 0.2, 0.3], "speed": 1540})
    assert scan == {"n_tx": 2, "angles": [0.3, 0.1], "speed": 1540, "selected_transmits": [2, 0]}
    got = {(r["tx"], r["ax"], r["el"]): r["value"] for r in cells.collect()}
    assert got == {(k, a, e): x[1, t, a, e] for k, t in enumerate((2, 0)) for a in range(4) for e in range(5)}
    with pytest.raises(ValueError, match="no transmits"):
        files.load(spark, path, "image", transmits=[0])


def test_models_run_in_batches(spark):
    def make():
        weights = np.array([1.0, -2.0, 0.5], np.float32)
        return lambda x: (x @ weights[:, None]).astype(np.float32)

    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "i int, v array<float>")
    got = {r["i"]: r["predicted"] for r in files.predicted(df, "v", make, shape=[3], batch=4).collect()}
    assert got == {i: [pytest.approx(i - 1.0)] for i in range(10)}


def test_configurations_are_checked(tmp_path):
    made = Config.of({"data": {"path": "x"}, "scan": {"xlims": [-1, 1]}, "pipeline": {"operations": ["normalize", {"name": "log_compress", "cache": True}]}})
    assert made.scan.lens_sound_speed == 1000.0 and made.scan.dynamic_range == [-60, 0] and made.pipeline.operations[1].cache
    for wrong in ({"scans": {}}, {"scan": {"xlims": [1, -1]}}, {"scan": {"colour": 1}}, {"scan": {"n_ax": 1.5}}, {"scan": {"sound_speed": 0}}, {"pipeline": {"operations": ["nothing"]}}, {"pipeline": {}}):
        with pytest.raises(ConfigError):
            Config.of(wrong)
    (tmp_path / "c.json").write_text(json.dumps({"scan": {"f_number": 1.5}}))
    assert Config.load(str(tmp_path / "c.json")).scan.f_number == 1.5


def test_pipelines_on_disk_and_cached(spark, tmp_path):
    made = Pipeline([{"name": "clip", "params": {"max_value": 3}, "cache": True}, "normalize"])
    for name in ("p.json", "p.yaml"):
        made.save(str(tmp_path / name))
        again = Pipeline.load(str(tmp_path / name))
        assert again.spec() == made.spec()
    df = spark.createDataFrame([(float(i),) for i in range(6)], "data double")
    out = made(df)
    assert "InMemoryRelation" in out._jdf.queryExecution().withCachedData().toString()
    assert sorted(r["data"] for r in out.collect()) == pytest.approx([0, 1 / 3, 2 / 3, 1, 1, 1])
    spark.catalog.clearCache()
