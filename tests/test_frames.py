"""Whole-frame numerics against direct NumPy."""

import numpy as np
import pytest

from sonarium.operators import frames

rng = np.random.default_rng(3)


def test_analytic_of_a_cosine_is_a_turning_phase():
    t = np.arange(64)
    made = frames.analytic(np.cos(2 * np.pi * 5 * t / 64))
    assert np.allclose(made, np.exp(2j * np.pi * 5 * t / 64))
    with pytest.raises(ValueError):
        frames.analytic(np.ones(8), 4)


def test_down_and_up_mixing_return_the_signal():
    fs, fc = 64.0, 8.0
    t = np.arange(256) / fs
    x = (np.hanning(256) * np.cos(2 * np.pi * fc * t))[:, None]
    iq = frames.demodulate(x, fs, fc)
    assert iq.shape == (256, 2)
    back = frames.upmix(iq, fs, fc, 1) / np.sqrt(2)
    assert np.abs(back - x).max() < 1e-2
    assert np.allclose(frames.envelope(x)[20:-20], np.hanning(256)[20:-20], atol=1e-2)


def test_gaussian_matches_a_direct_sum():
    x = rng.normal(size=(9, 7))
    made = frames.gaussian(x, 1.0, 0)
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    kernel /= kernel.sum()
    wide = np.pad(x, ((4, 4), (0, 0)), mode="symmetric")
    assert np.allclose(made, [(kernel[:, None] * wide[i : i + 9]).sum(axis=0) for i in range(9)])


def test_filters_leave_a_constant_image():
    x = np.full((8, 8), 2.5)
    assert np.allclose(frames.gaussian_blur(x, 1.0), x)
    assert np.allclose(frames.lee_filter(x, 1.0), x)


def test_diffusion_smooths():
    x = rng.normal(size=(32, 32)) * 0.1
    made = frames.anisotropic_diffusion(x, 30, 0.1, rect=(4, 4, 20, 20))
    assert made[8:24, 8:24].std() < x[8:24, 8:24].std()


def test_scan_conversion_and_back():
    r, t = np.meshgrid(np.linspace(0, 1, 60), np.linspace(-0.7, 0.7, 60), indexing="ij")
    x = np.exp(-((r - 0.6) ** 2 + t**2) * 8)
    made = frames.scan_convert(x, (0.2, 1.0), (-0.7, 0.7), resolution=0.005)
    width = (made.shape[1] - 1) * 0.005
    low = 0.2 * np.cos(0.7)
    left = -np.sin(0.7)
    back = frames.inverse_scan_convert(made, (left, left + width, low, low + (made.shape[0] - 1) * 0.005), (0.2, 1.0), (-0.7, 0.7), (60, 60))
    assert np.mean((back[5:-5, 5:-5] - x[5:-5, 5:-5]) ** 2) < 1e-3
    with pytest.raises(NotImplementedError):
        frames.sample_at(x, r, t, order=3)


def test_simulated_echo_arrives_when_it_should():
    probe = np.stack([(np.arange(16) - 7.5) * 3e-4, np.zeros(16), np.zeros(16)], axis=1)
    fs, fc, speed = 25e6, 5e6, 1540.0
    at = np.array([[0.0, 0.0, 8e-3]])
    rf = frames.simulate_rf(at, np.ones(1), probe, np.zeros(16), np.ones(16), 0.0, 512, fs, fc, speed)
    peak = np.argmax(frames.envelope(rf[..., None])[:, 8])
    assert abs(peak - 2 * 8e-3 / speed * fs) < 6


def test_pressure_is_highest_in_front():
    probe = np.stack([(np.arange(32) - 15.5) * 3e-4, np.zeros(32), np.zeros(32)], axis=1)
    points = np.array([[0, 0, 15e-3], [14e-3, 0, 15e-3]])
    p = frames.pressure_field(points, probe, np.zeros(32), np.ones(32), 5e6)
    assert p[0] > p[1] > 0


def test_frames_run_the_same_in_any_partitioning(spark):
    rows = [(i, [4, 4], rng.normal(size=16).tolist()) for i in range(10)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id int, shape array<int>, data array<float>")
    steps = [lambda x: frames.gaussian_blur(x, 0.7), lambda x: x[:2]]
    one = sorted(frames.on_frames(df.coalesce(1), steps).collect())
    many = sorted(frames.on_frames(df.repartition(7), steps).collect())
    assert str(one) == str(many)
    assert one[0]["shape"] == [2, 4] and one[-1]["data"] is None


def test_square_wave():
    assert frames.square_wave(6, 2).tolist() == [1, 1, -1, -1, 1, -1]
