import numpy as np
import pytest

from oscillar.functions import transients
from oscillar.operators import transients as ops


def ringing(rng, n=20_000, fs=1000):
    x = 0.002 * rng.normal(size=n)
    t = np.arange(n - 15_000) / fs
    x[15_000:] += 0.01 * np.exp(-t / 0.2) * np.sin(2 * np.pi * 37 * t)
    x[15_000] += 2.0
    return x


def test_ringdown_of_a_hit_structure():
    got = transients.ringdown(ringing(np.random.default_rng(3)), 1000)
    assert got.status == "ringdown_peak" and abs(got.frequency - 37) < 1.5 and got.reliable and got.durations >= 2


def test_an_impulse_alone_does_not_ring():
    x = 0.002 * np.random.default_rng(11).normal(size=20_000)
    x[15_000] += 2
    assert transients.ringdown(x, 1000).status == "broadband_impact_no_ringdown_peak"


def test_steady_and_late_signals():
    assert transients.ringdown(np.sin(2 * np.pi * 15 * np.arange(20_000) / 1000), 1000).status == "no_transient"
    late = np.zeros(10_000)
    late[9800] = 2
    assert transients.ringdown(late, 1000).status == "need_more_post_event_data"


def test_non_finite_signals_raise():
    with pytest.raises(ValueError, match="non-finite"):
        transients.ringdown(np.array([0, 1, np.nan, -1]), 100)


def test_damping_of_a_resonance():
    f = np.arange(0, 40, 0.01)
    ratio = f / 20
    p = 1 / ((1 - ratio**2) ** 2 + (2 * 0.02 * ratio) ** 2)
    assert abs(transients.half_power_damping(f, p, int(p.argmax())) - 0.02) < 0.001
    assert transients.half_power_damping(f, np.ones_like(f), 5) is None


def test_bootstrap_interval_holds_the_mean():
    x = np.random.default_rng(1).normal(5, 1, 200)
    low, high = transients.bootstrap_interval(x)
    assert low < x.mean() < high and high - low < 0.5 and np.isnan(transients.bootstrap_interval([])[0])


def test_ringdowns_of_odd_windows(spark):
    rows = spark.createDataFrame([(1, ringing(np.random.default_rng(3)).tolist()), (2, None), (3, []), (4, [1.0, None]), (None, [0.0] * 50)], "i long, x array<double>")
    got = {r["id"]: r["status"] for r in ops.ringdowns(rows, "i", "x", 1000.0).collect()}
    assert got == {1: "ringdown_peak", 2: "no_samples", 3: "no_samples", 4: "non_finite", None: "no_transient"}
    assert ops.ringdowns(rows.limit(0), "i", "x", 1000.0).count() == 0


def test_modes_of_two_channels(spark):
    rng, t = np.random.default_rng(5), np.arange(8192) / 256
    tone = np.sin(2 * np.pi * 30 * t)
    rows = [(7, c, (g * tone + 0.01 * rng.normal(size=len(t))).tolist()) for c, g in enumerate((1.0, -0.5))] + [(7, 9, None), (8, 0, [])]
    got = ops.output_only_modes(spark.createDataFrame(rows, "g long, c int, x array<double>"), "g", "c", "x", 256.0, 1024).collect()
    assert {r["grp"] for r in got} == {7}
    first = next(r for r in got if r["rank"] == 1)
    assert abs(first["frequency"] - 30) < 0.5 and abs(first["shape"][1] + 0.5) < 0.05


def test_resampled_windows_keep_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0] * 100), (2, None), (3, [])], "i long, x array<double>")
    got = {r["id"]: r["x"] for r in ops.resampled_windows(rows, "i", "x", 100.0, 50.0).collect()}
    assert len(got[1]) == 50 and abs(got[1][25] - 1) < 1e-9 and got[2] is None and got[3] == []


def test_clusters_reach_as_far_as_their_widest_member():
    """A ringing that short records place less exactly is one cluster over all lengths."""
    t = np.arange(12_000) / 1000
    x = np.where(t > 1, np.exp(-np.maximum(t - 1, 0)) * np.sin(2 * np.pi * 31.3 * np.maximum(t - 1, 0)), 0) + 1e-4 * np.random.default_rng(9).normal(size=len(t))
    got = transients.ringdown(x, 1000)
    assert got.reliable and abs(got.frequency - 31.3) < 0.3 and got.durations >= 2
