import cmath

import numpy as np
import pytest

from oscillar.functions import modal
from oscillar.operators import modal as operators


def test_the_walk_stops_at_half_power():
    rng = np.random.default_rng(6)
    for _ in range(50):
        p = rng.exponential(size=30)
        k = int(rng.integers(1, 29))
        left = right = k
        while left > 0 and p[left] > p[k] / 2:
            left -= 1
        while right < 29 and p[right] > p[k] / 2:
            right += 1
        assert modal.half_power_walk(p, k) == (left, right)


def test_damping_of_a_resonance():
    hz = np.arange(0, 40, 0.01)
    ratio = hz / 20
    density = 1 / ((1 - ratio**2) ** 2 + (2 * 0.02 * ratio) ** 2)
    ((frequency, damping, prominence),) = modal.modal_peaks(hz, density, 5.0, 35.0)
    assert abs(frequency - 20) < 0.05 and abs(damping - 0.02) < 0.001 and prominence > 15
    assert modal.modal_peaks(hz, density, 5.0, 5.02) == [] and modal.modal_peaks(hz, np.zeros_like(hz), 5.0, 35.0) == []
    assert modal.modal_peaks(hz[:100], 1 + hz[:100], 0.0, 40.0)[0][2] == 0.0


def test_density_of_a_tone_on_a_line():
    t = np.arange(1024) / 128
    hz, density = modal.segment_density((5 * t + 2 * np.sin(2 * np.pi * 16 * t))[None], 128.0)
    assert hz[1] == 0.5 and hz[density[0].argmax()] == 16 and abs(density[0][28:37].sum() * 0.5 - 2) < 0.05 and density[0][:4].sum() < 1e-3
    assert modal.segment_density(np.ones((2, 7)), 1.0)[1].shape == (2, 0)


def test_kurtosis_is_corrected_for_the_sample():
    assert modal.unbiased_kurtosis(np.arange(10.0)) == pytest.approx(1.8)  # the uniform law's, by the corrected figure of ten equal steps
    assert modal.unbiased_kurtosis(np.ones(9)) == 0.0


def test_subspaces():
    rng = np.random.default_rng(7)
    modes = rng.normal(size=(3, 12)) + 1j * rng.normal(size=(3, 12))
    inside = modes.T @ np.array([1, 2j, -0.5])
    outside = np.linalg.qr(np.vstack([modes, rng.normal(size=(9, 12))]).T)[0][:, 5]
    assert modal.subspace_assurance(inside, modes) == pytest.approx(1) and modal.subspace_assurance(inside, np.vstack([modes, modes])) == pytest.approx(1)
    assert modal.subspace_assurance(outside, modes) < 1e-9 and modal.subspace_assurance(np.zeros(12), modes) == 0
    assert modal.subspace_assurance(inside / np.linalg.norm(inside) + outside, modes) == pytest.approx(0.5)


def test_assurance_of_shapes(spark):
    """Shapes that differ by a complex factor are the same; pairs beyond the tolerance, at cell borders too, are left out."""
    rng = np.random.default_rng(8)
    shape = rng.normal(size=12) + 1j * rng.normal(size=12)
    row = lambda g, k, f, s: (g, k, f, s.real.tolist(), s.imag.tolist())
    kind = "grp int, id int, frequency double, re array<double>, im array<double>"
    a = spark.createDataFrame([row(1, 1, 0.99, shape), row(1, 2, 5.0, np.zeros(12)), row(2, 3, 1.0, shape)], kind)
    b = spark.createDataFrame([row(1, 10, 1.01, shape * cmath.exp(1.2j) * 3), row(1, 11, 1.99, shape.conj()), row(1, 12, 2.0, shape), row(1, 13, 5.5, shape)], kind)
    got = {(r.a, r.b): r.mac for r in operators.complex_assurance(a, b, 1.0).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 13)} and got[1, 10] == pytest.approx(1) and got[2, 13] == 0
    assert got[1, 11] == pytest.approx(abs(np.vdot(shape, shape.conj())) ** 2 / np.vdot(shape, shape).real ** 2)
    share = {r.id: r.share for r in operators.subspace_assurance(a, b).collect()}
    assert share[1] == pytest.approx(1) and share[2] == 0 and set(share) == {1, 2}


def test_odd_axes(spark):
    rows = [(1, 0, "x", [0.0] * 80), (1, 0, "y", [1.0, -1.0] * 40), (1, 0, "z", None), (1, 1, "x", []), (1, 1, "y", [1.0, None, 2.0]), (1, 2, "x", [None] * 70)]
    d = operators.axis_densities(spark.createDataFrame(rows, "recording int, board int, axis string, x array<double>"), 64.0)
    got = {(r.board, r.axis): r for r in d.collect()}
    assert set(got) == {(0, "x"), (0, "y"), (1, "y"), (2, "x")}
    assert got[0, "x"].crest is None and got[0, "x"].kurtosis == 0 and got[0, "y"].rms == 1 and got[1, "y"].rms is None and got[1, "y"].density == [] and got[2, "x"].peak is None
    boards = spark.createDataFrame([(1, 0, None, True)], "recording int, board int, usable_hz double, calibrated boolean")
    peaks = operators.modal_peaks(d, boards, 64.0, 0.1, 32.0).collect()
    assert [(r.board, r["rank"]) for r in peaks if r.board == 0][:1] == [(0, 1)] and not [r for r in peaks if r.board in (1, 2)]
    features = operators.physics_features(d, boards, 64.0, ((1.0, 20.0), (20.0, 40.0))).collect()
    assert {r.feature for r in features if (r.board, r.axis) == (0, "x")} == {"rms", "peak", "kurtosis", "band_energy:1-20"}
