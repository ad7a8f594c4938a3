import numpy as np
import pytest
from pyspark.sql import functions as F

from oscillar.functions import filters, signal
from oscillar.operators import spectra


def test_periodogram_keeps_the_power():
    t = np.arange(8192) / 1024
    x = 0.6 * np.sin(2 * np.pi * 64 * t) + 0.2 * np.sin(2 * np.pi * 192 * t)
    f, p = signal.periodogram(x[None, :], 1024, "rect")
    assert np.isclose(np.sqrt(p.sum() * (f[1] - f[0])), np.sqrt(np.mean((x - x.mean()) ** 2)), rtol=1e-10)


def test_welch_has_three_segments_and_a_fine_resolution():
    x = np.sin(2 * np.pi * 731 * np.arange(5 * 26667) / 26667)
    f, p = signal.welch(x, 26667)
    assert f[1] < 1 and abs(f[p.argmax()] - 731) < 1


def test_peaks_of_a_flat_spectrum_are_none():
    assert signal.distinct_peaks(np.arange(101.0), np.ones(101)) == []


@pytest.mark.parametrize(
    ("kind", "low", "high", "passed", "stopped"),
    [("highpass", 50, None, 100, 5), ("lowpass", None, 50, 10, 300), ("bandpass", 30, 120, 80, 300), ("notch", 50, None, 10, 50), ("notch_50", None, None, 60, 50), ("notch_60", None, None, 50, 60)],
)
def test_filters(kind, low, high, passed, stopped):
    t = np.arange(10_000) / 1000
    made = filters.designed(kind, 1000, low, high)
    gain = lambda f: np.std(filters.filtered(np.sin(2 * np.pi * f * t)[None], 1000, made)[0, 1000:-1000]) * np.sqrt(2)
    assert gain(passed) > 0.75 and gain(stopped) < 0.03


def test_filters_that_cannot_be_made():
    for how in (("lowpass", 100, None, 50.0), ("highpass", 100, 0.0), ("bandpass", 100, 30, 20), ("notch", 100, None, None, 50.0), ("notch", 100, None, None, 10.0, 20.0), ("notch_60", 100), ("comb", 100), ("lowpass", 100, None, None, None, None, 13)):
        with pytest.raises(ValueError):
            filters.designed(*how)
    assert filters.designed("none", 100) is None and filters.designed("highpass", 1e-3).low == pytest.approx(5e-5)
    assert abs(filters.designed("notch", 200, centre=40, width=4).gain(np.array([38.0, 40.0, 42.0])) - [0.5**0.5, 0, 0.5**0.5]).max() < 1e-12


def test_smooth_lengths():
    smooth = lambda n: n == 1 or any(n % p == 0 and smooth(n // p) for p in (2, 3, 5))
    assert [filters.smooth_length(n) for n in range(1, 400)] == [next(m for m in range(n, 2 * n + 1) if smooth(m)) for n in range(1, 400)]
    x = np.array([[1.0, 2.0]])
    assert np.allclose(filters.filtered(x, 10.0, filters.designed("lowpass", 10.0)).sum(), 0)


def test_units_and_identifiers(spark):
    rows = spark.createDataFrame([("m/s²", 9.80665), ("MG", 1000.0), ("?", 1.0), (None, 1.0)], "u string, v double")
    got = [r[0] for r in rows.select(signal.to_g(F.col("v"), F.col("u"))).collect()]
    assert got[:2] == [1.0, 1.0] and got[2:] == [None, None]
    assert spark.range(1).select(signal.safe_id(F.lit("a/b c"))).first()[0] == "a_b_c"
    ok = spark.range(1).select(signal.grounded(F.lit("rms 1.01 at 20"), F.array(F.lit(1.0), F.lit(20.0))), signal.grounded(F.lit("rms 1.2"), F.array(F.lit(1.0)))).first()
    assert tuple(ok) == (True, False)


def test_spectra_skip_null_and_empty_windows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 0.0, -1.0]), (2, None), (3, [])], "id long, x array<double>")
    got = spectra.power_spectra(rows, "id", "x", 4.0).collect()
    assert {r["id"] for r in got} == {1} and len(got) == 3


def test_frames_of_short_windows_are_none(spark):
    rows = spark.createDataFrame([(1, [1.0] * 5), (2, [1.0])], "id long, x array<double>")
    assert spectra.frames(rows, "id", "x", 3, 2).count() == 2


def test_residual_codes_shrink_the_error(spark):
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, x array<double>")
    book = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(8)] + [(8, [0.0] * 4)], "code long, vector array<double>")
    one, two = (spectra.nearest_codes(x, book, "id", "x", stages=s).agg(F.sum("error")).first()[0] for s in (1, 2))
    assert two <= one
