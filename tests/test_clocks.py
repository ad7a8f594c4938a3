import math

import numpy as np
import pytest

from oscillar.functions import resampling
from oscillar.operators import clocks


def plain_polyphase(x, up, down, ends):
    """Every output as a sum over a long stretch of the extended signal."""
    h, n = resampling.lowpass(up, down), len(x)
    half = len(h) // 2
    slope = (x[-1] - x[0]) / max(n - 1, 1)
    value = lambda i: x[i] if 0 <= i < n else 0.0 if ends == "zero" else x[0] + slope * i if i < 0 else x[-1] + slope * (i - n + 1)
    return [sum(value(i) * h[m * down - i * up + half] for i in range(-2 * half, n + 2 * half) if 0 <= m * down - i * up + half < len(h)) for m in range(math.ceil(n * up / down))]


@pytest.mark.parametrize(("up", "down", "n"), [(25, 64, 64), (3, 2, 17), (1, 4, 30), (4, 1, 5), (5, 7, 1)])
@pytest.mark.parametrize("ends", ["line", "zero"])
def test_polyphase_against_sums(up, down, n, ends, monkeypatch):
    monkeypatch.setattr(resampling, "HELD", 200)
    x = np.random.default_rng(n).normal(size=(2, n))
    got = resampling.polyphase(x, up, down, ends)
    assert np.allclose(got, [plain_polyphase(r, up, down, ends) for r in x])


def test_a_tone_keeps_its_form_and_gaps_are_marked():
    t = np.arange(2000) / 1000
    got = resampling.resampled(np.sin(2 * np.pi * 20 * t)[None], 1000, 400)[0]
    assert len(got) == 800 and np.abs(got - np.sin(2 * np.pi * 20 * np.arange(800) / 400))[40:-40].max() < 0.01
    holes = np.ones((1, 2000))
    holes[0, 1000] = np.nan
    got = resampling.resampled(holes, 1000, 400)[0]
    assert np.isnan(got[400]) and np.isfinite(got[30:350]).all() and np.isfinite(got[450:-30]).all()
    assert np.array_equal(resampling.resampled(t[None], 1000, 1000)[0], t) and np.isnan(resampling.resampled(t[None], 1000, 1000, 2001)[0, -1])
    assert resampling.resampled(t[None], 1000, 500, 10).shape == (1, 10)


def test_reference_clock_counts_back_from_the_newest_sample():
    """A ramp stays a ramp whose last sample is the newest; a gap takes with it what the filter could reach."""
    x = np.vstack([np.arange(300.0), np.zeros(300), np.ones(300)])
    got = resampling.on_reference_clock(x, 102.4, 100.0, 2.0)
    assert got.shape == (3, 200) and got[0, -1] == pytest.approx(299, abs=0.1) and np.allclose(np.diff(got[0]), 1.024, atol=0.1)
    x[1, 250] = np.nan
    lost = np.flatnonzero(np.isnan(resampling.on_reference_clock(x, 102.4, 100.0, 2.0)).all(0))
    many, wanted = 205, 200
    up, down = 40, 41
    reach = math.ceil(10 * max(up, down) / up)
    behind = 299 - 250
    want = sorted(wanted - 1 - m for m in range(wanted) if abs(behind - min(many - 1, round(m * down / up))) <= reach)
    assert lost.tolist() == want
    assert np.array_equal(resampling.on_reference_clock(x[:, :200], 100.0, 100.0, 2.0), x[:, :200], equal_nan=True)
    for bad in ((0.0, 1.0, 1.0), (10.0, math.nan, 1.0), (1000.0, 10.0, 1.0), (1.0, 1.0, 0.5)):
        with pytest.raises(ValueError):
            resampling.on_reference_clock(x, *bad)


def samples(groups=3, sensors=4, n=400):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(groups):
        for s in range(sensors - (g == 2)):
            ts = np.sort(rng.uniform(0, 40 - s, n))
            rows += [(g, f"s{s}", float(t), float(v) if v > -1.5 else None) for t, v in zip(ts, rng.normal(size=n), strict=True)]
            rows.append((g, f"s{s}", float(ts[n // 2]), 9.0))
    rows.append((0, "s1", None, 1.0))
    return rows


def plain_windows(rows, rate, seconds, sensors):
    out = {}
    for g in {r[0] for r in rows}:
        held = {}
        for _, s, t, v in (r for r in rows if r[0] == g and r[2] is not None):
            held.setdefault(s, []).append((t, -math.inf if v is None else v))
        end = min(max(x)[0] for x in held.values())
        if len(held) < sensors or end - max(min(x)[0] for x in held.values()) < seconds:
            continue
        for s, x in held.items():
            cells = [None] * round(rate * seconds)
            for t, v in sorted(x):
                k = round((t - (end - seconds)) * rate)
                if end - seconds <= t < end and k < len(cells):
                    cells[k] = None if v == -math.inf else v
            out[g, s] = cells
    return out


KIND = "group int, sensor string, ts double, value double"


def test_latest_windows(spark):
    rows = samples()
    got = {(r.group, r.sensor): r for r in clocks.latest_windows(spark.createDataFrame(rows, KIND), 4.0, 8.0, 4).collect()}
    want = plain_windows(rows, 4.0, 8.0, 4)
    assert {k: r.x for k, r in got.items()} == want and {k[0] for k in want} == {0, 1}
    assert all(abs(r.valid - sum(v is not None for v in r.x) / 32) < 1e-12 and ("excessive_clock_skew" in r.notes) == (r.skew_ms > 50) for r in got.values())
    assert clocks.latest_windows(spark.createDataFrame([], KIND), 4.0, 8.0, 1).count() == 0


def test_stream_gives_the_windows_of_the_batch(spark, tmp_path):
    """Samples come in four pieces, out of order; each piece ends with the window that the batch finds in all samples so far."""
    rows = [r for r in samples() if r[2] is not None]
    cuts = [sorted((r for r in rows if lo <= r[2] < lo + 10), key=lambda r: hash(r)) for lo in (0, 10, 20, 30)]
    seen = []
    for k, part in enumerate(cuts):
        seen += part
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = clocks.stream_latest_windows(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), 4.0, 8.0, 4)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        last = {}
        for r in sorted(got, key=lambda r: r.start):
            last[r.group, r.sensor] = r
        want = {(r.group, r.sensor): r for r in clocks.latest_windows(spark.createDataFrame(seen, KIND), 4.0, 8.0, 4).collect()}
        assert {k: (r.x, r.notes) for k, r in last.items()} == {k: (r.x, r.notes) for k, r in want.items()}, k


def test_captures_too_short_and_out_of_step(spark):
    kind = "capture int, slot int, rate double, x array<double>, ends double, monotonic boolean, mode string, completed double"
    mode = clocks.ALIGNED_MODES[0]
    x = [float(k) for k in range(12)]
    rows = [
        (1, 0, 4.0, x, 100.0, True, mode, 200.0), (1, 1, 4.0, x, 100.6, True, mode, 200.0), (2, 0, 4.0, x, 100.0, True, mode, 200.0), (2, 1, 4.0, x, 101.5, True, mode, 200.0),
        (3, 0, 4.0, x[:3], 100.0, True, mode, 200.0), (4, 0, 4.0, x, 100.0, None, mode, 200.0), (4, 1, 4.0, None, None, True, "other", 200.0),
    ]
    got = {(r.capture, r.slot): r for r in clocks.finalized_captures(spark.createDataFrame(rows, kind), 2.0).collect()}
    assert got[1, 0].x == x[4:] and got[1, 1].x == x[2:10] and got[1, 1].skew_ms == pytest.approx(100) and got[1, 1].sound and got[1, 1].finish == 100.0
    assert got[2, 1].alignment == "own_tail" and got[2, 1].x == x[4:] and got[2, 1].trim_s is None and got[2, 1].start == 198.0 and not got[2, 1].sound
    assert got[3, 0].short and got[3, 0].x is None and got[4, 1].short and got[4, 0].alignment == "own_tail"


def test_boards_that_cannot_be_resampled_have_null_axes(spark):
    rows = [(1, 4.0, 2.0, [1.0] * 8, [2.0] * 8), (2, 4.0, 2.0, [1.0] * 8, [2.0] * 7), (3, 4.0, 2.0, None, [1.0]), (4, 4.0, 2.0, [1.0], [1.0]), (5, None, 2.0, [1.0] * 8, [1.0] * 8)]
    got = {r.id: r for r in clocks.reference_clock(spark.createDataFrame(rows, "id int, rate double, reference_rate double, x array<double>, y array<double>"), ["id"], ["x", "y"], 2.0).collect()}
    assert len(got[1].x) == 4 and got[1].y[-1] == pytest.approx(2, abs=0.01) and all(got[k].x is None and got[k].y is None for k in (2, 3, 4, 5))
