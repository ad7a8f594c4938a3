import numpy as np
import pytest

from oscillar.functions import wideband
from oscillar.functions.wideband import Grid
from oscillar.operators import wideband as operators


@pytest.mark.parametrize(("box", "edges"), [((3, 5), "nearest"), ((1, 5), "zero"), ((1, 4), "zero"), ((3, 3), "zero")])
def test_box_means_against_loops(box, edges):
    x = np.random.default_rng(1).normal(size=(2, 6, 7)) + 1j
    got = wideband.box_means(x, box, edges)
    for r, c in np.ndindex(6, 7):
        cells = [(r + i, c + j) for i in range(-(box[0] // 2), (box[0] + 1) // 2) for j in range(-(box[1] // 2), (box[1] + 1) // 2)]
        value = lambda p: x[:, min(max(p[0], 0), 5), min(max(p[1], 0), 6)] if edges == "nearest" or (0 <= p[0] < 6 and 0 <= p[1] < 7) else 0
        assert np.allclose(got[:, r, c], sum(value(p) for p in cells) / (box[0] * box[1]))
    if box[0] == 1:
        assert np.allclose(got[0, 0], np.convolve(x[0, 0], np.ones(box[1]) / box[1], "same"))


def test_filled_gaps():
    x = np.array([[np.nan, 1, np.nan, np.nan, 4, np.nan], [np.nan] * 6, [1, 2, 3, 4, 5, 6], [np.nan, np.nan, 7, np.nan, np.nan, np.nan]])
    assert wideband.filled(x).tolist() == [[1, 1, 2, 3, 4, 4], [0] * 6, [1, 2, 3, 4, 5, 6], [7] * 6]


def test_a_tone_on_the_grid():
    """Its amplitude is half of the tone's at its frequency, none beyond the sampled band, the ends hold the outer frames."""
    grid = Grid(fs=256.0, seconds=4.0, max_hz=200.0, bins=201, times=9, frame_seconds=0.5)
    t = np.arange(1024) / 256
    hz, seconds, spectra = wideband.complex_frames(3 * np.cos(2 * np.pi * 40 * t)[None], grid)
    assert len(hz) == 65 and seconds[0] == 0.25 and np.allclose(np.diff(seconds), 0.125)
    cells = wideband.to_grid(spectra, hz, seconds, grid)[0]
    assert np.allclose(np.abs(cells[40]), 1.5) and not cells[0].any() and not cells[129:].any()
    assert np.allclose(cells[:, 0], wideband.to_grid(spectra[..., :1], hz, seconds[:1], grid)[0, :, 0])


def test_one_frame_fills_all_times():
    grid = Grid(fs=64.0, seconds=0.5, max_hz=32.0, bins=9, times=4)
    cells = wideband.to_grid(*[wideband.complex_frames(np.random.default_rng(0).normal(size=(1, 32)), grid)[k] for k in (2, 0, 1)], grid)
    assert cells.shape == (1, 9, 4) and np.allclose(cells, cells[..., :1])


def test_features_of_boards(spark):
    """A board that repeats the reference is wholly coherent; one out of step, one with gaps and one without the axis have no cross channels."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=256)
    gaps = [None if k < 10 else float(v) for k, v in enumerate(base)]
    rows = [(1, 0, "x", base.tolist()), (1, 1, "x", (2 * base).tolist()), (1, 2, "x", gaps), (1, 3, "y", base.tolist()), (2, 0, "x", base.tolist()), (2, 1, "x", base.tolist()), (3, 1, "x", base.tolist()), (3, 2, "x", []), (3, 4, "x", None)]
    recordings = spark.createDataFrame(rows, "recording int, board int, axis string, x array<double>")
    boards = spark.createDataFrame([(r, b, r != 2, 20.0 if b == 1 else None) for r in (1, 2, 3) for b in range(4)], "recording int, board int, synchronized boolean, usable_hz double")
    grid = Grid(fs=64.0, seconds=4.0, max_hz=40.0, bins=9, times=4)
    got = {(r.recording, r.board, r.axis): r for r in operators.wideband_features(recordings, boards, grid).collect()}
    assert set(got) == {(r, b, a) for r, b, a, x in rows if x} and {k for k, r in got.items() if r.cross_valid} == {(1, 0, "x"), (1, 1, "x")}
    same = got[1, 1, "x"]
    assert same.frequency_valid == [True] * 5 + [False] * 4 and got[1, 0, "x"].frequency_valid == [True] * 7 + [False] * 2
    assert np.allclose(np.reshape(same.coherence, (9, 4))[:5], 1, atol=1e-4) and np.allclose(np.reshape(same.cross_cos, (9, 4))[1:5], 1) and not np.reshape(same.log_power, (9, 4))[5:].any()
    assert not any(got[2, 1, "x"].coherence) and any(got[2, 1, "x"].log_power)
    cells = operators.feature_cells(operators.wideband_features(recordings, boards, grid), grid)
    assert cells.count() == len(got) * 36 and cells.filter("frequency_valid AND cross_valid").count() == 4 * (5 + 7)
