"""Array kernels on complex time-frequency grids: frames, interpolation to a common grid, box means, local and cross channels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from oscillar.functions.signal import periodic_window

EPSILON = 1e-12
#: fixed values: the box (bins, frames) over which cross spectra are averaged, and the valid share that a board needs for them.
BOX, LEAST_VALID = (3, 5), 0.98


@dataclass(frozen=True)
class Grid:
    """The common grid of frequencies 0 to max_hz and times 0 to seconds, and how the frames that feed it are cut."""

    fs: float
    seconds: float
    max_hz: float = 6000.0
    bins: int = 192
    times: int = 64
    frame_seconds: float = 0.08
    overlap: float = 0.75
    most_samples: int = 8192

    @property
    def frequencies(self) -> np.ndarray:
        return np.linspace(0.0, self.max_hz, self.bins)

    @property
    def moments(self) -> np.ndarray:
        return np.linspace(0.0, self.seconds, self.times)

    def frame(self, n: int) -> tuple[int, int]:
        """Samples of a frame and from one frame to the next, for a window of n samples: a power of two that covers frame_seconds."""
        asked = max(32, round(self.fs * self.frame_seconds))
        size = min(n, max(32, min(1 << (asked - 1).bit_length(), self.most_samples)))
        return size, size - min(size - 1, round(size * self.overlap))


def filled(x: np.ndarray) -> np.ndarray:
    """Missing samples (nan) on the line between their neighbours; the ends hold the nearest sample, a row without any is zero."""
    out = x.copy()
    places = np.arange(x.shape[-1])
    for row in np.flatnonzero(np.isnan(x).any(-1)):
        known = np.flatnonzero(~np.isnan(x[row]))
        out[row] = np.interp(places, known, x[row, known]) if len(known) else 0.0
    return out


def complex_frames(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, frame centres in seconds and the one-sided spectra [rows, bins, frames] of Hann frames, amplitudes kept."""
    size, step = grid.frame(x.shape[-1])
    w = periodic_window("hann", size)
    starts = np.arange(0, x.shape[-1] - size + 1, step)
    padded = min(grid.most_samples, 1 << (size - 1).bit_length())
    spectra = np.fft.rfft(x[:, starts[:, None] + np.arange(size)] * w, max(padded, size), axis=-1) / w.sum()
    return np.arange(spectra.shape[-1]) * grid.fs / max(padded, size), (starts + size / 2) / grid.fs, spectra.transpose(0, 2, 1)


def line_weights(at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the source point below it and the weight of the next one."""
    below = np.clip(np.searchsorted(source, at, side="right") - 1, 0, max(len(source) - 2, 0))
    width = np.diff(source)[below] if len(source) > 1 else np.ones(len(at))
    return below, (at - source[below]) / width


def to_grid(spectra: np.ndarray, hz: np.ndarray, seconds: np.ndarray, grid: Grid) -> np.ndarray:
    """Spectra [rows, bins, frames] on the common grid, linear in real and imaginary part.

    Nothing is known beyond the last bin (zero there); times before the first and after the last frame take that frame. The
    bin at 0 Hz is zero.
    """
    low, part = line_weights(grid.frequencies, hz)
    high = np.minimum(low + 1, len(hz) - 1)
    out = spectra[:, low] * (1 - part)[:, None] + spectra[:, high] * part[:, None]
    out[:, grid.frequencies > hz[-1]] = 0
    out[:, grid.frequencies == 0] = 0
    if len(seconds) == 1:
        return np.repeat(out, grid.times, axis=-1)
    low, part = line_weights(np.clip(grid.moments, seconds[0], seconds[-1]), seconds)
    return out[..., low] * (1 - part) + out[..., low + 1] * part


def box_means(values: np.ndarray, box: tuple[int, int] = BOX, edges: str = "nearest") -> np.ndarray:
    """Means over boxes of the last two axes, from a summed-area table; a box of even size reaches one cell further back.

    edges: what lies outside, the "nearest" cell or "zero".
    """
    around = [(0, 0)] * (values.ndim - 2) + [(b // 2, (b - 1) // 2) for b in box]
    wide = np.pad(values, around, mode="edge" if edges == "nearest" else "constant")
    sums = np.pad(wide, [(0, 0)] * (values.ndim - 2) + [(1, 0)] * 2).cumsum(-2).cumsum(-1)
    h, w = values.shape[-2:]
    a, b = box
    return (sums[..., a : a + h, b : b + w] - sums[..., :h, b : b + w] - sums[..., a : a + h, :w] + sums[..., :h, :w]) / (a * b)


def local_channels(spectra: np.ndarray) -> list[np.ndarray]:
    """log_power, phase_cos, phase_sin of grids."""
    power = np.abs(spectra) ** 2
    size = np.sqrt(power + EPSILON)
    return [np.log1p(power), spectra.real / size, spectra.imag / size]


def cross_channels(spectra: np.ndarray, reference: np.ndarray) -> list[np.ndarray]:
    """cross_log, cross_cos, cross_sin, coherence of grids against reference grids, averaged over boxes."""
    cross = box_means(spectra * reference.conj())
    size = np.abs(cross)
    powers = box_means(np.abs(spectra) ** 2) * box_means(np.abs(reference) ** 2)
    return [np.log1p(size), cross.real / (size + EPSILON), cross.imag / (size + EPSILON), np.clip(size**2 / (powers + EPSILON), 0.0, 1.0)]
