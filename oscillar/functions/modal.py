"""Array kernels for modal figures: densities of detrended segments, peaks with their half-power widths, assurance of mode shapes."""

from __future__ import annotations

import numpy as np

from oscillar.functions.signal import one_sided, periodic_window, prominences

#: fixed values: a segment's least number of samples, what keeps logarithms finite, the weight of power against prominence in ranks.
LEAST_SEGMENT, FLOOR, POWER_WEIGHT = 64, 1e-24, 1e-3


def segment_density(x: np.ndarray, fs: float, seconds: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the mean one-sided density of half-overlapping Hann segments, a line taken off each; none of rows under 8 samples."""
    n = x.shape[-1]
    size = min(n, max(LEAST_SEGMENT, round(fs * seconds)))
    if size < 8:
        return np.zeros(0), np.zeros((len(x), 0))
    w, j = periodic_window("hann", size), np.arange(size) - (size - 1) / 2
    total, starts = 0.0, range(0, n - size + 1, size - size // 2)
    for k in starts:
        part = x[:, k : k + size]
        part = part - part.mean(-1, keepdims=True) - (part @ j)[:, None] / (j @ j) * j
        total = total + np.abs(np.fft.rfft(part * w, axis=-1)) ** 2
    return np.arange(size // 2 + 1) * fs / size, one_sided(total / len(starts) / (fs * (w @ w)), size)


def ranked_peaks(db: np.ndarray, least_db: float, most: int) -> list[tuple[int, float]]:
    """(place, prominence) of the peaks that stand out most; the highest place, with prominence 0, where none stands out enough."""
    at, high = prominences(db)
    at, high = at[high >= least_db], high[high >= least_db]
    if not len(at):
        return [(int(db.argmax()), 0.0)]
    order = np.argsort(-(high + db[at] * POWER_WEIGHT), kind="stable")[:most]
    return [(int(at[k]), float(high[k])) for k in order]


def half_power_walk(power: np.ndarray, peak: int) -> tuple[int, int]:
    """The nearest bins on either side of a peak with half its power or less; the last bin where there is none."""
    below = np.flatnonzero(power <= power[peak] / 2)
    left, right = below[below < peak], below[below > peak]
    return int(left[-1]) if len(left) else 0, int(right[0]) if len(right) else len(power) - 1


def modal_peaks(hz: np.ndarray, density: np.ndarray, low: float, high: float, most: int = 3, least_db: float = 3.0) -> list[tuple[float, float, float]]:
    """(frequency, damping ratio, prominence in decibels) of the peaks of a density between low and high; none of fewer than four bins."""
    inside = (hz >= low) & (hz <= high) & (density > 0)
    if inside.sum() < 4:
        return []
    hz, power = hz[inside], density[inside]
    out = []
    for k, prominence in ranked_peaks(10 * np.log10(power + FLOOR), least_db, most):
        left, right = half_power_walk(power, k)
        out.append((float(hz[k]), float(np.clip((hz[right] - hz[left]) / (2 * hz[k]), 0.0, 1.0)) if hz[k] > 0 else 0.0, prominence))
    return out


def unbiased_kurtosis(x: np.ndarray) -> float:
    """Pearson's kurtosis, corrected for the size of the sample; of four samples or more that differ, else the plain one."""
    n, d = len(x), x - x.mean()
    m2 = (d**2).mean()
    if m2 <= 0:
        return 0.0
    plain = (d**4).mean() / m2**2
    return ((n * n - 1) * plain - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3 if n > 3 else plain


def subspace_assurance(vector: np.ndarray, modes: np.ndarray) -> float:
    """The share of a complex vector that lies in the space of the modes (rows); dependent modes count once."""
    left, sizes, _ = np.linalg.svd(modes.T, full_matrices=False)
    base = left[:, sizes > np.finfo(np.float64).eps * max(modes.shape) * sizes[0]]
    whole = np.vdot(vector, vector).real
    part = base.conj().T @ vector
    return float(np.clip(np.vdot(part, part).real / whole, 0.0, 1.0)) if whole > 0 else 0.0
