"""Kernels for impacts and what follows them, for output-only modes, and for changing sample rates."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from oscillar.functions import signal

TINY = signal.TINY


class Impact(NamedTuple):
    index: int
    background: float
    ratio: float
    robust_z: float
    detected: bool


class Ringdown(NamedTuple):
    status: str
    event_index: int | None
    frequency: float | None
    prominence_db: float | None
    durations: int
    reliable: bool


def _rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x)))


def find_impact(x: np.ndarray, fs: float, block_s: float = 0.02) -> Impact:
    """The loudest block of a signal centred by its median, held against the median block."""
    size = max(4, round(fs * block_s))
    levels = np.array([_rms(x[k : k + size]) for k in range(0, len(x), size)])
    background = float(np.median(levels))
    spread = 1.4826 * float(np.median(np.abs(levels - background)))
    loudest = int(levels.argmax())
    at = loudest * size + int(np.abs(x[loudest * size : (loudest + 1) * size]).argmax())
    ratio = float(levels[loudest]) / max(background, TINY)
    z = (float(levels[loudest]) - background) / max(spread, 0.05 * background, TINY)
    crest = float(np.abs(x).max()) / max(_rms(x), TINY)
    return Impact(at, background, ratio, z, (ratio >= 4 and z >= 8) or (ratio >= 2.5 and crest >= 8))


def _decays(tail: np.ndarray, background: float) -> tuple[float, float] | None:
    """(energy over the background, early over late level) of a tail that rings, else None."""
    edge = max(1, len(tail) // 5)
    early, late = _rms(tail[:edge]), _rms(tail[-edge:])
    energy, decay = early / max(background, TINY), early / max(late, TINY)
    return (energy, decay) if energy >= 1.35 and decay >= 1.10 else None


def ringdown(x: np.ndarray, fs: float, lowest: float = 0.5, highest: float = 200.0, least_s: float = 0.5, lengths: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0), full_scale: float | None = None) -> Ringdown:
    """Frequency at which a structure rings after an impact, confirmed over tails of several lengths.

    Empty or non-finite signals raise ValueError. With a full scale, a peak at 98 % of it or more is suspected of clipping.
    """
    x = np.asarray(x, np.float64)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("an empty or non-finite signal")
    clipped = full_scale is not None and float(np.abs(x).max()) >= 0.98 * full_scale
    x = x - np.median(x)
    hit = find_impact(x, fs)
    if not hit.detected:
        return Ringdown("no_transient", None, None, None, 0, False)
    tail = x[hit.index + max(1, round(0.005 * fs)) :]
    if len(tail) / fs < least_s:
        return Ringdown("need_more_post_event_data", hit.index, None, None, 0, False)
    fitting = [t for t in lengths if least_s <= t <= len(tail) / fs + 1e-12] or [len(tail) / fs]
    seen = []  # (score, frequency, prominence, length, energy, decay, cycles)
    for length in fitting:
        part = tail[: max(2, round(length * fs))]
        rings = _decays(part, hit.background)
        if rings is None:
            continue
        span = len(part) / fs
        f, p = signal.periodogram(part[None, :], fs)
        inside = (f >= max(lowest, 1 / span)) & (f <= min(highest, fs / 2))
        if inside.sum() < 3:
            continue
        for freq, _, prominence in signal.distinct_peaks(f[inside], p[0][inside], distance=max(0.5, 4 / span)):
            if freq * span >= 3:
                score = prominence + 6 * np.log10(max(rings[0], 1)) + 2 * np.log10(max(rings[1], 1))
                seen.append((score, freq, prominence, length, *rings, freq * span))
    if not seen:
        return Ringdown("broadband_impact_no_ringdown_peak", hit.index, None, None, 0, False)
    clusters: list[list[tuple]] = []
    reach = lambda c: max(max(1.0, 2 / m[3]) for m in c)
    centre = lambda c: float(np.average([m[1] for m in c], weights=[max(1.0, m[2]) for m in c]))
    for s in sorted(seen, reverse=True):  # a cluster reaches as far as the widest of its members
        home = next((c for c in clusters if abs(s[1] - centre(c)) <= reach([*c, s])), None)
        clusters.append([s]) if home is None else home.append(s)
    best = max(clusters, key=lambda c: c[0][0] + 4 * (len({m[3] for m in c}) - 1))
    _, _, prominence, _, energy, decay, cycles = best[0]
    spans = len({m[3] for m in best})
    reliable = (spans >= 2 or (prominence >= 8 and energy >= 2)) and decay >= 1.1 and cycles >= 3 and not clipped
    status = "ringdown_peak" if reliable else "ringdown_peak_clipping_suspected" if clipped else "ringdown_peak_low_confidence"
    return Ringdown(status, hit.index, centre(best), float(prominence), spans, bool(reliable))


def singular_spectrum(channels: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, largest eigenvalue and its vector at each bin of the averaged cross-spectral matrix; channels is (channel, time)."""
    size = min(size, channels.shape[1])
    starts = np.arange(0, channels.shape[1] - size + 1, max(1, size // 2))
    w = signal.periodic_window("hann", size)
    cut = channels[:, starts[:, None] + np.arange(size)]
    spectra = np.fft.rfft((cut - cut.mean(-1, keepdims=True)) * w, axis=-1)
    cross = np.einsum("asf,bsf->fab", spectra, spectra.conj()) / (len(starts) * fs * (w**2).sum())
    values, vectors = np.linalg.eigh(cross)
    return np.fft.rfftfreq(size, 1 / fs), values[:, -1], vectors[:, :, -1]


def half_power_damping(f: np.ndarray, p: np.ndarray, at: int) -> float | None:
    """Damping ratio from the width of a peak at half its power; null if a side does not fall that low."""
    half = p[at] / 2
    lower, upper = np.flatnonzero(p[:at] <= half), np.flatnonzero(p[at + 1 :] <= half)
    if not len(lower) or not len(upper) or f[at] <= 0:
        return None
    i, j = lower[-1], at + 1 + upper[0]
    left = np.interp(half, p[[i, i + 1]], f[[i, i + 1]])
    right = np.interp(-half, -p[[j - 1, j]], f[[j - 1, j]])
    return float((right - left) / (2 * f[at]))


def bootstrap_interval(values: np.ndarray, seed: int = 0, rounds: int = 1000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean under resampling with replacement; (NaN, NaN) without values."""
    values = np.asarray(values, np.float64)
    if not len(values):
        return (float("nan"), float("nan"))
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(rounds)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)
