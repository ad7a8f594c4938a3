"""Zero-phase filters in the frequency domain for analysis and display: names and presets, cutoffs, gains, reflected ends."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: fixed values: mains presets, default cutoffs (Hz; shares of half the rate where that is less), notch width, order, padding.
PRESETS = {"notch_50": 50.0, "notch_60": 60.0}
LOW_HZ, LOW_SHARE, HIGH_HZ, HIGH_SHARE, CRAMPED_SHARE = 1.0, 0.1, 6000.0, 0.9, 0.05
NOTCH_HZ, WIDTH_HZ, ORDER, HIGHEST_ORDER = 50.0, 2.0, 4, 12
LEAST_PAD, MOST_PAD, PERIODS = 256, 262_144, 8


@dataclass(frozen=True)
class Filter:
    """kind: highpass, lowpass, bandpass or notch; low and high cutoff, or centre and width of a notch, in Hz."""

    kind: str
    low: float
    high: float
    order: int = ORDER

    def gain(self, hz: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            if self.kind == "notch":  # half the power is gone at half the width from the centre
                return np.sqrt(1 - np.exp2(-((2 * np.abs(hz - self.low) / self.high) ** (2 * self.order))))
            out = np.ones(len(hz))
            if self.kind != "lowpass":
                out = np.where(hz > 0, 1 / np.sqrt(1 + (self.low / hz) ** (2 * self.order)), 0.0)
            return out if self.kind == "highpass" else out / np.sqrt(1 + (hz / self.high) ** (2 * self.order))

    @property
    def slowest(self) -> float:
        """What decides how far the ends reach: the width of a notch, or the lowest cutoff."""
        return self.high if self.kind in ("notch", "lowpass") else self.low


def designed(kind: str, fs: float, low: float | None = None, high: float | None = None, centre: float | None = None, width: float | None = None, order: int = ORDER) -> Filter | None:
    """The filter of a canonical name (see text.filter_name) at a rate; None for none. Raises for cutoffs outside (0, fs / 2)."""
    if kind == "none":
        return None
    half = fs / 2
    if not 1 <= order <= HIGHEST_ORDER:
        raise ValueError("order must be 1 to 12")
    if kind in ("notch", *PRESETS):
        centre = PRESETS.get(kind, NOTCH_HZ if centre is None else centre)
        width = WIDTH_HZ if width is None else width
        if not 0 < centre < half:
            raise ValueError("the centre of a notch must be inside (0, fs / 2)")
        if not 0 < width < 2 * min(centre, half - centre):
            raise ValueError("the edges of a notch must be inside (0, fs / 2)")
        return Filter("notch", centre, width, order)
    usual = min(LOW_HZ, LOW_SHARE * half), min(HIGH_HZ, HIGH_SHARE * half)
    if usual[0] >= usual[1]:
        usual = CRAMPED_SHARE * half, HIGH_SHARE * half
    low, high = usual[0] if low is None else low, usual[1] if high is None else high
    if kind not in ("highpass", "lowpass", "bandpass"):
        raise ValueError(f"no filter {kind!r}")
    if kind != "lowpass" and not 0 < low < half or kind != "highpass" and not 0 < high < half:
        raise ValueError("cutoffs must be inside (0, fs / 2)")
    if kind == "bandpass" and low >= high:
        raise ValueError("the low cutoff must be below the high one")
    return Filter(kind, low, high, order)


def smooth_length(least: int) -> int:
    """The smallest number from `least` on without prime factors above 5; transforms of such lengths are fast."""
    best = 1 << max(least - 1, 0).bit_length()
    fives = 1
    while fives < best:
        threes = fives
        while threes < best:
            twos = -(-least // threes)
            best = min(best, threes << max(twos - 1, 0).bit_length())
            threes *= 3
        fives *= 5
    return best


def filtered(x: np.ndarray, fs: float, chosen: Filter | None) -> np.ndarray:
    """Rows of x without their mean through the filter, the ends reflected; the mean is taken off once more."""
    x = x - x.mean(-1, keepdims=True)
    if chosen is None:
        return x
    n = x.shape[-1]
    pad = min(n - 1, MOST_PAD, max(LEAST_PAD, int(np.ceil(PERIODS * fs / chosen.slowest)))) if n > 2 else 0
    size = smooth_length(n + 2 * pad)
    left = (size - n) // 2
    wide = np.pad(x, [(0, 0), (left, size - n - left)], mode="reflect")
    out = np.fft.irfft(np.fft.rfft(wide, axis=-1) * chosen.gain(np.fft.rfftfreq(size, 1 / fs)), size, axis=-1)[:, left : left + n]
    return out - out.mean(-1, keepdims=True)
