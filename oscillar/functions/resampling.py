"""Rational resampling by a polyphase Kaiser filter, with the samples that a filter misses told apart."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np

from oscillar.functions.wideband import filled

#: fixed values: the filter reaches so many samples of the slower rate to either side, its Kaiser window's beta, the share of it that must meet real samples.
REACH, BETA, SUPPORT = 10, 5.0, 0.999
#: numbers that are gathered at a time.
HELD = 1 << 21


def ratio(fs: float, to: float) -> tuple[int, int]:
    """(up, down) of the change of rate."""
    f = Fraction(to / fs).limit_denominator(100_000)
    return f.numerator, f.denominator


@lru_cache(maxsize=16)
def lowpass(up: int, down: int) -> np.ndarray:
    """The filter at the rate that is `up` times the old one: odd length, its sum is `up`."""
    slow = max(up, down)
    n = np.arange(-REACH * slow, REACH * slow + 1)
    h = np.sinc(n / slow) * np.kaiser(len(n), BETA)
    return h / h.sum() * up


def polyphase(x: np.ndarray, up: int, down: int, ends: str = "line") -> np.ndarray:
    """Rows of x at up / down times the rate, ceil(n up / down) samples. ends: beyond them lies the "line" through the first and last sample, or "zero"."""
    h = lowpass(up, down)
    half, n = len(h) // 2, x.shape[-1]
    pad = half // up + 1
    beyond = np.arange(1, pad + 1)
    if ends == "line":
        slope = (x[:, -1:] - x[:, :1]) / max(n - 1, 1)
        wide = np.hstack([x[:, :1] - slope * beyond[::-1], x, x[:, -1:] + slope * beyond])
    else:
        wide = np.pad(x, [(0, 0), (pad, pad)])
    taps = 2 * half // up + 1
    out = np.empty((len(x), -(-n * up // down)))
    step = max(1, HELD // (taps * len(x)))
    for lo in range(0, out.shape[1], step):
        at = np.arange(lo, min(lo + step, out.shape[1]), dtype=np.int64) * down
        first = -((half - at) // up)  # the first sample that the filter meets
        place = first[:, None] + np.arange(taps)
        tap = at[:, None] - place * up + half
        weight = np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)
        out[:, lo : lo + len(at)] = (wide[:, np.clip(place + pad, 0, wide.shape[1] - 1)] * weight).sum(-1)
    return out


def resampled(x: np.ndarray, fs: float, to: float, target: int | None = None) -> np.ndarray:
    """Rows of x (nan: missing) at the rate `to`; nan where the filter met less than 0.999 real samples.

    Missing samples are bridged by lines before the filter. target: samples of the result, which is cut or filled up with nan.
    """
    known = ~np.isnan(x)
    if abs(fs - to) <= max(fs, to) * 1e-9 or not x.shape[-1]:
        out = x.copy()
    else:
        up, down = ratio(fs, to)
        out = polyphase(filled(x), up, down)
        some = np.flatnonzero(~known.all(-1))
        if len(some):
            met = polyphase(known[some].astype(np.float64), up, down, "zero") >= SUPPORT
            out[some] = np.where(met, out[some], np.nan)
    if target is not None:
        out = np.hstack([out[:, :target], np.full((len(out), max(0, target - out.shape[1])), np.nan)])
    return out


def on_reference_clock(x: np.ndarray, source: float, target: float, seconds: float) -> np.ndarray:
    """The last `seconds` of a board's axes [axes, samples] on the clock of the reference board, both counted back from the newest sample.

    A sample that any axis lacks (nan) makes all outputs nan whose filter could reach it.
    """
    if not all(np.isfinite(v) and v > 0 for v in (source, target, seconds)):
        raise ValueError("rates and seconds must be positive numbers")
    many, wanted = round(seconds * source), round(seconds * target)
    if many < 2 or wanted < 2 or x.shape[-1] < many:
        raise ValueError(f"two samples in and out at least, and {many} of the board")
    x = x[:, -many:]
    if many == wanted and abs(source - target) <= 1e-6:
        return x.copy()
    up, down = Fraction(wanted, many).numerator, Fraction(wanted, many).denominator
    known = ~np.isnan(x).any(0)
    out = polyphase(np.where(np.isnan(x), 0.0, x)[:, ::-1], up, down)[:, ::-1].copy()
    if not known.all():
        reach = -(-REACH * max(up, down) // up)
        lost = np.concatenate([[0], np.cumsum(~known[::-1])])
        centre = np.minimum(many - 1, np.rint(np.arange(wanted) * down / up).astype(np.int64))
        near = lost[np.minimum(centre + reach + 1, many)] - lost[np.maximum(centre - reach, 0)]
        out[:, (near > 0)[::-1]] = np.nan
    return out
