"""Decimation of a stream by an integer factor: the filter's tail and the phase are the state of each sensor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def low_pass(taps: int, cutoff: float) -> np.ndarray:
    """A windowed sine (Hamming) with unit gain at zero; cutoff in parts of half the rate."""
    k = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * k) * np.hamming(taps)
    return h / h.sum()


def decimated(x: np.ndarray, tail: np.ndarray, phase: int, factor: int, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places in x, values, new tail, new phase): the filter is causal, and every factor-th sample of the whole stream is kept."""
    joined = np.append(tail, x)
    y = np.convolve(joined, kernel, "valid")
    at = np.arange((-phase) % factor, len(x), factor)
    return at, y[at], joined[len(joined) - len(tail) :], (phase + len(x)) % factor


def decimated_stream(samples: DataFrame, factor: int, taps: int = 511) -> DataFrame:
    """sensor, ts, value of a stream at a factor-th of its rate; samples arrive in order for each sensor."""
    if factor < 1:
        raise ValueError("the factor is a positive whole number")
    kernel = low_pass(taps + 1 - taps % 2, 0.8 / factor)

    def run(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("ts")
        tail, phase = (np.array(state.get[0]), state.get[1]) if state.exists else (np.zeros(len(kernel) - 1), 0)
        at, value, tail, phase = decimated(rows["value"].to_numpy(np.float64), tail, phase, factor, kernel)
        state.update((tail.tolist(), int(phase)))
        yield pd.DataFrame({"sensor": key[0], "ts": rows["ts"].to_numpy()[at], "value": value})

    rows = samples.select("sensor", "ts", "value").groupBy("sensor")
    return rows.applyInPandasWithState(run, "sensor string, ts timestamp, value double", "tail array<double>, phase long", "append", GroupStateTimeout.NoTimeout)
