"""Impacts, output-only modes and rate changes over tables of windows; each window or group of channels is one kernel call."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions import resampling, transients

RINGDOWN = "id long, status string, event_index int, frequency double, prominence_db double, durations int, reliable boolean"
MODES = "grp long, rank int, frequency double, power double, damping double, shape array<double>"


def ringdowns(windows: DataFrame, id_col: str, array_col: str, fs: float, **limits) -> DataFrame:
    """A row for each window: what rings after its impact. No shuffle.

    Null and empty windows have the status no_samples, windows with null or non-finite samples the status non_finite. Ids that
    repeat and null ids keep a row each; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = None if not x else np.array(x, np.float64)
                if x is None or not np.isfinite(x).all():
                    out.append((i, "no_samples" if x is None else "non_finite", None, None, None, 0, False))
                else:
                    out.append((i, *transients.ringdown(x, fs, **limits)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("status", pa.string()), ("event_index", pa.int32()), ("frequency", pa.float64()), ("prominence_db", pa.float64()), ("durations", pa.int32()), ("reliable", pa.bool_())])
    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, RINGDOWN)


def output_only_modes(channels: DataFrame, group_col: str, channel_col: str, array_col: str, fs: float, size: int, limit: int = 5) -> DataFrame:
    """grp, rank, frequency, power, damping, shape: peaks of the largest eigenvalue of each group's cross-spectral matrix.

    A group holds the channels of one recording window, so its size is that of a sensor network and not of the table; shapes
    are real parts over the channels in order, the largest entry 1. Channels of other lengths than the group's shortest are
    cut to it; null, empty and non-finite channels are left out, and a group without any gives no row.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.asarray(x, np.float64) for x in rows.sort_values("channel")["x"]]
        x = np.stack([a[: min(map(len, arrays))] for a in arrays])
        f, p, shapes = transients.singular_spectrum(x, fs, size)
        out = []
        for rank, (freq, power, _) in enumerate(transients.signal.distinct_peaks(f[1:], p[1:], limit=limit), 1):
            k = int(np.abs(f - freq).argmin())
            shape = shapes[k] / shapes[k][np.abs(shapes[k]).argmax()]
            out.append((rows["grp"].iloc[0], rank, freq, power, transients.half_power_damping(f, p, k), shape.real.tolist()))
        return pd.DataFrame(out, columns=["grp", "rank", "frequency", "power", "damping", "shape"])

    x = F.col(array_col).cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = channels.filter(usable).select(F.col(group_col).cast("long").alias("grp"), F.col(channel_col).alias("channel"), x.alias("x"))
    return rows.groupBy("grp").applyInPandas(one, MODES)


def resampled_windows(windows: DataFrame, id_col: str, array_col: str, fs: float, to: float, target: int | None = None) -> DataFrame:
    """id, x: every window at the other rate (see resampling.resampled); samples without enough support are null.

    Null windows stay null, empty ones empty; null and nan samples are missing.
    """

    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets, known = np.asarray(lists.offsets), np.asarray(lists.is_valid())
            flat, sizes = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(np.asarray(lists.offsets))
            parts: list[np.ndarray] = [np.zeros(0)] * b.num_rows
            for n in np.unique(sizes[known]):
                rows = np.flatnonzero(known & (sizes == n))
                if n:
                    for k, x in zip(rows, resampling.resampled(flat[offsets[rows][:, None] + np.arange(n)], fs, to, target), strict=True):
                        parts[k] = x
            ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
            values = pa.array(np.concatenate([*parts, np.zeros(0)]), from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~known))], names=["id", "x"])

    return windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x")).mapInArrow(run, "id long, x array<double>")
