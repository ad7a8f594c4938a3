"""Wideband features of recordings of several boards: complex grids row by row, then each board against the reference board.

A recording is a row for each board and axis, with its samples x as an array (null: missing). Grids are much smaller than the
samples they come from, so samples stay where they lie and only grids meet their reference by recording and axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions import wideband
from oscillar.functions.wideband import Grid

KEYS = ["recording", "board", "axis"]
LOCAL, CROSS = ["log_power", "phase_cos", "phase_sin"], ["cross_log", "cross_cos", "cross_sin", "coherence"]
#: complex numbers of frames that a task holds at a time.
HELD = 1 << 21


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in names)


def _lists(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = np.ascontiguousarray(m.reshape(len(m), -1), np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    lo, hi = column.offsets[0].as_py(), column.offsets[-1].as_py()
    return column.values.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def complex_grids(recordings: DataFrame, grid: Grid) -> DataFrame:
    """recording, board, axis, re, im (cells of the grid, by frequency and then time), valid (share of samples that are there).

    Null and empty arrays are left out. Windows may differ in length; a window shorter than 8 samples is left out.
    """

    def run(batches):
        for b in batches:
            column = b.column(3)
            offsets, sizes = np.asarray(column.offsets), np.diff(np.asarray(column.offsets))
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            known = np.asarray(column.is_valid())
            for n in np.unique(sizes[known]):
                if n < 8:
                    continue
                rows = np.flatnonzero(known & (sizes == n))
                size, step = grid.frame(int(n))
                most = max(1, HELD // (size * (1 + (int(n) - size) // step)))
                for part in np.array_split(rows, -(-len(rows) // most)):
                    x = flat[offsets[part][:, None] + np.arange(n)]
                    hz, seconds, spectra = wideband.complex_frames(wideband.filled(x), grid)
                    cells = wideband.to_grid(spectra, hz, seconds, grid)
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), _lists(cells.real), _lists(cells.imag), pa.array(1 - np.isnan(x).mean(-1))], names=[*KEYS, "re", "im", "valid"])

    return recordings.select(*KEYS, F.col("x").cast("array<double>").alias("x")).mapInArrow(run, _kinds(recordings, KEYS) + ", re array<double>, im array<double>, valid double")


def wideband_features(recordings: DataFrame, boards: DataFrame, grid: Grid, reference: int = 0) -> DataFrame:
    """recording, board, axis, the seven channels (cells by frequency and then time), frequency_valid (by frequency) and cross_valid.

    boards: recording, board, synchronized (boolean) and usable_hz (null: all) of every board. Cross channels need samples in step,
    the reference board's axis and 0.98 of the samples of both boards; without, they are zero and cross_valid is false. Cells
    beyond what a board can measure are zero in all channels. An axis that is not there has no row; a board that `boards`
    lacks is not in step.
    """
    grids = complex_grids(recordings, grid)
    base = grids.filter(F.col("board") == reference).select("recording", "axis", F.col("re").alias("re0"), F.col("im").alias("im0"), F.col("valid").alias("valid0"))
    least = wideband.LEAST_VALID
    met = grids.join(boards.select("recording", "board", "synchronized", "usable_hz"), ["recording", "board"], "left").join(base, ["recording", "axis"], "left")
    met = met.select(*KEYS, "re", "im", "re0", "im0", "usable_hz", F.coalesce(F.expr(f"synchronized AND valid >= {least} AND valid0 >= {least}"), F.lit(False)).alias("cross_valid"))
    shape = (-1, grid.bins, grid.times)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            crossed = np.asarray(b.column(8).to_numpy(zero_copy_only=False), bool)
            own = (_matrix(b.column(3)) + 1j * _matrix(b.column(4))).reshape(shape)
            usable = b.column(7).to_numpy(zero_copy_only=False).astype(np.float64)
            most = min(grid.max_hz, grid.fs / 2)
            inside = grid.frequencies <= np.minimum(np.where(np.isnan(usable), most, usable), most)[:, None] + 1e-9
            channels = [c * inside[:, :, None] for c in wideband.local_channels(own)]
            for _ in CROSS:
                channels.append(np.zeros(own.shape))
            at = np.flatnonzero(crossed)
            if len(at):
                take = pa.array(at)
                theirs = (_matrix(b.column(5).take(take)) + 1j * _matrix(b.column(6).take(take))).reshape(shape)
                for k, c in enumerate(wideband.cross_channels(own[at], theirs)):
                    channels[len(LOCAL) + k][at] = c * inside[at][:, :, None]
            valid = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * grid.bins, pa.int32()), pa.array(inside.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *map(_lists, channels), valid, b.column(8)], names=[*KEYS, *LOCAL, *CROSS, "frequency_valid", "cross_valid"])

    fields = ", ".join(f"{c} array<double>" for c in LOCAL + CROSS) + ", frequency_valid array<boolean>, cross_valid boolean"
    return met.mapInArrow(run, _kinds(grids, KEYS) + ", " + fields)


def feature_cells(features: DataFrame, grid: Grid) -> DataFrame:
    """One row for each cell: recording, board, axis, bin, moment, the seven channels, cross_valid, frequency_valid."""
    cells = features.select(*KEYS, "cross_valid", "frequency_valid", F.posexplode(F.arrays_zip(*LOCAL, *CROSS)).alias("at", "cell"))
    cells = cells.withColumn("bin", F.expr(f"CAST(at DIV {grid.times} AS INT)")).withColumn("moment", F.expr(f"CAST(at % {grid.times} AS INT)"))
    return cells.select(*KEYS, "bin", "moment", *(F.col("cell")[c].alias(c) for c in LOCAL + CROSS), "cross_valid", F.element_at("frequency_valid", F.col("bin") + 1).alias("frequency_valid"))


def smoothed_grids(grids: DataFrame, keys: list[str], columns: int, box: tuple[int, int], edges: str = "nearest") -> DataFrame:
    """keys and x smoothed: means over boxes of cells (x holds the rows of a grid of so many columns one after the other)."""

    def run(batches):
        for b in batches:
            lists = b.column(len(keys))
            offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes, known = np.diff(offsets), np.asarray(lists.is_valid())
            for n in np.unique(sizes[known]):
                if n and n % columns == 0:
                    rows = np.flatnonzero(known & (sizes == n))
                    x = flat[offsets[rows][:, None] + np.arange(n)].reshape(len(rows), -1, columns)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), _lists(wideband.box_means(x, box, edges))], names=[*keys, "x"])

    return grids.select(*keys, F.col("x").cast("array<double>").alias("x")).mapInArrow(run, _kinds(grids, keys) + ", x array<double>")
