"""Physics features of recordings: figures of each axis, band energies, modal peaks of each board, relations to the reference board.

A recording is a row for each board and axis with its samples x (null: missing). Samples give a density and a few figures in one
narrow pass; everything after that works on densities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions import modal
from oscillar.functions.wideband import filled

KEYS = ["recording", "board", "axis"]
FIGURES = ["rms", "peak", "crest", "kurtosis"]


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in names)


def _windows(column: pa.Array):
    """(row, samples) of every array that isn't null or empty; null samples are nan."""
    offsets, known = np.asarray(column.offsets), np.asarray(column.is_valid())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for k in np.flatnonzero(known & (np.diff(offsets) > 0)):
        yield k, flat[offsets[k] : offsets[k + 1]]


def axis_densities(recordings: DataFrame, fs: float, seconds: float = 2.0) -> DataFrame:
    """recording, board, axis, rms, peak, crest, kurtosis (of the samples that are there, four at least), density (missing samples bridged), step (Hz from bin to bin)."""

    def run(batches):
        for b in batches:
            rows, figures, densities, steps = [], [], [], []
            for k, x in _windows(b.column(3)):
                there = x[~np.isnan(x)]
                rms = float(np.sqrt((there**2).mean())) if len(there) >= 4 else None
                peak = float(np.abs(there).max()) if len(there) >= 4 else None
                figures.append([rms, peak, peak / rms if rms else None, modal.unbiased_kurtosis(there) if len(there) >= 8 else None])
                hz, density = modal.segment_density(filled(x[None]), fs, seconds)
                rows.append(k)
                densities.append(density[0])
                steps.append(float(hz[1]) if len(hz) > 1 else None)
            take = pa.array(rows, pa.int64())
            columns = [pa.array([f[c] for f in figures], pa.float64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), *columns, pa.array(densities, pa.list_(pa.float64())), pa.array(steps, pa.float64())], names=[*KEYS, *FIGURES, "density", "step"])

    schema = _kinds(recordings, KEYS) + "".join(f", {c} double" for c in FIGURES) + ", density array<double>, step double"
    return recordings.select(*KEYS, F.col("x").cast("array<double>").alias("x")).mapInArrow(run, schema)


def modal_peaks(densities: DataFrame, boards: DataFrame, fs: float, low: float = 0.1, high: float = 100.0, most: int = 3, least_db: float = 3.0) -> DataFrame:
    """recording, board, rank, frequency, damping, prominence_db: the modes of the mean density of a board's axes, up to what the board can measure.

    boards: recording, board, usable_hz (null: all).
    """
    # a board has a density for each axis; they are of one length, as its axes are
    held = densities.filter(F.size("density") > 0).groupBy("recording", "board").agg(F.collect_list("density").alias("axes"), F.max("step").alias("step"))
    held = held.join(boards.select("recording", "board", "usable_hz"), ["recording", "board"], "left")

    def run(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                axes = [a.values.to_numpy() for a in b.column(2)[k]]
                bins = min(map(len, axes))
                usable = b.column(4)[k].as_py()
                top = min(high, fs / 2, fs / 2 if usable is None else usable)
                density = np.mean([a[:bins] for a in axes], axis=0)
                found = modal.modal_peaks(np.arange(bins) * b.column(3)[k].as_py(), density, low, top, most, least_db)
                out += [(k, r, *p) for r, p in enumerate(found, 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["recording", "board", "rank", "frequency", "damping", "prominence_db"])

    return held.mapInArrow(run, _kinds(densities, ["recording", "board"]) + ", rank int, frequency double, damping double, prominence_db double")


def physics_features(densities: DataFrame, boards: DataFrame, fs: float, bands: tuple[tuple[float, float], ...], reference: int = 0, max_hz: float = 6000.0) -> DataFrame:
    """recording, board, axis, feature, value: the figures of every axis, its spectral entropy, band energies, and their ratio to the reference board in decibels.

    boards: recording, board, usable_hz (null: all), calibrated (false: no figure that is in units). A band that reaches beyond
    what a board can measure has no energy; a relation needs the reference board's axis and energy. DataFrame functions only.
    """
    d = densities.join(boards.select("recording", "board", "usable_hz", "calibrated"), ["recording", "board"], "left")
    top = F.least(F.lit(float(max_hz)), F.coalesce("usable_hz", F.lit(fs / 2)))
    d = d.withColumn("top", top).withColumn("in_units", F.coalesce("calibrated", F.lit(True)))
    bins = F.filter(F.transform("density", lambda p, k: F.struct((k * F.col("step")).alias("hz"), p.alias("p"))), lambda c: c["hz"] <= F.col("top"))
    total = F.aggregate("bins", F.lit(0.0), lambda a, c: a + c["p"])
    term = lambda c: (c["p"] / F.col("total")) * F.log(c["p"] / F.col("total") + 1e-18)
    entropy = F.when((F.size("bins") >= 2) & (F.col("total") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.aggregate("bins", F.lit(0.0), lambda a, c: a + term(c)) / F.log(F.size("bins")))))
    d = d.withColumn("bins", bins).withColumn("total", total).withColumn("entropy", entropy)

    def energy(low: float, high: float):
        held = F.filter(F.transform("density", lambda p, k: F.struct((k * F.col("step")).alias("hz"), p.alias("p"))), lambda c: (c["hz"] >= low) & (c["hz"] < high))
        area = F.aggregate(held, F.lit(0.0), lambda a, c: a + c["p"]) - (F.element_at(held, 1)["p"] + F.element_at(held, -1)["p"]) / 2
        return F.when((F.lit(high) <= F.coalesce("usable_hz", F.lit(fs / 2)) + 1e-9) & (F.size(held) > 0), F.when(F.size(held) == 1, F.element_at(held, 1)["p"]).otherwise(area) * F.col("step"))

    named = [(c, F.col(c) if c in ("crest", "kurtosis") else F.when(F.col("in_units"), F.col(c))) for c in FIGURES] + [("spectral_entropy", F.col("entropy"))]
    own = d.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in named))).alias("f")).select(*KEYS, "f.feature", "f.value")
    energies = d.select(*KEYS, "in_units", F.explode(F.array(*(F.struct(F.lit(f"{lo:g}-{hi:g}").alias("band"), energy(lo, hi).alias("energy")) for lo, hi in bands))).alias("e")).select(*KEYS, "in_units", "e.band", "e.energy").filter("energy IS NOT NULL")
    base = energies.filter(F.col("board") == reference).select("recording", "axis", "band", F.col("energy").alias("base"))
    met = energies.join(base, ["recording", "axis", "band"]).filter("base > 0")
    ratio = 10 * F.log10((F.col("energy") + modal.FLOOR) / (F.col("base") + modal.FLOOR))
    in_bands = energies.filter("in_units").select(*KEYS, F.concat(F.lit("band_energy:"), "band").alias("feature"), F.col("energy").alias("value"))
    relations = met.select(*KEYS, F.concat(F.lit("transmissibility_db:"), "band").alias("feature"), ratio.alias("value"))
    return own.filter("value IS NOT NULL").unionByName(in_bands).unionByName(relations)


def complex_assurance(measured: DataFrame, modelled: DataFrame, tolerance: float) -> DataFrame:
    """grp, a, b, mac: the modal assurance of every two shapes of a group whose frequencies differ by no more than the tolerance.

    Both tables: grp, id, frequency, re, im (arrays of one length). Shapes meet in cells as wide as the tolerance, a modelled one
    in its own and both neighbours, so the pairs grow with the shapes that lie close. A shape of zeros has assurance 0.
    """
    cell = F.floor(F.col("frequency") / tolerance)
    a = measured.select("grp", F.col("id").alias("a"), F.col("frequency").alias("fa"), F.col("re").alias("ar"), F.col("im").alias("ai"), cell.alias("cell"))
    b = modelled.select("grp", F.col("id").alias("b"), F.col("frequency").alias("fb"), F.col("re").alias("br"), F.col("im").alias("bi"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = a.join(b, ["grp", "cell"]).filter(F.abs(F.col("fa") - F.col("fb")) <= tolerance)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    real, imaginary = dot("ar", "br") + dot("ai", "bi"), dot("ar", "bi") - dot("ai", "br")
    whole = (dot("ar", "ar") + dot("ai", "ai")) * (dot("br", "br") + dot("bi", "bi"))
    return met.select("grp", "a", "b", F.when(whole > 0, F.least(F.lit(1.0), (real * real + imaginary * imaginary) / whole)).otherwise(0.0).alias("mac"))


def subspace_assurance(measured: DataFrame, modes: DataFrame) -> DataFrame:
    """grp, id, share: how much of every measured shape lies in the space of its group's modes (see modal.subspace_assurance).

    Both tables: grp, id, re, im. A group's modes are one basis, so they are gathered; shapes of a group without modes are left out.
    """
    bases = modes.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("id", "re", "im"))).alias("modes"))
    met = measured.select("grp", "id", "re", "im").join(bases.select("grp", F.col("modes.re").alias("bre"), F.col("modes.im").alias("bim")), "grp")

    def run(batches):
        for b in batches:
            share = []
            numbers = lambda c: np.array(c.as_py(), np.float64)
            for k in range(b.num_rows):
                v, m = (numbers(b.column(c)[k]) + 1j * numbers(b.column(c + 1)[k]) for c in (2, 4))
                share.append(modal.subspace_assurance(v, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], names=["grp", "id", "share"])

    return met.mapInArrow(run, _kinds(measured, ["grp", "id"]) + ", share double")
