"""Spectra of array-valued windows: Arrow batches into numpy kernels, relational work after that in built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.functions import filters, signal, text


def _arrays(column: pa.Array):
    """Rows of equal length as matrices: (row numbers, matrix); null and empty arrays are left out."""
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.asarray(column.is_valid())
    for n in np.unique(sizes[valid]):
        if n > 0:
            rows = np.flatnonzero(valid & (sizes == n))
            yield rows, flat[offsets[rows][:, None] + np.arange(n)]


def _mapped(windows: DataFrame, keys: list[str], fields: str, kernel) -> DataFrame:
    """keys and fields for every window: kernel(matrix of windows of equal length) → a list of columns. No shuffle; null and empty arrays are left out."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            for rows, x in _arrays(b.column(len(keys))):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), *kernel(x)], names=[*keys, *names])

    kinds = dict(windows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + fields.replace("<string double>", "<string,double>")
    return windows.select(*keys, "x").mapInArrow(run, schema)


def spectral_summaries(windows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, dominant_hz, dominant_magnitude, centroid_hz, bandwidth_hz, flatness, top_hz, shares of windows (column x) of 32 samples and more."""
    fields = "dominant_hz double, dominant_magnitude double, centroid_hz double, bandwidth_hz double, flatness double, top_hz array<double>, shares array<double>"

    def kernel(x):
        s = signal.spectral_summary(x, fs)
        return [pa.array(v if v.ndim == 1 else list(v), pa.float64() if v.ndim == 1 else pa.list_(pa.float64())) for v in s.values()]

    return _mapped(windows.filter(F.size("x") >= 32), keys, fields, kernel)


def stft_summaries(windows: DataFrame, keys: list[str], fs: float, size: int = 512, hop: int = 256) -> DataFrame:
    """keys, frames, bins, peak_hz, peak_frame, entropy, concentration of windows (column x) of 32 samples and more."""

    def kernel(x):
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
        return [pa.array(c, k) for c, k in zip(zip(*(signal.stft_summary(row, fs, size, hop) for row in x), strict=True), kinds, strict=True)]

    return _mapped(windows.filter(F.size("x") >= 32), keys, "frames int, bins int, peak_hz double, peak_frame int, entropy double, concentration double", kernel)


def spectrograms(windows: DataFrame, keys: list[str], fs: float, size: int = 256, hop: int = 256) -> DataFrame:
    """keys, frame, power_db: the decibels of the bins of every whole frame, for viewing."""
    framed = windows.filter(F.size("x") >= size).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("x") - size, F.lit(hop)), lambda k: F.slice("x", k + 1, size))).alias("frame", "x"))

    def kernel(x):
        power = np.abs(np.fft.rfft(x * np.hanning(size), axis=-1)) ** 2
        return [pa.array(list(10 * np.log10(np.maximum(power, signal.TINY))), pa.list_(pa.float64()))]

    return _mapped(framed, [*keys, "frame"], "power_db array<double>", kernel)


def window_metrics(windows: DataFrame, keys: list[str], fs: float, expected: int = 0) -> DataFrame:
    """The metrics that sensors are compared by, for windows of window_arrays(): time-domain figures, dominant frequency, velocity, band shares and quality flags.

    Windows of fewer than 32 samples have no spectrum, windows without any sample no figures.
    """
    figures = "rms double, peak double, ptp double, kurtosis double, crest double, std double, dominant_hz double, band_names array<string>, band_values array<double>"

    def kernel(x):
        c = x - x.mean(-1, keepdims=True)
        rms, peak = np.sqrt((c**2).mean(-1)), np.abs(c).max(-1)
        safe = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
        out = [rms, peak, c.max(-1) - c.min(-1), safe((c**4).mean(-1), rms**4), safe(peak, rms), x.std(-1)]
        columns = [pa.array(v) for v in out]
        if x.shape[1] < 32:
            return [*columns, pa.nulls(len(x), pa.float64()), pa.array([[]] * len(x), pa.list_(pa.string())), pa.array([[]] * len(x), pa.list_(pa.float64()))]
        names, shares = signal.band_shares(x, fs)
        f, mag = signal.magnitude_spectrum(x, fs)
        return [*columns, pa.array(f[np.argmax(mag, -1)]), pa.array([names] * len(x), pa.list_(pa.string())), pa.array(list(shares), pa.list_(pa.float64()))]

    held = windows.select(F.struct(*keys, "n", "left_out").alias("held"), "x").filter(F.size("x") > 0)
    done = _mapped(held, ["held"], figures, kernel)
    n, short = F.col("held.n"), F.lit(expected) >= 64
    flags = F.array(F.when(n < 32, "insufficient_samples"), F.when(short & (n < int(expected * 0.75)), "short_window"), F.when(F.col("std") < 1e-10, "flatline"), F.when(F.col("held.left_out") > 0, "non_finite_values"))
    return done.select(
        *(F.col(f"held.{k}").alias(k) for k in keys), n.alias("n"), "rms", "peak", "ptp", "kurtosis", "crest", signal.peak_velocity_mm_s(F.col("rms"), F.col("dominant_hz")).alias("ppv"), "dominant_hz",
        F.map_from_arrays("band_names", "band_values").alias("bands"), F.array_join(F.array_compact(flags), ",").alias("flags"),
    )


def density_summaries(windows: DataFrame, keys: list[str], fs: float, resolution: float = 0.25, limit: int = 5) -> DataFrame:
    """keys, rms, total_power, dominant_hz, peak_hz and peak_db (distinct peaks, refined between bins), bands of the Welch density of every window."""

    def kernel(x):
        out = []
        for row in x:
            f, p = signal.welch(row, fs, resolution)
            df = float(np.median(np.diff(f))) if len(f) > 1 else 1.0
            peaks = signal.distinct_peaks(f, p, limit)
            at = [int(np.argmin(np.abs(f - hz))) for hz, *_ in peaks]
            moved = [float(f[k] + df * (signal.parabolic_offset(p[k - 1], p[k], p[k + 1]) if 0 < k < len(p) - 1 else 0)) for k in at]
            cut = lambda lo, hi: float(p[(f >= lo) & (f < hi) & (f > 0)].sum() * df)
            bands = {f"{lo:g}-{hi:g}" if hi < float("inf") else f"{lo:g}+": cut(lo, hi) for lo, hi in signal.BANDS if lo < fs / 2}
            strongest = int(np.argmax(np.where(f > 0, p, 0)))
            out.append((float(np.sqrt(((row - row.mean()) ** 2).mean())), float(p[1:].sum() * df), float(f[strongest]), moved, [float(10 * np.log10(max(v, signal.TINY))) for _, v, _ in peaks], list(bands), list(bands.values())))
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64()))
        return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]

    fields = "rms double, total_power double, dominant_hz double, peak_hz array<double>, peak_db array<double>, band_names array<string>, band_values array<double>"
    return _mapped(windows, keys, fields, kernel).withColumn("bands", F.map_from_arrays("band_names", "band_values")).drop("band_names", "band_values")


def aligned_windows(samples: DataFrame, seconds: float) -> DataFrame:
    """The samples of the last `seconds` before the common end, the earliest of the sensors' latest times. The end is one value, found by one aggregation."""
    latest = samples.groupBy("sensor").agg(F.max("ts").alias("ts"))
    end = latest.agg(F.min("ts").alias("end"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return samples.join(F.broadcast(end)).filter((F.col("ts") <= F.col("end")) & (micros("ts") > micros("end") - int(seconds * 1e6))).drop("end")


def density_deltas(summaries: DataFrame, reference: str) -> DataFrame:
    """sensor, band, power, delta_db against the reference sensor's band (null without it), dominant_shift_hz, rms_db."""
    rows = summaries.select("sensor", "rms", "dominant_hz", F.explode("bands").alias("band", "power"))
    base = rows.filter(F.col("sensor") == reference).select("band", F.col("power").alias("ref_power"), F.col("dominant_hz").alias("ref_hz"), F.col("rms").alias("ref_rms"))
    met = rows.filter(F.col("sensor") != reference).join(base, "band", "left")
    db = lambda a, b, k: k * F.log10(F.greatest(F.col(a), F.lit(signal.TINY)) / F.greatest(F.col(b), F.lit(signal.TINY)))
    return met.select("sensor", "band", "power", db("power", "ref_power", 10).alias("delta_db"), (F.col("dominant_hz") - F.col("ref_hz")).alias("dominant_shift_hz"), db("rms", "ref_rms", 20).alias("rms_db"))


def power_spectra(windows: DataFrame, id_col: str, array_col: str, fs: float, window: str = "hann") -> DataFrame:
    """id, bin, frequency, power: the periodogram of every window, a row for each bin. No shuffle."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for rows, x in _arrays(b.column(1)):
                f, p = signal.periodogram(x, fs, window)
                take = pa.array(np.repeat(rows, len(f)))
                yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(np.tile(np.arange(len(f), dtype=np.int32), len(rows))), pa.array(np.tile(f, len(rows))), pa.array(p.ravel())], names=["id", "bin", "frequency", "power"])

    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, bin int, frequency double, power double")


def band_powers(windows: DataFrame, id_col: str, array_col: str, fs: float) -> DataFrame:
    """id, band, power (sum times bin width), rms, fraction of the window's total; the constant is left out. Bands are summed where the window lies, without a shuffle."""
    names = [f"{lo:g}-{hi:g}" if hi < float("inf") else f"{lo:g}+" for lo, hi in signal.BANDS if lo < fs / 2]

    def kernel(x):
        f, p = signal.periodogram(x, fs)
        df = f[1] - f[0]
        sums = np.stack([p[:, (f >= lo) & (f < hi) & (f > 0)].sum(-1) * df for lo, hi in signal.BANDS if lo < fs / 2], -1)
        return [pa.array(list(sums), pa.list_(pa.float64()))]

    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    sums = _mapped(rows, ["id"], "powers array<double>", kernel)
    total = F.aggregate("powers", F.lit(0.0), lambda a, v: a + v)
    long = sums.select("id", total.alias("total"), F.posexplode("powers").alias("k", "power"))
    return long.select("id", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("band"), "power", F.sqrt("power").alias("rms"), F.when(F.col("total") > 0, F.col("power") / F.col("total")).alias("fraction"))


def local_peaks(windows: DataFrame, id_col: str, array_col: str, fs: float, k: int = 3) -> DataFrame:
    """id, rank, bin, frequency, power, refined_hz of the k strongest strict-left, non-strict-right local maxima of each window; refined between bins by a parabola."""

    def run(batches):
        for b in batches:
            for rows, x in _arrays(b.column(1)):
                f, p = signal.periodogram(x, fs)
                peak = np.zeros(p.shape, bool)
                peak[:, 1:-1] = (p[:, 1:-1] > p[:, :-2]) & (p[:, 1:-1] >= p[:, 2:])
                order = np.argsort(np.where(peak, -p, np.inf), axis=-1, kind="stable")[:, :k]
                found = np.take_along_axis(peak, order, -1)
                i, rank = np.nonzero(found)
                at = order[i, rank]
                moved = f[at] + (f[1] - f[0]) * signal.parabolic_offset(p[i, at - 1], p[i, at], p[i, at + 1])
                take = pa.array(rows[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array((rank + 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(f[at]), pa.array(p[i, at]), pa.array(moved)], names=["id", "rank", "bin", "frequency", "power", "refined_hz"]
                )

    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, rank int, bin int, frequency double, power double, refined_hz double")


def plot_buckets(spectra: DataFrame, low: float, high: float, buckets: int = 16) -> DataFrame:
    """id, bucket, floor (median of the positive powers), peak_hz and peak (the strongest bin) over logarithmic frequency buckets, for plots."""
    at = F.floor(F.log(F.col("frequency") / low) / float(np.log(high / low)) * buckets)
    inside = spectra.filter((F.col("frequency") >= low) & (F.col("frequency") < high)).withColumn("bucket", at.cast("int"))
    peak = F.max(F.struct("power", (-F.col("frequency")).alias("minus_hz")))
    out = inside.groupBy("id", "bucket").agg(F.percentile(F.when(F.col("power") > 0, F.col("power")), 0.5).alias("floor"), peak.alias("p"))
    return out.select("id", "bucket", "floor", (-F.col("p.minus_hz")).alias("peak_hz"), F.col("p.power").alias("peak"))


def nearest_bins(spectra: DataFrame, asked: DataFrame) -> DataFrame:
    """For rows of asked (id, hz) the nearest bin of the id's spectrum: id, hz, bin, power; ties go to the lower bin."""
    met = spectra.join(asked, "id")
    best = met.groupBy("id", "hz").agg(F.min(F.struct(F.abs(F.col("frequency") - F.col("hz")).alias("d"), "bin", "power")).alias("b"))
    return best.select("id", "hz", "b.bin", "b.power")


def spectral_shape(spectra: DataFrame, low: float, high: float) -> DataFrame:
    """id, entropy (over the logarithm of the number of bins), band_energy (trapezoids within [low, high); a single bin counts by its width), total_power."""
    from pyspark.sql import Window

    run = Window.partitionBy("id").orderBy("bin")
    p = spectra.withColumns({"f0": F.lag("frequency").over(run), "p0": F.lag("power").over(run), "total": F.sum("power").over(Window.partitionBy("id")), "df": F.col("frequency") - F.lag("frequency").over(run)})
    share = F.col("power") / F.col("total")
    inside = (F.col("frequency") >= low) & (F.col("frequency") < high)
    trapezoid = F.when(inside & (F.col("f0") >= low), (F.col("power") + F.col("p0")) / 2 * (F.col("frequency") - F.col("f0")))
    agg = p.groupBy("id").agg(
        (-F.sum(F.when(share > 0, share * F.log(share))) / F.log(F.count(F.lit(1)))).alias("entropy"), F.sum(trapezoid).alias("t"), F.count_if(inside).alias("k"), F.sum(F.when(inside, F.col("power"))).alias("s"),
        F.percentile("df", 0.5).alias("df"), F.sum("power").alias("all"),
    )
    energy = F.when(F.col("k") == 0, F.lit(0.0)).when(F.col("k") == 1, F.col("s") * F.col("df")).otherwise(F.col("t"))
    return agg.select("id", "entropy", energy.alias("band_energy"), (F.col("all") * F.col("df")).alias("total_power"))


PEAK = ["frequency", "bin_frequency", "power", "prominence_db", "band_rms", "phase_degrees"]


def peaks_of(windows: DataFrame, id_col: str, array_col: str, fs: float, resolution: float = 0.25, limit: int = 5) -> DataFrame:
    """id, rank and PEAK of the distinct peaks of each window's averaged density, the strongest first (see signal.refined_peaks)."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for rows, x in _arrays(b.column(1)):
                for i, row in zip(rows, x, strict=True):
                    peaks = signal.refined_peaks(*signal.welch(row, fs, resolution), row, fs, limit=limit)
                    ids += [i] * len(peaks)
                    out += [(r, *p) for r, p in enumerate(peaks, 1)]
            m = np.array(out, np.float64).reshape(-1, 1 + len(PEAK))
            columns = [pa.array(np.ascontiguousarray(m[:, 1 + k])) for k in range(len(PEAK))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(m[:, 0].astype(np.int32)), *columns], names=["id", "rank", *PEAK])

    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, rank int, " + ", ".join(f"{c} double" for c in PEAK))


def spectrum_reports(windows: DataFrame, id_col: str, array_col: str, fs: float, resolution: float = 0.25, limit: int = 5, rival_db: float = 3.0) -> DataFrame:
    """id, n, seconds, centred_rms, psd_rms, consistency, variance_consistency, peaks, lead_db, rival_hz, rival, effective_hz, effective_kind, reliable of each window.

    consistency is the rms by the density over that of the samples without their mean (null for flat windows). lead_db is how far
    the two strongest peaks are apart, rival whether that is less than rival_db. The effective peak is the strongest of the
    averaged density, or else that of a ring-down, which counts as reliable if the ring-down says so.
    """
    from oscillar.functions import transients

    names = ["n", "centred_rms", "psd_rms", "lead_db", "rival_hz", "effective_hz", "effective_kind", "reliable", "peaks"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.int32()]

    def report(x: np.ndarray) -> tuple:
        f, p = signal.welch(x, fs, resolution)
        peaks = signal.refined_peaks(f, p, x, fs, limit=limit)
        lead = abs(10 * np.log10(peaks[0][2] / peaks[1][2])) if len(peaks) > 1 else None
        told = (peaks[0][0], "averaged_psd", True) if peaks else (None, None, False)
        if not peaks and np.isfinite(x).all():
            ring = transients.ringdown(x, fs)
            if ring.frequency is not None:
                told = (ring.frequency, "impact_ringdown", bool(ring.reliable))
        return len(x), float(x.std()), float(np.sqrt(p.sum() * np.median(np.diff(f)))), lead, peaks[1][0] if len(peaks) > 1 else None, *told, len(peaks)

    def run(batches):
        for b in batches:
            ids, out = [], []
            for rows, x in _arrays(b.column(1)):
                if x.shape[1] >= 8:
                    ids += rows.tolist()
                    out += map(report, x)
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *columns], names=["id", *names])

    rows = windows.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    found = rows.mapInArrow(run, "id long, n int, centred_rms double, psd_rms double, lead_db double, rival_hz double, effective_hz double, effective_kind string, reliable boolean, peaks int")
    share = F.when(F.col("centred_rms") > 0, F.col("psd_rms") / F.col("centred_rms"))
    return found.select(
        "id", "n", (F.col("n") / fs).alias("seconds"), "centred_rms", "psd_rms", share.alias("consistency"), (share * share).alias("variance_consistency"), "peaks", "lead_db", "rival_hz",
        F.coalesce(F.col("lead_db") < rival_db, F.lit(False)).alias("rival"), "effective_hz", "effective_kind", "reliable",
    )


def frames(windows: DataFrame, id_col: str, array_col: str, size: int, hop: int) -> DataFrame:
    """id, frame, x: sliding frames of every window; windows shorter than a frame give none."""
    n = F.size("x")
    at = F.explode(F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop))))
    rows = windows.select(F.col(id_col).alias("id"), F.col(array_col).alias("x")).select("id", "x", at.alias("start"))
    return rows.select("id", (F.col("start") / hop).cast("int").alias("frame"), F.slice("x", F.col("start") + 1, size).alias("x"))


def nearest_codes(vectors: DataFrame, codebook: DataFrame, id_col: str, array_col: str, stages: int = 2, most: int = 65_536) -> DataFrame:
    """id, codes, error: residual vector quantisation; each stage takes the nearest codeword and leaves the rest to the next.

    The codebook (code, vector) is collected and must have at most `most` rows.
    """
    found = codebook.select("code", F.col("vector").cast("array<double>")).orderBy("code").limit(most + 1).collect()
    if not found or len(found) > most:
        raise ValueError(f"a codebook has 1 to {most} rows")
    codes = np.array([r[0] for r in found], np.int64)
    book = np.array([r[1] for r in found], np.float64)

    def run(batches):
        for b in batches:
            for rows, x in _arrays(b.column(1)):
                picked = []
                for _ in range(stages):
                    near = np.argmin((book**2).sum(1)[None, :] - 2 * x @ book.T, axis=1)
                    picked.append(codes[near])
                    x = x - book[near]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.stack(picked, 1).tolist(), pa.list_(pa.int64())), pa.array((x**2).sum(1))], names=["id", "codes", "error"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, codes array<bigint>, error double")


def levels(windows: DataFrame, reference: str) -> DataFrame:
    """sensor, win, level_db, level_rel_db of arrays x: the RMS in decibels, and against the reference sensor's window of the same time (null without it)."""
    x = F.transform("x", lambda v: v.cast("double"))
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size("x"))
    begin = F.struct(mean.alias("mean"), F.lit(0.0).alias("total"))  # the mean is worked out once a window and not once a sample
    rms = F.aggregate(x, begin, lambda a, v: F.struct(a["mean"].alias("mean"), (a["total"] + (v - a["mean"]) * (v - a["mean"])).alias("total")), lambda a: F.sqrt(F.try_divide(a["total"], F.size("x"))))
    own = windows.select("sensor", "win", (20 * F.log10(F.greatest(rms, F.lit(1e-12)))).alias("level_db"))
    base = own.filter(F.col("sensor") == reference).select("win", F.col("level_db").alias("ref_"))
    return own.join(base, "win", "left").select("sensor", "win", "level_db", (F.col("level_db") - F.col("ref_")).alias("level_rel_db"))


def board_relations(bands: DataFrame, reference: int) -> DataFrame:
    """episode, board, band, transmissibility_db: the power of each board's band against the reference board's of the same episode."""
    base = bands.filter(F.col("board") == reference).select("episode", "band", F.col("power").alias("ref_"))
    met = bands.filter(F.col("board") != reference).join(base, ["episode", "band"], "left")
    db = 10 * F.log10(F.greatest(F.col("power"), F.lit(1e-18)) / F.greatest(F.col("ref_"), F.lit(1e-18)))
    return met.select("episode", "board", "band", db.alias("transmissibility_db"))


def board_coherence(pairs: DataFrame, keys: list[str], fs: float, size: int, bands: tuple[tuple[float, float], ...]) -> DataFrame:
    """keys, band, coherence: the mean coherence of two boards' arrays (x, y, of one length) in each band; only for boards that sample in step."""

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True):
                f, c = signal.coherence(np.asarray(x, np.float64), np.asarray(y, np.float64), fs, size)
                out.append([float(c[(f >= lo) & (f < hi)].mean()) for lo, hi in bands])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "means"])

    kinds = dict(pairs.dtypes)
    rows = pairs.filter((F.size("x") == F.size("y")) & (F.size("x") >= size)).select(*keys, "x", "y")
    means = rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", means array<double>")
    names = F.array(*(F.lit(f"{lo:g}-{hi:g}") for lo, hi in bands))
    return means.select(*keys, F.posexplode("means").alias("k", "coherence")).select(*keys, F.element_at(names, F.col("k") + 1).alias("band"), "coherence")


def dominant_peaks(windows: DataFrame, keys: list[str], fs: float, most: int = 3, least_db: float = 3.0) -> DataFrame:
    """keys, rank, frequency, prominence_db: the peaks of each window's density (column x) that stand out most in decibels; the highest bin where none does."""

    def run(batches):
        for b in batches:
            out = []
            for rows, x in _arrays(b.column(len(keys))):
                f, p = signal.periodogram(x, fs)
                for i, db in zip(rows, 10 * np.log10(p[:, 1:] + 1e-24), strict=True):
                    at, high = signal.prominences(db)
                    at, high = at[high >= least_db], high[high >= least_db]
                    if not len(at):
                        at, high = np.array([int(db.argmax())]), np.zeros(1)
                    order = np.argsort(-(high + db[at] * 1e-3), kind="stable")[:most]
                    out += [(i, r, float(f[at[k] + 1]), float(high[k])) for r, k in enumerate(order, 1)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            take = pa.array(list(cols[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.float64()), pa.array(list(cols[3]), pa.float64())], names=[*keys, "rank", "frequency", "prominence_db"])

    kinds = dict(windows.dtypes)
    return windows.select(*keys, "x").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rank int, frequency double, prominence_db double")


def filtered_windows(windows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, kind (canonical), fault and x of every window, through the filter that its row names.

    windows: x, filter (a name or an alias, null: none), low_hz, high_hz, notch_hz, width_hz, filter_order (null: the usual). A
    window whose filter is unknown or can't be made at this rate has the reason as fault and no x. Null and empty windows are
    left out.
    """
    given = ["low_hz", "high_hz", "notch_hz", "width_hz", "filter_order"]
    named = windows.withColumn("kind_", text.filter_name(F.col("filter"))).select(*keys, F.col("x").cast("array<double>").alias("x"), "kind_", *(F.col(c).cast("double").alias(c) for c in given))
    k0 = len(keys)

    def run(batches):
        for b in batches:
            told = list(zip(*(b.column(k0 + 1 + c).to_pylist() for c in range(1 + len(given))), strict=True))
            for rows, x in _arrays(b.column(k0)):
                out: list = [None] * len(rows)
                faults: list = [None] * len(rows)
                for asked in dict.fromkeys(told[r] for r in rows):
                    same = np.array([i for i, r in enumerate(rows) if told[r] == asked])
                    kind, low, high, centre, width, order = asked
                    try:
                        if kind is None:
                            raise ValueError("unknown filter")
                        for i, y in zip(same, filters.filtered(x[same], fs, filters.designed(kind, fs, low, high, centre, width, filters.ORDER if order is None else int(order))), strict=True):
                            out[i] = y
                    except ValueError as e:
                        for i in same:
                            faults[i] = str(e)
                take = pa.array(rows)
                columns = [*(b.column(k).take(take) for k in range(k0)), b.column(k0 + 1).take(take), pa.array(faults, pa.string()), pa.array(out, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "kind", "fault", "x"])

    kinds = dict(windows.dtypes)
    return named.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, fault string, x array<double>")
