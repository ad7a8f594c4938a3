"""Several boards on one clock: the latest common window on a grid of samples, the last window before a common end, and rates made alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oscillar.functions import resampling

#: fixed values: how captures can be known to share a clock.
ALIGNED_MODES = ("sdk_timestamp_common_xyz_end", "fixed_start_time_xyz")


def _windows(cells: DataFrame, rate: float, seconds: float, most_missing: float, most_skew_ms: float) -> DataFrame:
    """Samples and flags of windows from their cells (group, sensor, start, skew_ms, cells: array of k and value)."""
    n = round(rate * seconds)
    held = F.map_from_entries("cells")
    x = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.try_element_at(held, k))
    valid = F.size(F.filter("x", lambda v: v.isNotNull())) / n
    notes = F.array_compact(F.array(F.when(1 - F.col("valid") > most_missing, "excessive_missing_samples"), F.when(F.abs("skew_ms") > most_skew_ms, "excessive_clock_skew")))
    out = cells.withColumn("x", x).withColumn("valid", valid)
    return out.select("group", "sensor", "start", "skew_ms", "x", "valid", notes.alias("notes"))


def latest_windows(samples: DataFrame, rate: float, seconds: float, sensors: int, most_missing: float = 0.02, most_skew_ms: float = 50.0) -> DataFrame:
    """group, sensor, start, skew_ms, x, valid, notes: each sensor's samples of the last `seconds` before the end that all sensors of the group have reached.

    samples: group, sensor, ts (seconds), value. A sample belongs to the place of the grid that is nearest to it (ties to the
    even one); of several, the latest counts, and the larger value of equal times. Places without a sample, and null values, are
    null. Groups with fewer than `sensors` sensors, and those in which a sensor doesn't reach back far enough, are left out.
    """
    n = round(rate * seconds)
    spans = samples.filter("ts IS NOT NULL").groupBy("group", "sensor").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    # the end is the least of the latest times; every sensor must reach back to the start of the window
    ends = spans.groupBy("group").agg(F.count(F.lit(1)).alias("seen"), F.min("latest").alias("end"), F.max("earliest").alias("youngest"))
    ends = ends.filter((F.col("seen") >= sensors) & (F.col("end") - F.col("youngest") >= seconds)).select("group", "end", (F.col("end") - seconds).alias("start"))
    inside = samples.join(ends, "group").filter((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    placed = inside.withColumn("k", F.rint((F.col("ts") - F.col("start")) * rate).cast("long")).filter(F.col("k") < n)
    single = placed.groupBy("group", "sensor", "k").agg(F.max(F.struct("ts", "value")).alias("last"))
    cells = single.groupBy("group", "sensor").agg(F.collect_list(F.struct("k", F.col("last.value").alias("value"))).alias("cells"))  # a window has n places
    every = spans.join(ends, "group").join(cells, ["group", "sensor"], "left")
    none = F.array().cast("array<struct<k: bigint, value: double>>")
    every = every.select("group", "sensor", "start", ((F.col("latest") - F.col("end")) * 1000).alias("skew_ms"), F.coalesce("cells", none).alias("cells"))
    return _windows(every, rate, seconds, most_missing, most_skew_ms)


STATE = "sensors array<string>, sizes array<int>, ts array<double>, value array<double>, earliest array<double>, latest array<double>, emitted double"


def stream_latest_windows(samples: DataFrame, rate: float, seconds: float, sensors: int, stride: float = 0.0, most_missing: float = 0.02, most_skew_ms: float = 50.0) -> DataFrame:
    """latest_windows() of a stream, as they come: a window each time that the common end has moved on by the stride at least.

    A group's state is what may still be part of a window: per sensor the samples behind the common end less `seconds`.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        spans: dict[str, tuple[float, float]] = {}
        emitted = -np.inf
        if state.exists:
            names, sizes, ts, value, earliest, latest, emitted = state.get
            at = np.append(0, np.cumsum(sizes)).astype(int)
            for k, s in enumerate(names):
                held[s] = [(np.array(ts[at[k] : at[k + 1]], float), np.array(value[at[k] : at[k + 1]], float))]
                spans[s] = (earliest[k], latest[k])
        for f in frames:
            for s, part in f.dropna(subset=["ts"]).groupby("sensor"):
                t = part["ts"].to_numpy(float)
                held.setdefault(s, []).append((t, part["value"].to_numpy(float)))
                low, high = spans.get(s, (np.inf, -np.inf))
                spans[s] = (min(low, t.min()), max(high, t.max()))
        out = []
        end = min((high for _, high in spans.values()), default=-np.inf)
        start = end - seconds
        joined = {s: tuple(map(np.concatenate, zip(*parts, strict=True))) for s, parts in held.items()}
        if len(spans) >= sensors and end - max(low for low, _ in spans.values()) >= seconds and end > emitted and end - emitted >= stride:
            emitted = end
            for s, (t, v) in joined.items():
                some = (t >= start) & (t < end)
                t, v = t[some], v[some]
                order = np.lexsort((np.where(np.isnan(v), -np.inf, v), t))
                k = np.rint((t[order] - start) * rate).astype(int)
                x = np.full(round(rate * seconds), np.nan)
                x[k[k < len(x)]] = v[order][k < len(x)]
                there = np.flatnonzero(~np.isnan(x))
                out.append((key[0], s, start, (spans[s][1] - end) * 1000, there.tolist(), x[there].tolist()))
        for s, (t, v) in joined.items():
            keep = t >= start
            joined[s] = (t[keep], v[keep])
        names = sorted(joined)
        flat = lambda c: [float(a) for s in names for a in joined[s][c]]
        state.update((names, [len(joined[s][0]) for s in names], flat(0), flat(1), [float(spans[s][0]) for s in names], [float(spans[s][1]) for s in names], float(emitted)))
        if out:
            yield pd.DataFrame(out, columns=["group", "sensor", "start", "skew_ms", "k", "value"])

    kind = dict(samples.dtypes)["group"]
    rows = samples.select("group", F.col("sensor").cast("string").alias("sensor"), F.col("ts").cast("double").alias("ts"), F.col("value").cast("double").alias("value"))
    found = rows.groupBy("group").applyInPandasWithState(run, f"group {kind}, sensor string, start double, skew_ms double, k array<bigint>, value array<double>", STATE, "append", GroupStateTimeout.NoTimeout)
    return _windows(found.withColumn("cells", F.arrays_zip("k", "value")).drop("k", "value"), rate, seconds, most_missing, most_skew_ms)


def rounded(c: Column) -> Column:
    """The nearest whole number, ties to the even one."""
    return F.rint(c).cast("int")


def finalized_captures(captures: DataFrame, seconds: float) -> DataFrame:
    """The last `seconds` of every board of a capture before the end that all have, and how they were aligned.

    captures: capture, slot, rate, x (samples up to the board's end), ends (seconds; null: unknown), monotonic, mode, completed
    (when the capture was over). Boards are aligned if all ends are known, all clocks are monotonic, all modes are of
    ALIGNED_MODES and all have enough samples left; else each board's own tail is taken and its clock counts as unsound. x is null,
    and short true, where a board has less than `seconds` of samples. Adds start, finish (of the window), trim_s, skew_ms (what
    rounding to samples has left), alignment and sound.
    """
    whole = Window.partitionBy("capture")
    known = F.coalesce(F.col("ends").isNotNull() & F.col("monotonic") & F.col("mode").isin(*ALIGNED_MODES), F.lit(False))
    c = captures.withColumn("known", F.bool_and(known).over(whole)).withColumn("common", F.min("ends").over(whole))
    c = c.withColumn("shift", F.when(F.col("known"), F.greatest(F.lit(0.0), F.col("ends") - F.col("common"))).otherwise(0.0)).withColumn("count", rounded(F.col("rate") * seconds))
    left = F.coalesce(F.size("x") - rounded(F.col("shift") * F.col("rate")) >= F.col("count"), F.lit(False))
    c = c.withColumn("aligned", F.col("known") & F.bool_and(left).over(whole))
    c = c.withColumn("cut", F.when(F.col("aligned"), rounded(F.col("shift") * F.col("rate"))).otherwise(0))
    first = F.size("x") - F.col("cut") - F.col("count")
    finish = F.when(F.col("aligned"), F.col("common")).otherwise(F.col("completed"))
    return c.select(
        "capture", "slot", "rate", F.when(first >= 0, F.slice("x", first + 1, F.col("count"))).alias("x"), F.coalesce(first < 0, F.lit(True)).alias("short"), (finish - seconds).alias("start"), finish.alias("finish"),
        F.when(F.col("aligned"), F.col("shift")).alias("trim_s"), F.when(F.col("aligned"), (F.col("shift") - F.col("cut") / F.col("rate")) * 1000).alias("skew_ms"),
        F.when(F.col("aligned"), "common_end").otherwise("own_tail").alias("alignment"), (F.col("aligned") & F.coalesce("monotonic", F.lit(False))).alias("sound"),
    )


def reference_clock(boards: DataFrame, keys: list[str], axes: list[str], seconds: float) -> DataFrame:
    """keys and the axes of every board on the reference board's clock (columns rate and reference_rate; see resampling.on_reference_clock).

    Axes are arrays of one length; a row whose axes are null, of different lengths or too short has null axes.
    """
    kinds = dict(boards.dtypes)

    def run(batches):
        for b in batches:
            columns = [b.column(len(keys) + 2 + a) for a in range(len(axes))]
            out: list[list] = [[] for _ in axes]
            for k in range(b.num_rows):
                fs, to = b.column(len(keys))[k].as_py(), b.column(len(keys) + 1)[k].as_py()
                x = [c[k].values.to_numpy(zero_copy_only=False).astype(np.float64) if c[k].is_valid else np.zeros(0) for c in columns]
                made: list = [None] * len(axes)
                if fs and to and len({len(v) for v in x}) == 1 and len(x[0]) >= max(2, round(seconds * fs)) and round(seconds * to) >= 2:
                    made = list(resampling.on_reference_clock(np.stack(x), fs, to, seconds))
                for a, v in enumerate(made):
                    out[a].append(None if v is None else pa.array(v, from_pandas=True).to_pylist() if np.isnan(v).any() else v)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), *(pa.array(v, pa.list_(pa.float64())) for v in out)], names=[*keys, *axes])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", `{a}` array<double>" for a in axes)
    return boards.select(*keys, F.col("rate").cast("double"), F.col("reference_rate").cast("double"), *(F.col(a).cast("array<double>").alias(a) for a in axes)).mapInArrow(run, schema)
