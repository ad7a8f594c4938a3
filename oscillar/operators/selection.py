"""Selecting rows: window cuts, tags, fallbacks, stores of events, feeds that repeat each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_samples(samples: DataFrame, seconds: float, rate: float, enough: float = 0.9) -> DataFrame:
    """sensor, n, mode, first, last, mean of each sensor's latest window: by time if it holds enough of the expected samples, else its last ones by number.

    By number the times are rebuilt from the last one and the rate. Rows without a finite, non-negative time are left out.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    expected = round(seconds * rate)
    s = valid_times(samples.withColumn("at", at), "at")
    told = [F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.avg("value").alias("mean")]
    timed = s.join(s.groupBy("sensor").agg(F.max("at").alias("end")), "sensor").filter(F.col("at") > F.col("end") - seconds)
    by_time = timed.groupBy("sensor").agg(*told).filter(F.col("n") >= enough * expected)
    others = s.join(by_time.select("sensor"), "sensor", "left_anti")
    back = F.row_number().over(Window.partitionBy("sensor").orderBy(F.col("at").desc(), F.col("event_id").desc()))
    counted = others.withColumn("back", back).filter(F.col("back") <= expected).groupBy("sensor").agg(*told)  # each task keeps so many of a sensor at most
    counted = counted.withColumn("first", F.col("last") - (F.col("n") - 1) / rate)
    columns = lambda df, mode: df.select("sensor", "n", F.lit(mode).alias("mode"), "first", "last", "mean")
    return columns(by_time, "timestamps").unionByName(columns(counted, "sample_count"))


def valid_times(samples: DataFrame, at: str, most: float = 1e11) -> DataFrame:
    """Rows whose time in seconds is finite, not negative and at most `most`."""
    t = F.col(at)
    return samples.filter(t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t <= most))


def between(samples: DataFrame, at: str, low, high) -> DataFrame:
    """Rows of the half-open interval [low, high)."""
    return samples.filter((F.col(at) >= low) & (F.col(at) < high))


def thinned(windows: DataFrame, most: int) -> DataFrame:
    """n, stride, preview and low, high, mean, rms of arrays x: every stride-th sample, `most` at most."""
    n = F.size("x")
    stride = F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    x = F.transform("x", lambda v: v.cast("double"))
    kept = F.filter("x", lambda v, k: k % F.greatest(F.lit(1), F.ceil(F.size("x") / most)).cast("int") == 0)
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    return windows.withColumns({"n": n, "stride": stride, "preview": kept, "low": F.array_min(x), "high": F.array_max(x), "mean": total(lambda v: v) / n, "rms": F.sqrt(total(lambda v: v * v) / n)})


def identical_feeds(windows: DataFrame) -> DataFrame:
    """win, sensors of windows whose samples (x) are the same to the last bit for two sensors or more."""
    same = windows.groupBy("win", F.sha2(F.to_json("x"), 256).alias("print_")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("sensor")), ",").alias("sensors"))
    return same.filter("n > 1").select("win", "sensors")


def resolved(asked: DataFrame, aliases: DataFrame, known: DataFrame, baseline: str | None = None) -> DataFrame:
    """asked (place, name) → place, sensor: aliases resolved, the first of repeated ones kept, unknown ones fail, the baseline first."""
    a = aliases.select(F.col("alias").alias("name"), F.col("sensor").alias("target_"))
    r = asked.join(a, "name", "left").withColumn("sensor", F.coalesce("target_", "name")).join(known.select("sensor", F.lit(True).alias("known_")), "sensor", "left")
    sensor = F.when(F.col("known_"), F.col("sensor")).otherwise(F.raise_error(F.concat(F.lit("unknown sensor "), F.col("name"))))
    first = r.select("place", sensor.alias("sensor")).groupBy("sensor").agg(F.min("place").alias("place"))
    return first.select(F.when(F.col("sensor") == F.lit(baseline), F.lit(-1)).otherwise(F.col("place")).cast("long").alias("place"), "sensor")


def with_defaults(rows: DataFrame, given: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the columns of defaults from given (a row a key), or their default."""
    own = given.select(key, *(F.col(c).alias(f"own_{c}") for c in defaults))
    return rows.join(own, key, "left").select(*rows.columns, *(F.coalesce(F.col(f"own_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()))


def tag_columns(samples: DataFrame, tags: DataFrame, labels: list[str], at: str, step: int = 3600) -> DataFrame:
    """samples (with id) and a boolean column for every label: whether an interval (label, low, high) of it holds the sample. Both sides meet in grid cells of `step` seconds."""
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / step)
    t = tags.select("label", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell_"))
    hit = samples.withColumn("cell_", cell(at)).join(t, "cell_").filter((F.col(at) >= F.col("low")) & (F.col(at) <= F.col("high")))
    marks = hit.groupBy("id").agg(*(F.bool_or(F.col("label") == name).alias(f"tag_{name}") for name in labels))
    return samples.join(marks, "id", "left").select(*samples.columns, *(F.coalesce(f"tag_{name}", F.lit(False)).alias(f"tag_{name}") for name in labels))


def inserted(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with the new rows whose key it lacks; of new rows of one key the first by all columns is taken."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in store.columns if c != key])).alias("r_"))
    rows = first.select(key, "r_.*").select(*store.columns)
    return store.unionByName(rows.join(store.select(key), key, "left_anti"))


def newest(rows: DataFrame, order: str, n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows (1 to 10000) that fulfil a condition, newest first: a top-k report."""
    kept = rows if where is None else rows.filter(where)
    return kept.orderBy(F.col(order).desc()).limit(min(max(int(n), 1), 10_000))


def latest_row(rows: DataFrame, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != order]
    top = rows.agg(F.max(F.struct(order, *others)).alias("t"))
    return top.select(*(F.col(f"t.{c}").alias(c) for c in rows.columns))


def compacted(history: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The newest `most` rows of each key: what a rolling history keeps."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))
    return history.withColumn("turn_", turn).filter(F.col("turn_") <= most).drop("turn_")


#: names of a time column, as column_key() gives them.
TIME_KEYS = ("t", "time", "times", "timestamp", "timestamps")


def column_key(name: str) -> str:
    """Lower-case letters and digits of a column's name."""
    return "".join(c for c in name.strip().lower() if c.isalnum())


def layout_of(columns: list[str]) -> tuple[str | None, dict[str, str]]:
    """The time column, if there is one, and the value columns by their keys; no keys where two are the same."""
    time = next((c for c in columns if column_key(c) in TIME_KEYS), None)
    values = [c for c in columns if c != time]
    keys = {column_key(c): c for c in values}
    return time, keys if len(keys) == len(values) else {}


def reordered(frame: DataFrame, expected: list[str]) -> DataFrame:
    """The value columns of a frame in the order and under the names that are expected; another layout is an error."""
    keys = layout_of(frame.columns)[1]
    wanted = [column_key(c) for c in expected]
    if set(keys) != set(wanted):
        raise ValueError(f"the columns are {sorted(keys)}, not {sorted(wanted)}")
    return frame.select(*(F.col(f"`{keys[k]}`").alias(name) for k, name in zip(wanted, expected, strict=True)))


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """at and the value columns of the first usable frame, with the rows of all frames that have the same columns in any order and spelling.

    Frames without values, of another layout or with two columns of one key are passed over. Rows with a value that is no
    finite number, or a negative or unsound time, are left out; at is null where any frame that is used has no time column.
    Only column names decide, so no data are read for it.
    """
    used, names = [], None
    for frame in frames:
        time, keys = layout_of(frame.columns)
        if keys and (names is None or set(keys) == {column_key(n) for n in names}):
            names = names or list(keys.values())
            used.append((frame, time, keys))
    if not used:
        raise ValueError("no frame has values")
    timed = all(time for _, time, _ in used)
    out = None
    for frame, time, keys in used:
        at = F.col(f"`{time}`").cast("double") if time else F.lit(None).cast("double")
        part = frame.select(at.alias("at"), *(F.col(f"`{keys[column_key(n)]}`").cast("double").alias(n) for n in names))
        sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf"))
        for n in names:
            part = part.filter(sound(f"`{n}`"))
        part = part.filter(sound("at") & (F.col("at") >= 0)) if time else part
        out = part if out is None else out.unionByName(part)
    return out if timed else out.withColumn("at", F.lit(None).cast("double"))


def axis_of(columns: list[str], axis: str) -> Column:
    """An axis of named value columns: x, y, z or a place among them; norm is that of x, y and z, or of all columns where these are not all there."""
    last = {column_key(c)[-1:]: c for c in columns}
    at = lambda c: F.col(f"`{c}`")
    if axis == "norm":
        held = [last[k] for k in "xyz"] if all(k in last for k in "xyz") else columns
        return F.sqrt(sum((at(c) * at(c) for c in held[1:]), at(held[0]) * at(held[0])))
    if axis in last and axis in "xyz":
        return at(last[axis])
    if axis.isdigit() and int(axis) < len(columns):
        return at(columns[int(axis)])
    raise ValueError(f"no axis {axis!r} among {columns}")
