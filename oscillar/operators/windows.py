"""Statistics, quality and comparison of sample windows kept as rows: sensor, win, ts, value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_windows(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """sensor, win, event_id, ts, value: the event stream cut into fixed windows."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_type").alias("sensor"), F.floor(at / seconds).cast("long").alias("win"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def window_features(samples: DataFrame) -> DataFrame:
    """Time-domain features of each window, on values with the window's mean removed; one shuffle by window."""
    whole, run = Window.partitionBy("sensor", "win"), Window.partitionBy("sensor", "win").orderBy("ts", "event_id")
    c = samples.withColumn("c", F.col("value") - F.avg("value").over(whole))
    c = c.withColumn("crossed", ((F.col("c") >= 0) != (F.lag("c").over(run) >= 0)).cast("int"))
    x = F.col("c")
    agg = c.groupBy("sensor", "win").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        ((F.max(F.expr("unix_micros(ts)")) - F.min(F.expr("unix_micros(ts)"))) / 1e6).alias("duration"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(x * x * x).alias("m3"),
        F.avg(x * x * x * x).alias("m4"),
        F.avg(F.abs(x)).alias("mean_abs"),
        F.max(F.abs(x)).alias("peak"),
        (F.max(x) - F.min(x)).alias("ptp"),
        F.sum(x * x).alias("energy"),
        F.coalesce(F.sum("crossed"), F.lit(0)).alias("crossings"),
    )
    rms = F.col("rms")
    safe = lambda v, by: F.when(by > 0, v / by).otherwise(F.lit(0.0))
    return agg.select(
        "sensor", "win", "n", "duration", "mean", "std", (F.col("std") * F.col("std")).alias("var"), "rms", "peak", "ptp", "energy", safe(F.col("m3"), rms * rms * rms).alias("skew"), safe(F.col("m4"), rms * rms * rms * rms).alias("kurtosis"),
        safe(F.col("peak"), rms).alias("crest"), safe(F.col("peak"), F.col("mean_abs")).alias("impulse"), safe(rms, F.col("mean_abs")).alias("shape"), safe(F.col("crossings"), F.col("n") - 1).alias("zcr"),
    )


def window_quality(samples: DataFrame, least: int = 32, clip: float = 500.0, expected: int = 0, flat: float = 1e-7) -> DataFrame:
    """n, valid, missing and clipped fraction, monotonic, gaps (over 1.5 median steps), rate, usable, flags and notes of each window.

    expected: samples of a whole window; under three quarters of them (64 or more expected) the window is short. One pass: a
    window's steps are an array of the window's row.
    """
    run = Window.partitionBy("sensor", "win").orderBy("event_id")
    s = samples.withColumn("dt", F.expr("unix_micros(ts)") / 1e6 - F.lag(F.expr("unix_micros(ts)") / 1e6).over(run))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    per = s.groupBy("sensor", "win").agg(
        F.count(F.lit(1)).alias("n"), F.avg(finite.cast("int")).alias("valid"), F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.avg((F.abs("value") >= clip).cast("int")).alias("clipped"),
        F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(True)).alias("monotonic"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("ptp"),
        F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("step"), F.collect_list("dt").alias("steps"),
    )
    gaps = F.coalesce(F.size(F.filter("steps", lambda d: d > 1.5 * F.col("step"))), F.lit(0)).cast("long")
    flags = [F.when(F.col("n") < least, "insufficient_samples"), F.when((F.lit(expected) >= 64) & (F.col("n") < int(expected * 0.75)), "short_window"), F.when(F.col("std") < 1e-10, "flatline"), F.when(F.col("valid") < 1, "non_finite_values")]
    notes = [F.when(F.col("clipped") >= 0.01, "clipping"), F.when(~F.col("monotonic"), "timestamps_not_increasing"), F.when(gaps > 0, "gaps"), F.when(F.col("ptp") <= flat, "flatline")]
    usable = (F.col("valid") >= 0.98) & F.col("monotonic") & (F.col("clipped") < 0.01) & (F.col("n") > 0)
    joined = lambda parts: F.array_join(F.array_compact(F.array(*parts)), ",")
    return per.select("sensor", "win", "n", "valid", "missing", "clipped", "monotonic", gaps.alias("gaps"), (1 / F.col("step")).alias("rate"), usable.alias("usable"), joined(flags).alias("flags"), joined(notes).alias("notes"))


def window_arrays(samples: DataFrame, by: tuple[str, ...] = ("sensor", "win")) -> DataFrame:
    """The finite samples of each window as an array x in order of time, their number n and that of the others, left_out."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    x = F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("ts", "event_id", "value")))), lambda s: s["value"])
    return samples.groupBy(*by).agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("left_out"), x.alias("x"))


# Labels of a sensor and of the network, with their confidences and the order of severity.
SENSOR_LABELS = {
    "insufficient_data": 0.96,
    "possible_sensor_issue": 0.9,
    "impulsive_or_shock_event": 0.88,
    "significant_local_deviation": 0.86,
    "mild_deviation": 0.74,
    "normal_relative_to_baseline": 0.82,
}
NETWORK_LABELS = {
    "insufficient_data": 0.98,
    "sensor_network_quality_issue": 0.9,
    "normal_relative_to_reference_sensor": 0.84,
    "multi_sensor_structure_wide_vibration_event": 0.84,
    "mild_multi_sensor_deviation": 0.76,
    "localized_vibration_deviation": 0.82,
    "mild_local_deviation": 0.72,
}
SEVERITY = ("normal_relative_to_baseline", "insufficient_data", "possible_sensor_issue", "mild_deviation", "significant_local_deviation", "impulsive_or_shock_event")
QUALITY_LABELS = ("insufficient_data", "possible_sensor_issue")


def bounded_ratio(a: Column, b: Column) -> Column:
    """a / b; null without a reference that is clearly not zero."""
    return F.when(F.abs(b) > 1e-12, a / b)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def compare_to_reference(metrics: DataFrame, reference: str, by: tuple[str, ...] = ("win",)) -> DataFrame:
    """Each target window's metrics with those of the reference sensor's window of the same time: ratios, deltas and the distance of their band powers.

    The sensors of a time meet in one partition, so the metrics are worked out once and shuffled once.

    Ratios are null without a reference; a band that one side lacks counts as 0.
    """
    kept = ["rms", "peak", "ptp", "ppv", "dominant_hz", "kurtosis", "crest", "bands", "flags"]
    own = F.when(F.col("sensor") == reference, F.struct(*kept))
    both = metrics.withColumn("ref_", F.first(own, ignorenulls=True).over(Window.partitionBy(*by))).filter(F.col("sensor") != reference)
    both = both.select("*", *(F.col(f"ref_.{c}").alias(f"ref_{c}") for c in kept), F.col("ref_").isNotNull().alias("has_reference"))
    ratio = lambda c: bounded_ratio(F.col(c), F.col(f"ref_{c}")).alias(f"{c}_ratio")
    delta = lambda c: (F.col(c) - F.col(f"ref_{c}")).alias(f"{c}_delta")
    empty = F.create_map().cast("map<string,double>")
    apart = F.map_zip_with(F.coalesce("bands", empty), F.coalesce("ref_bands", empty), lambda _, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    distance = F.sqrt(F.aggregate(F.map_values(apart), F.lit(0.0), lambda t, d: t + d * d))
    reference_flags = F.when(F.col("has_reference"), F.col("ref_flags")).otherwise("missing_data")
    return both.select(
        *by, "sensor", "n", "kurtosis", "crest", *(ratio(c) for c in ("rms", "peak", "ptp", "ppv")), *(delta(c) for c in ("rms", "peak", "dominant_hz", "kurtosis", "crest")),
        distance.alias("spectral_distance"), "flags", reference_flags.alias("reference_flags"),
    )


def reference_levels(metrics: DataFrame, compared: DataFrame, look_back: int = 0) -> DataFrame:
    """win, ref_rms, from_win: the reference sensor's own level, recovered from the first sensor whose rms and ratio to it are usable.

    A window without a usable report takes the level of the last window before it, `look_back` windows at most; else it is null.
    Windows meet in groups of look_back + 1, a group and the one before it, so no history is one task's work.
    """
    usable = F.col("rms").isNotNull() & ~F.isnan("rms") & (F.col("rms_ratio") > 1e-9)
    both = compared.select("win", "sensor", "rms_ratio").join(metrics.select("win", "sensor", "rms"), ["win", "sensor"], "left")
    own = both.groupBy("win").agg(F.min(F.when(usable, F.struct("sensor", F.round(F.col("rms") / F.col("rms_ratio"), 6).alias("level")))).alias("report"))
    own = own.select("win", F.col("report.level").alias("level"))
    step = look_back + 1
    near = own.withColumn("at_", F.floor(F.col("win") / step)).withColumn("group_", F.explode(F.array("at_", F.col("at_") + 1)))
    last = F.last(F.when(F.col("level").isNotNull(), F.struct("level", F.col("win").alias("of"))), ignorenulls=True).over(Window.partitionBy("group_").orderBy("win").rangeBetween(-look_back, 0))
    told = near.withColumn("last_", last).filter("group_ = at_")
    return told.select("win", F.col("last_.level").alias("ref_rms"), F.col("last_.of").alias("from_win"))


# Bounds and units of the quality vector.
SKEW_MS, RATE_HZ, WIDEBAND_HZ = 100.0, 26_700.0, 6000.0


def quality_vector(valid: Column, missing: Column, clipped: Column, monotonic: Column, skew_ms: Column, axes: Column, usable_hz: Column, lost: Column, rate: Column, known: tuple[Column, Column], phase: Column, calibrated: Column) -> Column:
    """The 13 quality figures of a board: shares, flags and scaled values.

    axes: how many of three are there; known: the two flags of its geometry; lost packets and rates are scaled and bounded.
    """
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    most = lambda c, high: F.least(c, F.lit(high))
    return F.array(
        valid, missing, clipped, flag(monotonic), most(F.abs(skew_ms) / SKEW_MS, 10.0), axes / F.lit(3.0), most(F.coalesce(usable_hz, F.lit(0.0)) / WIDEBAND_HZ, 1.0), most(F.log1p(lost) / 10, 10.0), most(rate / RATE_HZ, 4.0),
        *map(flag, known), flag(phase), flag(calibrated),
    )


def sensor_label(c: DataFrame) -> tuple[Column, Column]:
    """Label and confidence by the sensor's ladder of rules; missing ratios count as 1, missing shape figures and distances as 0."""
    or_one, or_zero = (lambda x: F.coalesce(c[x], F.lit(1.0))), (lambda x: F.coalesce(c[x], F.lit(0.0)))
    lacking = F.concat_ws(",", c["flags"], c["reference_flags"])
    highest = F.greatest(or_one("rms_ratio"), or_one("peak_ratio"), or_one("ppv_ratio"))
    rules = [
        (lacking.rlike("missing_data|insufficient_samples"), "insufficient_data"),
        (F.length(F.replace(lacking, F.lit(","), F.lit(""))) > 0, "possible_sensor_issue"),
        ((or_zero("kurtosis") >= 8) | (or_zero("crest") >= 7) | (or_one("peak_ratio") >= 5), "impulsive_or_shock_event"),
        ((highest >= 3) | (or_zero("spectral_distance") >= 0.65), "significant_local_deviation"),
        ((highest >= 1.5) | (or_zero("spectral_distance") >= 0.35), "mild_deviation"),
    ]
    label = F.lit("normal_relative_to_baseline")
    for when, name in reversed(rules):
        label = F.when(when, name).otherwise(label)
    return label, F.element_at(F.create_map(*(F.lit(x) for kv in SENSOR_LABELS.items() for x in kv)), label)


def severity(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), label).cast("int") - 1


def network_labels(reports: DataFrame, by: tuple[str, ...] = ("win",)) -> DataFrame:
    """Per window: sensors, affected, significant, label, confidence, affected_sensors, worst_sensor and worst_label, in one aggregation of the sensors' labels."""
    strong = F.col("label").isin("significant_local_deviation", "impulsive_or_shock_event")
    hit, poor = strong | (F.col("label") == "mild_deviation"), F.col("label").isin(*QUALITY_LABELS)
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("sensor")))), ",")
    per = reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sensors"), F.count_if(hit).alias("affected"), F.count_if(strong).alias("significant"), F.count_if(poor).alias("poor"), names(hit).alias("hit"), names(poor).alias("bad"),
        F.max(F.struct(severity(F.col("label")).alias("s"), "sensor", "label")).alias("worst"),
    )
    wide = F.greatest(F.lit(2), F.ceil(0.6 * F.col("sensors")))
    label = (
        F.when(F.col("poor") > 0, "sensor_network_quality_issue").when(F.col("affected") == 0, "normal_relative_to_reference_sensor")
        .when((F.col("significant") >= 2) | (F.col("affected") >= wide), "multi_sensor_structure_wide_vibration_event").when((F.col("affected") > 1) & (F.col("significant") == 0), "mild_multi_sensor_deviation")
        .when(F.col("significant") > 0, "localized_vibration_deviation").otherwise("mild_local_deviation")
    )
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in NETWORK_LABELS.items() for x in kv)), label)
    return per.select(
        *by, "sensors", "affected", "significant", label.alias("label"), sure.alias("confidence"), F.when(F.col("poor") > 0, F.col("bad")).otherwise(F.col("hit")).alias("affected_sensors"),
        F.col("worst.sensor").alias("worst_sensor"), F.col("worst.label").alias("worst_label"),
    )


def combined_axes(labels: DataFrame) -> DataFrame:
    """win, sensor, label, axes: the worst label of a sensor over the axes that were checked, and the axes that show it."""
    rank = severity(F.col("label"))
    worst = labels.groupBy("win", "sensor").agg(F.max(F.struct(rank.alias("s"), "label")).alias("w"), F.array_sort(F.collect_set(F.struct(rank.alias("s"), "axis"))).alias("all"))
    axes = F.transform(F.filter("all", lambda a: a["s"] == F.col("w.s")), lambda a: a["axis"])
    return worst.select("win", "sensor", F.col("w.label").alias("label"), F.array_join(axes, ",").alias("axes"))


def history_scores(features: DataFrame, history: DataFrame, metric: str = "rms", least: int = 5, cells: int = 64) -> DataFrame:
    """Percentile and multiple of the median of each window's metric within its sensor's history; null while it is learnt.

    The history is counted per distinct value. Values of a sensor lie in cells between its approximate quantiles: cells are
    summed first, then counts run within a cell, so that neither a sensor's history nor its windows are one task's work.
    """
    h = history.groupBy("sensor", F.col(metric).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    middle = history.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.percentile(metric, 0.5).alias("median"), F.percentile_approx(metric, [k / cells for k in range(1, cells)]).alias("cuts"))
    both = h.select("sensor", "v", "k", F.lit(None).cast("long").alias("win")).unionByName(features.select("sensor", F.col(metric).alias("v"), F.lit(0).cast("long").alias("k"), "win"))
    both = both.join(middle, "sensor", "left")
    both = both.withColumn("cell", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("v"))), F.lit(0))).drop("cuts")
    run = lambda *by: Window.partitionBy("sensor", *by)
    before = both.groupBy("sensor", "cell").agg(F.sum("k").alias("held"))
    before = before.select("sensor", "cell", (F.sum("held").over(run().orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    inside = F.sum("k").over(run("cell").orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("inside", inside).filter("win IS NOT NULL").join(before, ["sensor", "cell"])
    known = F.col("n") >= least
    percentile = 100 * (F.col("before") + F.col("inside")) / F.col("n")
    times = F.when(F.col("median") > 1e-9, F.col("v") / F.col("median"))
    return out.select("sensor", "win", F.when(known, F.round(percentile, 2)).alias("percentile"), F.when(known, F.round(times, 2)).alias("x_median"))


def history_context(features: DataFrame, labels: DataFrame, metrics: tuple[str, ...] = ("rms", "peak", "crest"), least: int = 5) -> DataFrame:
    """sensor, win, metric, percentile, x_median, n_history: the rarest metric of each window within its sensor's normal windows.

    Normal windows are those that the ladder calls normal and no quality flag marks. Rarity is the greater of percentile and
    its complement; ties go to the multiple of the median furthest from 1, then to the metric's name. n_history tells a
    sensor that is still learning (fewer than `least`): its percentile and multiple are null.
    """
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics)))
    rows = features.select("sensor", "win", long.alias("m")).select("sensor", "win", "m.metric", "m.v")
    normal = labels.filter("label = 'normal_relative_to_baseline'").select("sensor", "win").distinct()
    history = rows.join(normal, ["sensor", "win"], "left_semi")
    key = F.struct("sensor", "metric").alias("sensor")
    scores = history_scores(rows.select(key, "win", F.col("v").alias("rms")), history.select(key, F.col("v").alias("rms")), "rms", least)
    counts = normal.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_history"))
    scores = scores.select("sensor.sensor", "sensor.metric", "win", "percentile", "x_median")
    rarity = F.greatest(F.col("percentile"), 100 - F.col("percentile"))
    order = F.struct(F.coalesce(rarity, F.lit(-1.0)), F.coalesce(F.abs(F.col("x_median") - 1), F.lit(-1.0)), F.col("metric"), "percentile", "x_median")
    top = scores.groupBy("sensor", "win").agg(F.max(order).alias("t"))
    top = top.join(counts, "sensor", "left")
    return top.select("sensor", "win", "t.metric", "t.percentile", "t.x_median", F.coalesce("n_history", F.lit(0)).cast("long").alias("n_history"))


def block_rms(samples: DataFrame, size: int = 16) -> DataFrame:
    """Per window: blocks, median block RMS, scaled MAD, largest block and its robust score. A window's blocks are an array of its row."""
    run = Window.partitionBy("sensor", "win").orderBy("ts", "event_id")
    b = samples.withColumn("block", F.floor((F.row_number().over(run) - 1) / size)).groupBy("sensor", "win", "block").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    out = b.groupBy("sensor", "win").agg(F.count(F.lit(1)).alias("blocks"), F.percentile("rms", 0.5).alias("median"), F.max("rms").alias("largest"), F.collect_list("rms").alias("all"))
    scale = 1.4826 * median_of(F.transform("all", lambda r: F.abs(r - F.col("median"))))
    out = out.select("sensor", "win", "blocks", "median", "largest", scale.alias("scale"))
    return out.withColumn("z", (F.col("largest") - F.col("median")) / F.greatest(F.col("scale"), 0.05 * F.col("median"), F.lit(1e-300)))


def median_of(array: Column) -> Column:
    """The median of an array, between the middle two of an even number; null if it is empty."""
    s = F.array_sort(array)
    n = F.size(array)
    at = lambda k: F.element_at(s, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def envelope(samples: DataFrame, buckets: int = 10) -> DataFrame:
    """Per window and bucket of its samples, in order: n, min, max, mean. Bucket b holds the samples from floor(b * n / buckets) up to the next edge."""
    run = Window.partitionBy("sensor", "win").orderBy("ts", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("sensor", "win"))
    at = F.ceil((F.row_number().over(run)) * buckets / n) - 1
    return samples.withColumn("bucket", at.cast("int")).groupBy("sensor", "win", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def detrended(samples: DataFrame) -> DataFrame:
    """Per window: slope, intercept over time in seconds and RMS of what a straight line leaves of its valid samples, in one aggregation."""
    t, v = F.expr("unix_micros(ts)") / 1e6 - F.col("win") * 86_400, F.col("value")
    ok = samples.filter(v.isNotNull() & ~F.isnan(v)).withColumn("t", t)
    fit = ok.groupBy("sensor", "win").agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.var_pop("value").alias("var"), F.covar_pop("value", "t").alias("cov"))
    return fit.select("sensor", "win", "slope", "intercept", F.sqrt(F.greatest(F.col("var") - F.coalesce("slope", F.lit(0.0)) * F.col("cov"), F.lit(0.0))).alias("residual_rms"))


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, payload: list[str], cell_seconds: int = 86_400) -> DataFrame:
    """Each left row with the nearest right row of its key (ties: the earlier).

    Time is cut into cells. A window within a cell looks back, and one in the reverse order looks ahead, so each is linear;
    what lies beyond the cell is the last right row of an earlier cell or the first of a later one, from one row for each
    cell. No key's history is one task's work.
    """
    kind = F.struct(F.col(right_ts).alias("at"), *payload)
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (cell_seconds * 1e6)).cast("long")
    marks = right.select(*by, cell(right_ts).alias("cell_"), kind.alias("m_"), F.col(right_ts).alias("t_"), F.lit(0).alias("s_"))
    asks = left.withColumns({"cell_": cell(left_ts), "t_": F.col(left_ts), "s_": F.lit(1)})
    both = asks.unionByName(marks, allowMissingColumns=True)
    near = Window.partitionBy(*by, "cell_")
    upto = near.orderBy("t_", "s_").rowsBetween(Window.unboundedPreceding, 0)
    back = near.orderBy(F.col("t_").desc(), F.col("s_").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"b_": F.last("m_", ignorenulls=True).over(upto), "a_": F.last("m_", ignorenulls=True).over(back)})
    edges = marks.groupBy(*by, "cell_").agg(F.min("m_").alias("first_"), F.max("m_").alias("last_"))
    cells = asks.select(*by, "cell_").distinct().join(edges, [*by, "cell_"], "full")
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = key.orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    after = key.orderBy(F.col("cell_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "cell_", F.last("last_", ignorenulls=True).over(before).alias("pb_"), F.last("first_", ignorenulls=True).over(after).alias("pa_"))
    found = both.filter("s_ = 1").join(cells, [*by, "cell_"], "left").withColumns({"b_": F.coalesce("b_", "pb_"), "a_": F.coalesce("a_", "pa_")})
    gap = lambda c: F.abs(F.col("t_").cast("double") - F.col(f"{c}.at").cast("double"))
    pick = F.when(F.col("a_").isNull() | (gap("b_") <= gap("a_")), F.col("b_")).otherwise(F.col("a_"))
    return found.withColumn("m_", pick).select(*left.columns, F.col("m_.at").alias("matched_ts"), *(F.col(f"m_.{c}").alias(f"matched_{c}") for c in payload))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, payload: list[str], cell_seconds: int = 86_400) -> DataFrame:
    """Each left row with the first right row of its key at or after it, else null (pairs start tags with their end tags).

    A window looks ahead within a cell of time; beyond the cell, it is the first right row of a later one, as in asof_nearest().
    """
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (cell_seconds * 1e6)).cast("long")
    marks = right.select(*by, cell(right_ts).alias("cell_"), F.struct(F.col(right_ts).alias("at"), *payload).alias("m_"), F.col(right_ts).alias("t_"), F.lit(1).alias("s_"))
    asks = left.withColumns({"cell_": cell(left_ts), "t_": F.col(left_ts), "s_": F.lit(0)})
    back = Window.partitionBy(*by, "cell_").orderBy(F.col("t_").desc(), F.col("s_").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(marks, allowMissingColumns=True).withColumn("m_", F.last("m_", ignorenulls=True).over(back)).filter("s_ = 0")
    edges = marks.groupBy(*by, "cell_").agg(F.min("m_").alias("first_"))
    cells = asks.select(*by, "cell_").distinct().join(edges, [*by, "cell_"], "full")
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    after = key.orderBy(F.col("cell_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "cell_", F.last("first_", ignorenulls=True).over(after).alias("later_"))
    found = found.join(cells, [*by, "cell_"], "left").withColumn("m_", F.coalesce("m_", "later_"))
    return found.select(*left.columns, F.col("m_.at").alias("matched_ts"), *(F.col(f"m_.{c}").alias(f"matched_{c}") for c in payload))


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, step: int) -> DataFrame:
    """Points inside [low, high): both sides go to grid cells of `step` seconds and join on the cell; a span takes each of its cells."""
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / step)
    p = points.withColumn("cell_", cell(at))
    s = spans.withColumn("cell_", F.explode(F.sequence(cell(low), cell(high))))
    return p.join(s, "cell_").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("cell_")


class RangeFigures:
    """Count, sums, extremes and first values of ranges of the samples of a cell, from sums over halves, quarters ... of it.

    A range takes two parts of each level at most, so it costs the logarithm of the samples; no sum is the difference of larger
    ones. Nulls are left out of all but the count; a value that is no number counts as the largest, as in Spark.
    """

    def __init__(self, at: np.ndarray, values: pa.Array):
        known = values.is_valid().to_numpy(zero_copy_only=False)
        v = values.cast(pa.float64()).fill_null(0.0).to_numpy()
        order = np.lexsort((v, known, at))  # nulls stand first among samples of one time
        self.at, self.known, self.v = at[order], known[order], v[order]
        known, v = self.known, self.v
        self.held = np.append(0, np.cumsum(known))
        self.levels = []
        parts = [(np.where(known, v, 0.0), np.add, 0.0), (np.where(known, v * v, 0.0), np.add, 0.0), (np.where(known, v, np.nan), np.fmin, np.nan), (np.where(known, v, -np.inf), np.maximum, -np.inf)]
        self.kinds = [(join, none) for _, join, none in parts]
        level = [x for x, _, _ in parts]
        while True:
            self.levels.append(level)
            if len(level[0]) <= 1:
                break
            level = [join(np.append(x, none)[: len(x) + len(x) % 2][::2], np.append(x, none)[: len(x) + len(x) % 2][1::2]) for x, (join, none) in zip(level, self.kinds, strict=True)]

    def ranges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first sample in and the first behind each [low, high)."""
        lo = np.searchsorted(self.at, low, "left")
        return lo, np.maximum(lo, np.searchsorted(self.at, high, "left"))

    def figures(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Sum, sum of squares, least and greatest of each range."""
        out = [np.full(len(lo), none) for _, none in self.kinds]
        lo, hi = lo.copy(), hi.copy()
        for level in self.levels:
            left, right = np.flatnonzero((lo < hi) & (lo % 2 == 1)), np.flatnonzero((lo < hi) & (hi % 2 == 1))
            for x, got, (join, _) in zip(level, out, self.kinds, strict=True):
                got[left] = join(got[left], x[lo[left]])
            lo[left] += 1
            right = right[lo[right] < hi[right]]
            hi[right] -= 1
            for x, got, (join, _) in zip(level, out, self.kinds, strict=True):
                got[right] = join(got[right], x[hi[right]])
            lo, hi = lo // 2, hi // 2
        return out

    def heads(self, lo: np.ndarray, hi: np.ndarray, most: int) -> pa.Array:
        """The first values of each range, `most` at most."""
        n = np.minimum(hi - lo, most)
        ends = np.cumsum(n)
        place = np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(self.v[place], pa.float64(), mask=~self.known[place]))


def interval_figures(points: DataFrame, spans: DataFrame, key: str, step: float, head: int = 0) -> DataFrame:
    """id, n, total, squares, low, high, held, head of spans (key, id, low, high) that hold points (key, at, value) in [low, high).

    n counts all points and held those with a value; the other figures are of these, head the first values by at and value. at,
    low and high are numbers; points at no finite place lie in no span. Points and spans meet in cells of `step`, a span in each
    that it touches. A cell's points are held by one task, its spans pass by; the cost is that of sorting, however many pairs
    there are.
    """
    cell = lambda c: F.floor(c / step).cast("long")
    at, value, none = F.col("at").cast("double"), F.col("value").cast("double"), F.lit(None).cast("double")
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf"))
    kinds = dict(spans.dtypes)
    p = points.filter(finite & F.col(key).isNotNull()).select(F.col(key).alias("key"), cell(at).alias("cell"), F.lit(None).cast(kinds["id"]).alias("id"), at.alias("low"), none.alias("high"), value.alias("value"))
    asked = spans.select(F.col(key).alias("key"), "id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).filter("low < high")
    ends = p.groupBy("key").agg(F.min("low").alias("first_"), F.max("low").alias("last_"))  # a span has no cells beyond them
    asked = asked.join(ends, "key").filter("low <= last_ AND high > first_")
    cells = F.explode(F.sequence(cell(F.greatest("low", "first_")), cell(F.least("high", "last_"))))
    s = asked.select("key", cells.alias("cell"), "id", "low", "high", none.alias("value"))

    def run(batches):
        place, at, values, built = None, [], [], None
        for b in batches:
            cells, asks = b.column("cell").to_numpy(), b.column("id").is_valid().to_numpy(zero_copy_only=False)
            keys = b.column("key").dictionary_encode()
            codes, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            turns = np.flatnonzero((np.diff(cells) != 0) | (np.diff(codes) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                if (names[codes[lo]], cells[lo]) != place:
                    place, at, values, built = (names[codes[lo]], cells[lo]), [], [], None
                rows = b.slice(lo, hi - lo)
                if not asks[lo]:
                    at.append(rows.column("low").to_numpy())
                    values.append(rows.column("value"))
                elif at:
                    built = built or RangeFigures(np.concatenate(at), pa.concat_arrays(values))
                    first, end = built.ranges(rows.column("low").to_numpy(), rows.column("high").to_numpy())
                    met = np.flatnonzero(first < end)
                    first, end = first[met], end[met]
                    held = built.held[end] - built.held[first]
                    figures = [pa.array(x, pa.float64(), mask=held == 0) for x in built.figures(first, end)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id").take(pa.array(met)), pa.array(np.full(len(met), cells[lo])), pa.array(end - first), *figures, pa.array(held), built.heads(first, end, head)],
                        names=["id", "cell", "n", "total", "squares", "low", "high", "held", "head"],
                    )

    sides = p.unionByName(s).repartition("key", "cell").sortWithinPartitions("key", "cell", F.col("id").isNotNull())
    kind = f"id {kinds['id']}, cell long, n long, total double, squares double, low double, high double, held long, head array<double>"
    parts = sides.mapInArrow(run, kind)
    heads = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "head"))), lambda x: x["head"]))
    out = parts.groupBy("id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("held").alias("held"), *([heads.alias("head")] if head else []),
    )
    return out.withColumn("head", F.slice("head", 1, head)) if head else out
