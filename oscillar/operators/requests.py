"""Window requests against a registry of sensors, the windows they ask for, and the validation export of reports with samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscillar.operators import windows

#: axes of a request as they are written, and what they mean.
AXES = {"x": "x", "y": "y", "z": "z", "0": "x", "1": "y", "2": "z", "norm": "norm", "magnitude": "norm", "vector_norm": "norm"}
#: fixed values: the longest window of a request, seconds; samples of a preview and of an answer at most.
LONGEST_S, PREVIEW, MOST_SAMPLES = 60.0, 16, 200_000
ROLES = ("baseline", "target")
#: fixed values: columns of the validation export, and what sensors without a report are given.
EXPORT = ["window_id", "sensor_id", "location", "role", "axis", "sampling_rate_hz", "time_s", "acceleration_g", "small_agent_label", "small_agent_confidence", "python_rule_label", "network_label", "quality_flags"]
REFERENCE_LABEL, UNTOLD_LABEL = "normal_relative_to_baseline", "insufficient_data"


def finite(text: Column) -> Column:
    """The number in a text; null for what is no finite number."""
    v = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def registry_faults(sensors: DataFrame) -> DataFrame:
    """sensors (sensor_id, role, location, axis, rate) with defaults and fault: no_id, duplicate_id, unknown_role, unknown_axis, bad_rate, no_baseline or several_baselines; null where sound."""
    s = sensors.withColumns({"sensor_id": F.nullif(F.trim("sensor_id"), F.lit("")), "role": F.lower(F.trim(F.coalesce("role", F.lit("target")))), "axis": F.lower(F.trim(F.coalesce("axis", F.lit("z"))))})
    s = s.withColumn("location", F.coalesce("location", "sensor_id"))
    ids = s.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("times_"))
    baselines = s.agg(F.count_if(F.col("role") == "baseline").alias("baselines_"))
    s = s.join(ids, "sensor_id", "left").join(F.broadcast(baselines))  # one row
    rate = finite(F.col("rate"))
    fault = (
        F.when(F.col("sensor_id").isNull(), "no_id").when(F.col("times_") > 1, "duplicate_id").when(~F.col("role").isin(*ROLES), "unknown_role").when(~F.col("axis").isin(*AXES), "unknown_axis")
        .when(F.col("rate").isNotNull() & F.coalesce(rate <= 0, F.lit(True)), "bad_rate").when(F.col("baselines_") == 0, "no_baseline").when(F.col("baselines_") > 1, "several_baselines")
    )
    known = F.create_map(*(F.lit(x) for kv in AXES.items() for x in kv))
    return s.select("sensor_id", "location", "role", F.try_element_at(known, F.col("axis")).alias("axis"), rate.alias("rate"), fault.alias("fault"))


def normal_requests(requests: DataFrame, registry: DataFrame, longest: float = LONGEST_S) -> DataFrame:
    """requests (request, sensor, axis, start, duration; texts) as request, sensor, location, axis, start_s (null: the latest), duration_s and fault.

    The axis of a request without one is the sensor's. A request with a fault (the first in the order below) is not read.
    """
    r = requests.join(registry.filter("fault IS NULL").select(F.col("sensor_id").alias("sensor"), "location", F.col("axis").alias("own_axis_")), "sensor", "left")
    start, duration = finite(F.col("start")), finite(F.col("duration"))
    known = F.create_map(*(F.lit(x) for kv in AXES.items() for x in kv))
    asked = F.nullif(F.lower(F.trim("axis")), F.lit(""))
    axis = F.when(asked.isNull(), F.col("own_axis_")).otherwise(F.try_element_at(known, asked))
    fault = (
        F.when(duration.isNull(), "duration_not_finite").when(F.col("start").isNotNull() & start.isNull(), "start_not_finite").when(start < 0, "start_negative").when(duration <= 0, "duration_not_positive")
        .when(duration > longest, "duration_over_cap").when(F.col("own_axis_").isNull(), "unknown_sensor").when(axis.isNull(), "unknown_axis")
    )
    return r.select("request", "sensor", "location", axis.alias("axis"), start.alias("start_s"), duration.alias("duration_s"), fault.alias("fault"))


def read_windows(requests: DataFrame, samples: DataFrame, preview: int = PREVIEW, most: int = MOST_SAMPLES, longest: float = LONGEST_S) -> DataFrame:
    """request, status, n, mean, rms, low, high, preview, thinned of normal requests: figures of all samples in [start, start + duration), the first ones as a preview.

    samples: sensor, ts (seconds), value. Without a start the window ends with the sensor's last sample. Requests and samples
    meet in cells of time as long as the longest window, so a request touches two or three, and takes its figures there from
    sums that its cell has made once. A request is `bad_request` with a fault, `no_samples` where there are none; thinned tells
    that an answer would hold every second, third ... sample only.
    """
    last = samples.groupBy("sensor").agg(F.max("ts").alias("last_"))
    r = requests.join(last, "sensor", "left").withColumn("low_", F.coalesce("start_s", F.col("last_") - F.col("duration_s")))
    high = F.when(F.col("start_s").isNotNull(), F.col("low_") + F.col("duration_s")).otherwise(float("inf"))
    sound = r.filter("fault IS NULL AND low_ IS NOT NULL").select("sensor", F.col("request").alias("id"), F.col("low_").alias("low"), high.alias("high"))
    v = windows.interval_figures(samples.select("sensor", F.col("ts").alias("at"), "value"), sound, "sensor", longest, preview)
    told = v.select(F.col("id").alias("request"), "n", F.try_divide("total", "held").alias("mean"), F.sqrt(F.try_divide("squares", "held")).alias("rms"), "low", "high", F.col("head").alias("preview"))
    status = F.when(F.col("fault").isNotNull(), "bad_request").when(F.col("n") > 0, "ok").otherwise("no_samples")
    out = requests.join(told, "request", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("request", status.alias("status"), "fault", "n", "mean", "rms", "low", "high", "preview", (F.col("n") > most).alias("thinned"))


def validation_rows(windows: DataFrame, reports: DataFrame, network: DataFrame, registry: DataFrame, reference: str) -> DataFrame:
    """The EXPORT columns for every sample of windows (sensor, win, rate, x, flags).

    reports: sensor, win, label, confidence, rule_label; network: win, label. The reference sensor has no report and counts as
    normal; other windows without one count as untold. Sensors that the registry lacks have null places.
    """
    w = windows.join(reports.select("sensor", "win", F.col("label").alias("told_"), "confidence", "rule_label"), ["sensor", "win"], "left")
    w = w.join(network.select("win", F.col("label").alias("network_label")), "win", "left")
    w = w.join(registry.select(F.col("sensor_id").alias("sensor"), "location", "role", "axis"), "sensor", "left")
    untold = F.when(F.col("sensor") == reference, REFERENCE_LABEL).otherwise(UNTOLD_LABEL)
    sure = F.when(F.col("sensor") == reference, 1.0).otherwise(0.0)
    one = w.select("*", F.posexplode("x").alias("k_", "v_"))
    time = F.when(F.col("rate") > 0, F.col("k_") / F.col("rate")).otherwise(F.col("k_").cast("double"))
    values = [
        F.col("win"), F.col("sensor"), F.col("location"), F.col("role"), F.col("axis"), F.col("rate"), time, F.col("v_"), F.coalesce("told_", untold), F.coalesce("confidence", sure), F.coalesce("rule_label", untold),
        F.coalesce("network_label", F.lit("")), F.coalesce("flags", F.lit("")),
    ]
    return one.select(*(v.alias(n) for v, n in zip(values, EXPORT, strict=True)))


def export_validation(windows: DataFrame, reports: DataFrame, network: DataFrame, registry: DataFrame, reference: str, folder: str) -> None:
    """Writes validation_windows (CSV with a header), agent_reports and network_assessments (JSON lines) into a new folder."""
    validation_rows(windows, reports, network, registry, reference).write.mode("errorifexists").option("header", True).csv(f"{folder}/validation_windows")
    reports.write.mode("errorifexists").json(f"{folder}/agent_reports")
    network.write.mode("errorifexists").json(f"{folder}/network_assessments")
