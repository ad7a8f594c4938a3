"""What is told of a window's labels: anomalies and their severity, conflicts, envelopes, machine classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscillar.functions import text
from oscillar.operators import windows

# Labels that count as anomalies.
ANOMALOUS_SENSOR = ("mild_deviation", "significant_local_deviation", "impulsive_or_shock_event")
ANOMALOUS_NETWORK = ("localized_vibration_deviation", "multi_sensor_structure_wide_vibration_event")
MILD_NETWORK = ("mild_local_deviation", "mild_multi_sensor_deviation")


def _names(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("sensor")))), ",")


def anomaly_decisions(reports: DataFrame, network: DataFrame) -> DataFrame:
    """win, label, anomaly, severity, dedupe_key of the network's label with the labels of its sensors (sensor, win, label)."""
    strong, mild = F.col("label").isin("significant_local_deviation", "impulsive_or_shock_event"), F.col("label") == "mild_deviation"
    per = reports.groupBy("win").agg(_names(strong).alias("significant"), _names(mild).alias("mild"), F.count_if(strong).alias("n_strong"), F.count_if(F.col("label").isin(*ANOMALOUS_SENSOR)).alias("n_odd"), F.bool_or(F.col("label") == "possible_sensor_issue").alias("issue"))
    n = network.select("win", F.col("label"), "affected_sensors").join(per, "win", "left")
    label, strong_n = F.col("label"), F.coalesce("n_strong", F.lit(0))
    reached = {
        "notice": label.isin(*MILD_NETWORK) | (F.coalesce("mild", F.lit("")) != ""), "quality": (label == "sensor_network_quality_issue") | F.coalesce("issue", F.lit(False)),
        "warning": (label == "localized_vibration_deviation") | (strong_n >= 1), "critical": (label == "multi_sensor_structure_wide_vibration_event") | (strong_n >= 2),
    }
    height = F.greatest(*(F.when(c, k).otherwise(0) for k, c in enumerate(reached.values(), 1)))
    severity = F.element_at(F.array(*map(F.lit, ["normal", *reached])), height + 1)
    key = F.concat_ws("|", label, "affected_sensors", F.coalesce("significant", F.lit("")), F.coalesce("mild", F.lit("")))
    return n.select("win", "label", (label.isin(*ANOMALOUS_NETWORK) | (F.coalesce("n_odd", F.lit(0)) > 0)).alias("anomaly"), severity.alias("severity"), key.alias("dedupe_key"))


def quality_conflict(label: Column, flags: Column, reference_flags: Column, rule_label: Column) -> Column:
    """Whether a told label passes over quality flags, or finds fault with a window that the rules do not."""
    flagged = F.length(F.concat(F.coalesce(flags, F.lit("")), F.coalesce(reference_flags, F.lit("")))) > 0
    fault = label.isin(*windows.QUALITY_LABELS)
    return (flagged & ~fault) | F.coalesce(~rule_label.isin(*windows.QUALITY_LABELS) & fault, F.lit(False))


def rederived(told: DataFrame, rules: DataFrame) -> DataFrame:
    """win, label, source: the network's label from the labels that a model told (sensor, win, label), or the rules' own where one is missing or unknown."""
    both = rules.select("win", "sensor", F.col("label").alias("rule")).join(told.select("win", "sensor", F.col("label").alias("said")), ["win", "sensor"], "left")
    known = F.col("said").isin(*windows.SENSOR_LABELS)
    whole = both.groupBy("win").agg(F.bool_and(F.coalesce(known, F.lit(False))).alias("whole"))
    picked = both.join(whole, "win").select("win", "sensor", F.when(F.col("whole"), F.col("said")).otherwise(F.col("rule")).alias("label"))
    return windows.network_labels(picked).join(whole, "win").select("win", "label", F.when(F.col("whole"), "model").otherwise("rules").alias("source"))


def envelopes(attempted: DataFrame, labels: DataFrame) -> DataFrame:
    """win, attempted, checked, failed: the sensors that a window asked for (win, sensor), that have a usable label, and the others."""
    usable = labels.filter("label <> 'insufficient_data'").select("win", "sensor", F.lit(True).alias("ok_"))
    met = attempted.join(usable, ["win", "sensor"], "left")
    ok = F.coalesce("ok_", F.lit(False))
    return met.groupBy("win").agg(F.count(F.lit(1)).alias("attempted"), _names(ok).alias("checked"), _names(~ok).alias("failed"))


def bound_devices(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """board, serial, status of devices (board, serial) against a manifest of the same: bound, wrong_device, unknown_board, missing_device."""
    m = manifest.select("board", F.col("serial").alias("due"))
    both = seen.join(m, "board", "full")
    status = F.when(F.col("due").isNull(), "unknown_board").when(F.col("serial").isNull(), "missing_device").when(F.col("serial") == F.col("due"), "bound").otherwise("wrong_device")
    return both.select("board", "serial", status.alias("status"))


def machine_class(f: DataFrame) -> tuple[Column, Column]:
    """Class and severity of a rotating machine's window by its shape and its ratio to a baseline; columns rms_ratio, kurtosis, crest, skew, dominant_hz, flatness."""
    soft = lambda c, middle, scale: text.logistic(c, middle, 1 / scale)
    r, k, c, hz = f["rms_ratio"], f["kurtosis"], f["crest"], f["dominant_hz"]
    severity = windows.clamp01(0.35 * soft(r, 1.25, 0.25) + 0.3 * soft(k, 5.0, 1.5) + 0.2 * soft(c, 4.5, 1.0) + 0.15 * soft(F.abs(f["skew"]), 1.0, 0.7))
    by_band = F.when(hz >= 200, "inner_race_fault").when(hz >= 80, "outer_race_fault").when(r > 1.35, "imbalance_or_looseness").otherwise("unknown_abnormal")
    label = (
        F.when((severity < 0.32) & (r < 1.35) & (k < 4.5), "healthy").when((f["flatness"] > 0.65) & (r > 1.2) & (hz >= 80), "unknown_abnormal")
        .when((r > 1.35) & (k < 4.8) & (hz < 120), "imbalance_or_looseness").when((k > 5) | (c > 4.5) | (r > 2), by_band).otherwise("unknown_abnormal")
    )
    return label, severity


def amplitude_scales(samples: DataFrame, floor: float = 1e-6) -> DataFrame:
    """win, scale over all sensors of a window: the greatest of the scaled deviation from the median, a third of the 95th percentile of magnitudes, and a floor."""
    mid = samples.groupBy("win").agg(F.percentile("value", 0.5).alias("median"), F.percentile(F.abs("value"), 0.95).alias("high"))
    spread = samples.join(mid, "win").groupBy("win", "high").agg(F.percentile(F.abs(F.col("value") - F.col("median")), 0.5).alias("mad"))
    return spread.select("win", F.greatest(1.4826 * F.col("mad"), F.col("high") / 3, F.lit(floor)).alias("scale"))


def repeated_draw(rows: DataFrame, group: str, key: str, quota: int, seed: int = 0) -> DataFrame:
    """key, group, copies: a quota of rows for each group; groups that hold fewer rows use them again in turn (a sampling operator)."""
    from pyspark.sql import Window

    order = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    first = rows.select(group, key).withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).filter(F.col("turn") <= quota)
    sizes = first.groupBy(F.col(group).alias("group_")).agg(F.count(F.lit(1)).alias("of"))  # of larger groups no row is used twice
    copies = F.floor((quota - F.col("turn")) / F.col("of")) + 1
    return first.join(sizes, F.col(group).eqNullSafe(F.col("group_"))).select(key, group, copies.cast("int").alias("copies"))
