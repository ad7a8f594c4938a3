"""Evaluation of predictions: localisation, persistence, operational scores, regression guards, isotonic calibration.

An episode is a row with its true and its predicted set of affected targets (arrays of numbers from 1 to TARGETS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGETS = 5


def share(condition: Column, among: Column | None = None) -> Column:
    """The share of rows that fulfil a condition among some; null if there are none."""
    return F.avg(F.when(F.lit(True) if among is None else among, condition.cast("double")))


def localization(episodes: DataFrame) -> DataFrame:
    """One row of figures on sets of targets from truth (null: not supervised) and predicted."""
    t, p = F.array_sort("truth"), F.array_sort("predicted")
    known, one, none = F.col("truth").isNotNull(), F.size("truth") == 1, F.size("truth") == 0
    called = F.size("predicted")
    return episodes.agg(
        F.count_if(known).alias("supervised"), F.count_if(~known).alias("unsupervised"), share(t == p, known).alias("exact_set_match"), F.count_if(known & one).alias("single_target_episodes"),
        share(t == p, known & one).alias("single_target_exact"), share(called == TARGETS, known & one).alias("single_target_all_rate"), share(called == 0, known & one).alias("single_target_none_rate"),
        share((called > 0) & (called < TARGETS), known & one).alias("single_target_partial_rate"), share(called > 0, known & none).alias("normal_false_positive_rate"),
    )


def per_target(episodes: DataFrame) -> DataFrame:
    """target, support, precision, recall, f1 over the supervised episodes, a row for every target."""
    rows = episodes.filter("truth IS NOT NULL").select("truth", "predicted", F.explode(F.sequence(F.lit(1), F.lit(TARGETS))).alias("target"))
    is_true, called = F.array_contains("truth", F.col("target")), F.array_contains("predicted", F.col("target"))
    n = rows.groupBy("target").agg(F.count_if(is_true & called).alias("tp"), F.count_if(is_true).alias("support"), F.count_if(called).alias("called"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return n.select("target", "support", safe(F.col("tp"), F.col("called")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"), safe(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"))


def cardinalities(episodes: DataFrame) -> DataFrame:
    """affected, episodes: how many episodes have so many predicted targets."""
    return episodes.groupBy(F.size("predicted").alias("affected")).agg(F.count(F.lit(1)).alias("episodes"))


def weighted_scores(pairs: DataFrame) -> DataFrame:
    """n, accuracy, macro_f1, weighted_f1 of (truth, predicted), from one count of the confusion matrix; classes are those of either side."""
    m = pairs.groupBy(F.col("truth").cast("string").alias("t"), F.col("predicted").cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.cast("long").alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")))
    per = m.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.support").alias("support"), F.sum("s.called").alias("called"), F.sum("s.tp").alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    return per.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def false_alerts(windows: DataFrame) -> DataFrame:
    """healthy_hours, false_alerts, per_hour of windows (truth, predicted, seconds): healthy windows that are called otherwise."""
    ok = F.col("truth") == "normal"
    hours = F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0.0)) / 3600
    n = F.count_if(ok & (F.col("predicted") != "normal"))
    return windows.agg(hours.alias("healthy_hours"), n.alias("false_alerts"), F.when(hours > 0, n / hours).alias("per_hour"))


def persistence(sessions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert events against sessions: one row a dataset, and one with a null dataset for all.

    sessions: dataset, session, healthy, start, end (seconds); alerts: session, at of the events that the alert policy
    emitted. Healthy sessions count false events per day, changed ones are detected by their first event; the median delay
    is the upper one.
    """
    first = alerts.groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.min("at").alias("first"))
    s = sessions.join(first, "session", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    ok = F.col("healthy")
    gone = F.col("first") - F.col("start")
    delay = F.when(~ok, F.when(gone < 0, 0.0).otherwise(gone))
    days = F.sum(F.when(ok, F.col("end") - F.col("start"))) / 86_400
    false, changed, found = F.sum(F.when(ok, F.col("events")).otherwise(0)), F.count_if(~ok), F.count_if(~ok & F.col("first").isNotNull())
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delay_ DESC)")  # counts each delay, holds no list
    return s.withColumn("delay_", delay).rollup("dataset").agg(
        days.alias("healthy_days"), false.alias("false_events"), F.when(days > 0, false / days).alias("false_events_per_day"), changed.alias("changed_sessions"), found.alias("detected"),
        F.when(changed > 0, found / changed).alias("recall"), upper.alias("median_delay"),
    )


def explanations(rows: DataFrame) -> DataFrame:
    """episodes, distinct, distinct_fraction, fallback_fraction of rows (explanation, source)."""
    n, kinds = F.count(F.lit(1)), F.count_distinct("explanation")
    return rows.agg(n.alias("episodes"), kinds.alias("distinct_explanations"), F.when(n > 0, kinds / n).otherwise(0.0).alias("distinct_fraction"), F.avg(F.col("source").startswith("deterministic_").cast("double")).alias("fallback_fraction"))


# The weights of the components of the operational score.
OPERATIONAL_WEIGHTS = {
    "overall_macro_f1": 0.12,
    "overall_normal_recall": 0.08,
    "overall_anomaly_recall": 0.06,
    "affected_f1": 0.18,
    "single_target_exact_set_match": 0.18,
    "single_target_noncollapse": 0.08,
    "minimum_per_target_f1": 0.18,
    "minimum_dataset_macro_f1": 0.06,
    "minimum_dataset_normal_recall": 0.03,
    "minimum_dataset_anomaly_recall": 0.03,
}


def operational_score(components: DataFrame, by: list[str]) -> DataFrame:
    """by, score: the weighted geometric mean of the components (columns name, value); one that is missing counts as 0, 0 as 1e-6."""
    weights = F.create_map(*(F.lit(x) for kv in OPERATIONAL_WEIGHTS.items() for x in kv))
    known = components.filter(F.col("name").isin(*OPERATIONAL_WEIGHTS)).groupBy(*by, "name").agg(F.max("value").alias("value"))
    weight = F.element_at(weights, F.col("name"))
    logs = F.sum(weight * F.log(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(1e-6))))
    return known.groupBy(*by).agg(F.exp(logs + (1 - F.sum(weight)) * F.log(F.lit(1e-6))).alias("score"))


def lowest(scores: DataFrame, by: str, value: str) -> DataFrame:
    """The lowest value and the first name that has it."""
    low = F.min(F.struct(value, by))
    return scores.agg(low.alias("l")).select(F.col(f"l.{by}").alias(by), F.col(f"l.{value}").alias(value))


def margin_ranks(rows: DataFrame) -> DataFrame:
    """Adds true_margin and rank: the place of target truth among the margins in descending order, the lower target first on ties."""
    own = F.element_at("margins", F.col("truth"))
    places = F.transform("margins", lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    before = F.filter(places, lambda q: (q["m"] > own) | ((q["m"] == own) & (q["k"] < F.col("truth") - 1)))
    return rows.withColumns({"true_margin": own, "rank": F.size(before) + 1})


def margin_summary(rows: DataFrame) -> DataFrame:
    """dataset, truth: episodes, mean, median, least and greatest true margin, shares of positive margins and of first ranks, mean rank."""
    m = F.col("true_margin")
    return margin_ranks(rows).groupBy("dataset", "truth").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(m).alias("mean"), F.percentile(m, 0.5).alias("median"), F.min(m).alias("least"), F.max(m).alias("greatest"), F.avg((m > 0).cast("double")).alias("positive_rate"),
        F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("top1_rate"),
    )


def set_name(targets: Column) -> Column:
    """NONE, Tn or MULTI of a set of targets."""
    return F.when(F.size(targets) == 0, "NONE").when(F.size(targets) == 1, F.concat(F.lit("T"), F.element_at(targets, 1))).otherwise("MULTI")


def detailed_set_name(targets: Column) -> Column:
    """NONE or the targets as T1+T4."""
    return F.when(F.size(targets) == 0, "NONE").otherwise(F.array_join(F.transform(F.array_sort(F.array_distinct(targets)), lambda t: F.concat(F.lit("T"), t)), "+"))


def set_index(targets: Column) -> Column:
    """The set as the number whose bits are its targets."""
    return F.aggregate(F.array_distinct(targets), F.lit(0), lambda a, t: a + F.pow(F.lit(2), t - 1).cast("int"))


def decoded_set(margins: Column) -> Column:
    """The most probable of the 2 ** TARGETS sets if targets are independent with these margins as log odds: those above zero."""
    return F.transform(F.filter(F.transform(margins, lambda m, k: F.struct(m.alias("m"), (k + 1).alias("k"))), lambda p: p["m"] > 0), lambda p: p["k"])


def decision_statistics(rows: DataFrame) -> DataFrame:
    """Additive counts of decisions on sets (truth, margins): episodes, exact, missed and extra targets, empty and single predictions."""
    p = decoded_set(F.col("margins"))
    e = rows.select("truth", p.alias("p"))
    return e.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.array_sort("truth") == F.array_sort("p")).alias("exact"), F.sum(F.size(F.array_except("truth", "p"))).alias("missed"), F.sum(F.size(F.array_except("p", "truth"))).alias("extra"),
        F.count_if(F.size("p") == 0).alias("empty"), F.count_if(F.size("p") == 1).alias("single"),
    )


def paired(champion: DataFrame, challenger: DataFrame, key: str = "episode") -> DataFrame:
    """key, truth, a, b of two predictors of the same episodes; fails if one has an episode that the other lacks."""
    both = champion.select(key, "truth", F.col("predicted").alias("a")).join(challenger.select(key, F.col("predicted").alias("b"), F.lit(True).alias("there_")), key, "full")
    lacking = F.col("there_").isNull() | F.col("truth").isNull()
    return both.select(key, F.when(lacking, F.raise_error(F.lit("the predictions are not of the same episodes"))).otherwise(F.col("truth")).alias("truth"), "a", "b")


def paired_gain_interval(pairs: DataFrame, key: str = "episode", samples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """gain, lower, upper: macro F1 of b less that of a, with the interval of a paired bootstrap.

    Each resample weighs an episode by a Poisson number drawn from a hash of the seed, the resample and the episode, so
    resamples need no exchange of rows: episodes are counted by (resample, truth, a, b) and all else is on those few cells.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r"), F.col(key))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    steps, total, term = [], 0.0, 0.36787944117144233  # exp(-1)
    for k in range(9):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))
    rows = pairs.select(key, "truth", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("r"))
    cells = rows.withColumn("w", F.when(F.col("r") == 0, F.lit(1)).otherwise(weight)).groupBy("r", "truth", "a", "b").agg(F.sum("w").alias("w"))
    long = cells.select("r", "truth", "w", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("who", "p"))
    hit = F.when(F.col("truth") == F.col("p"), F.col("w")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("w").alias("n"), hit.alias("tp")), F.struct(F.col("p").alias("label"), F.col("w").alias("n"), F.lit(0).cast("long").alias("tp"))))
    per = long.select("r", "who", sides.alias("s")).groupBy("r", "who", "s.label").agg(F.sum("s.n").alias("n"), F.sum("s.tp").alias("tp"))
    f1 = per.groupBy("r", "who").agg(F.avg(F.when(F.col("n") > 0, 2 * F.col("tp") / F.col("n")).otherwise(0.0)).alias("f1"))
    gains = f1.groupBy("r").agg((F.max(F.when(F.col("who") == "b", F.col("f1"))) - F.max(F.when(F.col("who") == "a", F.col("f1")))).alias("gain"))
    drawn = F.when(F.col("r") > 0, F.col("gain"))
    return gains.agg(F.max(F.when(F.col("r") == 0, F.col("gain"))).alias("gain"), F.percentile(drawn, (1 - level) / 2).alias("lower"), F.percentile(drawn, (1 + level) / 2).alias("upper"))


def regression_guard(champion: DataFrame, challenger: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """name, kind, champion, challenger, allowed, passed of metrics (name, value) by rules (name, 'gain' at least or 'drop' at most, amount).

    A metric that the challenger lacks fails; one that the champion lacks counts as 0.
    """
    r = champion.sparkSession.createDataFrame(rules, "name string, kind string, allowed double")
    a, b = champion.select("name", F.col("value").alias("champion")), challenger.select("name", F.col("value").alias("challenger"))
    met = r.join(a, "name", "left").join(b, "name", "left")
    gain = F.col("challenger") - F.coalesce("champion", F.lit(0.0))
    ok = F.when(F.col("kind") == "gain", gain >= F.col("allowed")).otherwise(-gain <= F.col("allowed"))
    return met.select("name", "kind", "champion", "challenger", "allowed", F.coalesce(ok, F.lit(False)).alias("passed"))


def best_candidate(candidates: DataFrame, champion: str) -> DataFrame:
    """name, score, promoted: the eligible candidate (guard passed) of the highest score, ties by name; else the champion."""
    eligible = (F.col("passed") | (F.col("name") == champion)) & F.col("score").isNotNull()
    best = candidates.filter(eligible).agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("b"))
    return best.select(F.col("b.name").alias("name"), (-F.col("b.minus")).alias("score"), (F.col("b.name") != champion).alias("promoted"))


def pooled(low: np.ndarray, high: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Neighbouring blocks (low, high, mean, weight) joined until their means rise."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), mean.tolist(), weight.tolist(), strict=True):
        while out and out[-1][2] >= block[2]:
            lo, _, m, w = out.pop()
            total = w + block[3]
            block = (lo, block[1], (m * w + block[2] * block[3]) / total, total)
        out.append(block)
    return out


def isotonic_curve(pairs: DataFrame, x: str = "confidence", y: str = "correct") -> DataFrame:
    """boundary, prediction: the isotonic regression of correctness on confidence, by pooling adjacent violators.

    Confidences are counted, dealt out by range and pooled where they lie; one task pools what blocks are left, which are the
    steps of the parts' curves and not the confidences. The curve stays a table: each block's first and last confidence.
    """
    blocks = "low double, high double, mean double, weight double"

    def pool(batches):
        out: list[tuple[float, float, float, float]] = []
        for b in batches:
            rows = np.array(out, np.float64).reshape(-1, 4).T
            out = pooled(*(np.append(r, b.column(k).to_numpy()) for k, r in enumerate(rows)))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.float64()) for k in range(4)], names=["low", "high", "mean", "weight"])

    v = F.col(x).cast("double")
    counted = pairs.filter(v.isNotNull()).groupBy(v.alias("low")).agg(F.avg(F.col(y).cast("double")).alias("mean"), F.count(F.lit(1)).cast("double").alias("weight")).filter("mean IS NOT NULL")
    parts = counted.select("low", F.col("low").alias("high"), "mean", "weight").repartitionByRange("low").sortWithinPartitions("low").mapInArrow(pool, blocks)
    whole = parts.repartition(1).sortWithinPartitions("low").mapInArrow(pool, blocks)
    return whole.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("boundary"), F.col("mean").alias("prediction"))


def calibrated(rows: DataFrame, curve: DataFrame, x: str = "confidence", cells: int = 1024) -> DataFrame:
    """rows with calibrated: the piecewise linear curve at x, flat beyond its ends, within 0 and 1.

    Pieces of the curve lie in the cells of its range that they touch, and a row meets those of its own cell.
    """
    order = Window.orderBy("boundary")  # a row for each step
    pieces = curve.select(F.col("boundary").alias("lo_"), F.col("prediction").alias("p_"), F.lead("boundary").over(order).alias("hi_"), F.lead("prediction").over(order).alias("q_"))
    ends = curve.agg(F.min("boundary").alias("first_"), F.max("boundary").alias("last_"))
    cell = lambda c: F.coalesce(F.floor((c - F.col("first_")) / F.nullif(F.col("last_") - F.col("first_"), F.lit(0.0)) * cells), F.lit(0))
    pieces = pieces.join(F.broadcast(ends)).withColumn("cell_", F.explode(F.sequence(cell(F.col("lo_")), cell(F.coalesce("hi_", "lo_"))))).drop("first_", "last_")
    v = F.col("v_")
    asked = rows.join(F.broadcast(ends)).withColumn("v_", F.greatest("first_", F.least("last_", F.col(x).cast("double"))))  # one row of ends
    asked = asked.withColumn("v_", F.when(F.col(x).isNotNull(), v)).withColumn("cell_", cell(v))
    met = asked.join(pieces, (asked["cell_"] == pieces["cell_"]) & (v >= F.col("lo_")) & (F.col("hi_").isNull() | (v < F.col("hi_"))), "left")
    value = F.when(F.col("hi_").isNull(), F.col("p_")).otherwise(F.col("p_") + (F.col("q_") - F.col("p_")) * (v - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))
    return met.select(*(asked[c] for c in rows.columns), F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("calibrated"))


def baseline_status(metrics: DataFrame, baselines: DataFrame, defaults: dict[str, float], key: str = "sensor") -> DataFrame:
    """Ratios and deltas of metrics (rms, kurtosis, crest, dominant_hz) to a sensor's own baseline, or the defaults, with their status.

    baselines: key and any of the metrics, null where the default holds; a row for each sensor.
    """
    own = baselines.select(key, *(F.col(c).alias(f"own_{c}") for c in defaults))
    m = metrics.join(own, key, "left")
    base = {c: F.coalesce(F.col(f"own_{c}"), F.lit(v)) for c, v in defaults.items()}
    ratio = F.col("rms") / F.greatest(base["rms"], F.lit(1e-12))
    level = lambda v, warn, high: F.when(v > high, "high").when(v > warn, "elevated").otherwise("normal")
    k, c = F.col("kurtosis"), F.col("crest")
    overall = F.when((ratio > 1.8) | (k > 6.5) | (c > 5.5), "highly_abnormal").when((ratio > 1.25) | (k > 4.5) | (c > 4.2), "abnormal").otherwise("normal")
    return m.select(
        *metrics.columns, ratio.alias("rms_ratio"), (k - base["kurtosis"]).alias("kurtosis_change"), (c - base["crest"]).alias("crest_change"), (F.col("dominant_hz") - base["dominant_hz"]).alias("dominant_hz_change"),
        level(ratio, 1.25, 1.8).alias("rms_status"), level(k, 4.5, 6.5).alias("kurtosis_status"), level(c, 4.2, 5.5).alias("crest_status"), overall.alias("status"),
    )


def dominant_sensors(windows: DataFrame) -> DataFrame:
    """win, sensor, stands_out: sensors that exceed the window's median by far (peak to peak 3 times and 0.2 at least, rms 1.6 times and 0.02), if one or two do."""
    by = Window.partitionBy("win")
    mid = lambda c: F.percentile(c, 0.5).over(by)
    over = (F.col("ptp") >= F.greatest(F.lit(0.2), 3 * F.col("mid_ptp"))) & (F.col("rms") >= F.greatest(F.lit(0.02), 1.6 * F.col("mid_rms")))
    w = windows.withColumns({"mid_ptp": mid("ptp"), "mid_rms": mid("rms")}).withColumn("over", over)
    n = F.count_if(F.col("over")).over(by)
    return w.withColumn("few", (n >= 1) & (n <= 2)).select("win", "sensor", (F.col("over") & F.col("few")).alias("stands_out"))
