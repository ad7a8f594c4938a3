from datetime import datetime, timedelta

from pyspark.sql import functions as F

from oscillar.operators import corpus, windows

SAMPLES = "sensor string, win long, event_id long, ts timestamp, value double"


def samples(spark, rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, w, i, at + timedelta(seconds=i), float(v)) for i, (s, w, v) in enumerate(rows)], SAMPLES)


def test_features_of_a_square_wave(spark):
    got = windows.window_features(samples(spark, [("a", 0, v) for v in (1, -1, 1, -1)])).first()
    assert (got["rms"], got["crest"], got["kurtosis"], got["zcr"]) == (1.0, 1.0, 1.0, 1.0)


def test_features_of_a_constant_and_of_nothing(spark):
    got = windows.window_features(samples(spark, [("a", 0, 5)])).first()
    assert got["rms"] == 0 and got["crest"] == 0 and got["zcr"] == 0
    assert windows.window_features(samples(spark, [])).count() == 0


def test_quality_flags(spark):
    got = windows.window_quality(samples(spark, [("a", 0, 1)] * 3), expected=100).first()
    assert got["flags"] == "insufficient_samples,short_window,flatline" and got["gaps"] == 0 and got["notes"] == "flatline"


def compared(spark, **given):
    """One comparison with a reference, all figures calm but for those given."""
    calm = {"kurtosis": 3.0, "crest": 3.0, "rms_ratio": 1.0, "peak_ratio": 1.0, "ppv_ratio": 1.0, "spectral_distance": 0.0, "flags": "", "reference_flags": ""} | given
    kind = "kurtosis double, crest double, rms_ratio double, peak_ratio double, ppv_ratio double, spectral_distance double, flags string, reference_flags string"
    c = spark.createDataFrame([tuple(calm.values())], kind)
    label, sure = windows.sensor_label(c)
    return tuple(c.select(label, sure).first())


def test_label_ladder(spark):
    nothing = dict.fromkeys(("kurtosis", "crest", "rms_ratio", "peak_ratio", "ppv_ratio", "spectral_distance"))
    for given, label in (
        ({}, "normal_relative_to_baseline"), (nothing, "normal_relative_to_baseline"), ({"flags": "insufficient_samples,flatline", "peak_ratio": 9.0}, "insufficient_data"), ({"reference_flags": "missing_data"}, "insufficient_data"),
        ({"reference_flags": "flatline"}, "possible_sensor_issue"), ({"peak_ratio": 5.0}, "impulsive_or_shock_event"), ({"kurtosis": 8.0}, "impulsive_or_shock_event"), ({"ppv_ratio": 3.0}, "significant_local_deviation"),
        ({"spectral_distance": 0.65}, "significant_local_deviation"), ({"spectral_distance": 0.35}, "mild_deviation"), ({"rms_ratio": 1.5}, "mild_deviation"),
    ):
        assert compared(spark, **given) == (label, windows.SENSOR_LABELS[label])


def test_network_ladder(spark):
    calm, mild, strong = "normal_relative_to_baseline", "mild_deviation", "significant_local_deviation"
    cases = [
        ([calm] * 5, "normal_relative_to_reference_sensor"), ([calm] * 4 + ["insufficient_data"], "sensor_network_quality_issue"), ([strong, strong, calm, calm, calm], "multi_sensor_structure_wide_vibration_event"),
        ([mild, mild, mild, calm, calm], "multi_sensor_structure_wide_vibration_event"), ([mild, mild, calm, calm, calm], "mild_multi_sensor_deviation"), ([mild, calm, calm], "mild_local_deviation"), ([strong, calm, calm], "localized_vibration_deviation"),
    ]
    rows = [(w, f"s{k}", label) for w, (labels, _) in enumerate(cases) for k, label in enumerate(labels)]
    got = {r["win"]: r["label"] for r in windows.network_labels(spark.createDataFrame(rows, "win long, sensor string, label string")).collect()}
    assert got == {w: label for w, (_, label) in enumerate(cases)}


def test_history_needs_samples(spark):
    f = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "sensor string, win long, rms double")
    assert {r["percentile"] for r in windows.history_scores(f, f).collect()} == {None}
    assert windows.history_scores(f, f, least=4).filter("win = 3").first()["percentile"] == 100


def test_nearest_asof_prefers_the_earlier_on_a_tie(spark):
    left = spark.createDataFrame([("k", 5, 1), ("q", 5, 2)], "k string, t long, id long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("k", 3, 30), ("k", 7, 70), ("k", 9, 90)], "k string, rt long, v long").withColumn("rt", F.timestamp_seconds("rt"))
    got = {r["id"]: r["matched_v"] for r in windows.asof_nearest(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {1: 30, 2: None}


def test_asof_across_cells_against_brute_force(spark):
    import random

    rng = random.Random(6)
    lefts = [(rng.choice("ab"), rng.randrange(5000), i) for i in range(300)]
    rights = [(rng.choice("ab"), t, 1000 + i) for i, t in enumerate(rng.sample(range(5000), 25))]
    left = spark.createDataFrame(lefts, "k string, t long, id long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame(rights, "k string, rt long, v long").withColumn("rt", F.timestamp_seconds("rt"))
    got = {r["id"]: r["matched_v"] for r in windows.asof_nearest(left, right, ["k"], "t", "rt", ["v"], cell_seconds=100).collect()}
    assert got == {i: min((abs(rt - t), rt, v) for q, rt, v in rights if q == k)[2] for k, t, i in lefts}
    got = {r["id"]: r["matched_v"] for r in windows.asof_forward(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {i: min(((rt, v) for q, rt, v in rights if q == k and rt >= t), default=(0, None))[1] for k, t, i in lefts}


def test_splits_hold_small_buckets(spark):
    docs = spark.createDataFrame([("d", "s", i) for i in range(30)] + [("e", "s", 100), ("f", "s", 200), ("f", "s", 201), ("f", "s", 201)], "dataset string, stratum string, g long")
    got = corpus.assign_splits(docs, "dataset", "stratum", "g")
    counts = {(r["dataset"], r["split"]): r["count"] for r in got.groupBy("dataset", "split").count().collect()}
    assert counts[("e", "train")] == 1 and counts[("f", "train")] == 1 and counts[("f", "test")] == 1
    assert sum(counts[("d", s)] for s in corpus.SPLITS) == 30 and counts[("d", "train")] >= 22
    assert corpus.leaking_groups(got).count() == 0


def test_metrics_of_perfect_and_missing_classes(spark):
    pairs = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "c")], "truth string, predicted string")
    got = {r["label"]: r for r in corpus.classification_metrics(pairs).collect()}
    assert got["a"]["f1"] == 1 and got["c"]["support"] == 0 and got["c"]["f1"] == 0 and abs(got["accuracy"]["recall"] - 2 / 3) < 1e-12


def test_auroc_counts_ties_half(spark):
    pairs = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "confidence double, correct int")
    assert corpus.auroc(pairs).first()["auroc"] == 0.875
